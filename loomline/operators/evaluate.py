"""Scores of answers in long form: a row an item and run, with id, level, gold, model, shuffle, run and answer.

Missing answers: ``accuracy`` leaves them out of the denominator; ``pass_at_k`` and ``by_topic`` count them as wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.arrays import ratio

ALL = "All"
#: US dollars for a million input and output tokens.
PRICES = {
    "qwen3": (0.29, 0.39),
    "o3-mini": (0.55, 2.2),
    "gpt-4o": (1.25, 5.0),
    "gemini-2-0-flash": (0.1, 0.4),
    "claude-3-5-sonnet": (1.5, 7.5),
    "deepseek-r1": (1.35, 5.4),
    "llama4-maverick": (0.12, 0.485),
}
#: Measured mean input and output tokens of an answer, where a model's own are not known.
MEAN_TOKENS = (242.3569140788191, 604.4085781924523)


def correct(answer: str = "answer", gold: str = "gold") -> Column:
    """True where the answer is the gold one; false, not null, where either is missing."""
    return F.coalesce(F.col(answer) == F.col(gold), F.lit(False))


def _by_level(frame: DataFrame, keys: list[str], hits: Column, total: Column, levels: list[str] | None) -> DataFrame:
    """Counts by keys and level and, under ``All``, by keys alone; listed levels without rows have zero counts."""
    grouped = frame.groupingSets([[*keys, "level"], keys], *keys, "level").agg(hits.alias("cnt_correct"), total.alias("cnt_total"), F.grouping("level").alias("over"))
    named = grouped.filter("over = 1 or level is not null").withColumn("difficulty_level", F.when(F.col("over") == 1, ALL).otherwise(F.col("level"))).drop("over", "level")
    if levels is not None:
        wanted = named.select(*keys).distinct().withColumn("difficulty_level", F.explode(F.array(*map(F.lit, [*levels, ALL]))))
        named = wanted.join(named, [*keys, "difficulty_level"], "left").fillna(0, ["cnt_correct", "cnt_total"])
    return named.select(*keys, "difficulty_level", F.col("cnt_correct").cast("long").alias("cnt_correct"), F.col("cnt_total").cast("long").alias("cnt_total"), ratio(F.col("cnt_correct"), F.col("cnt_total")).alias("accuracy"))


def accuracy(answers: DataFrame, keys: list[str] | None = None, levels: list[str] | None = None) -> DataFrame:
    """Right answers and given answers by run (or ``keys``) and level, and over all levels."""
    return _by_level(answers, keys or ["model", "run"], F.count_if(correct()), F.count("answer"), levels)


def pass_at_k(answers: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Items that any of a model's runs answers, by level; every item counts."""
    any_right = answers.groupBy("model", "id", "level").agg(F.bool_or(correct()).alias("hit"))
    return _by_level(any_right, ["model"], F.count_if("hit"), F.count("*"), levels)


def _of_all_runs(answers: DataFrame, runs: int) -> DataFrame:
    """Items that every run has a row of, with how many of the runs are right, whatever the case of the letters."""
    right = F.coalesce(F.lower("answer") == F.lower("gold"), F.lit(False))
    return answers.groupBy("model", "id").agg(F.count_distinct("run").alias("n"), F.sum(right.cast("int")).alias("right")).filter(F.col("n") == runs).drop("n")


def pass_at_k_of_files(answers: DataFrame, runs: int, denominator: str = "first") -> DataFrame:
    """pass@k over items that all runs have; the denominator is the size of the ``first`` run, of the ``intersection``,
    or of ``all`` items."""
    hits = _of_all_runs(answers, runs).groupBy("model").agg(F.count_if(F.col("right") > 0).alias("cnt_correct"), F.count("*").alias("both"))
    first = answers.groupBy("model").agg(F.min("run").alias("first_run"))
    sizes = answers.join(first, "model").groupBy("model").agg(F.count_if(F.col("run") == F.col("first_run")).alias("first"), F.count_distinct("id").alias("all"))
    total = F.coalesce(F.col("both" if denominator == "intersection" else denominator), F.lit(0))
    return sizes.join(hits, "model", "left").select("model", F.coalesce("cnt_correct", F.lit(0)).alias("cnt_correct"), total.alias("cnt_total"), ratio(F.coalesce("cnt_correct", F.lit(0)), total).alias("accuracy"))


def ensemble(answers: DataFrame, runs: int) -> DataFrame:
    """Items of which more than half of the runs are right, over items that all runs have."""
    counted = _of_all_runs(answers, runs)
    return counted.groupBy("model").agg(F.count_if(F.col("right") > runs / 2).alias("cnt_correct"), F.count("*").alias("cnt_total")).withColumn("accuracy", ratio(F.col("cnt_correct"), F.col("cnt_total")))


def vote(answers: DataFrame) -> DataFrame:
    """The most frequent answer to an item among a model's runs; of equally frequent ones that of the earliest run; null
    where no run has answered."""
    counted = answers.groupBy("model", "id", "answer").agg(F.count("answer").alias("n"), F.min("run").alias("first"))
    given = F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("less"), "first", "answer"))
    return counted.groupBy("model", "id").agg(F.min(given)["answer"].alias("answer"))


def majority(answers: DataFrame) -> DataFrame:
    """The answer that more than half of an item's runs give, else null."""
    counted = answers.groupBy("model", "id", "answer").agg(F.count("*").alias("n"))
    given = F.when(F.col("answer").isNotNull(), F.struct("n", "answer"))
    whole = counted.groupBy("model", "id").agg(F.max(given).alias("top"), F.sum("n").alias("runs"))
    return whole.select("model", "id", F.when(F.col("top.n") > F.floor(F.col("runs") / 2), F.col("top.answer")).alias("answer"))


def counts(frame: DataFrame, column: str) -> DataFrame:
    """Value counts, most frequent first, nulls left out; ties in the order of the values."""
    return frame.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), column)


def top_values(frame: DataFrame, column: str, k: int = 10) -> DataFrame:
    return counts(frame, column).limit(k)


def by_topic(answers: DataFrame, topics: str = "topics", k: int = 10) -> DataFrame:
    """Accuracy of each model in the ``k`` most frequent topics; a missing answer is wrong, an item without topics has none."""
    exploded = answers.withColumn("topic", F.explode_outer(topics))
    items = exploded.select("id", "topic").distinct()
    # at most ``k`` rows
    best = F.broadcast(top_values(items, "topic", k).select("topic"))
    return exploded.join(best, "topic", "left_semi").groupBy("model", "topic").agg(F.avg(correct().cast("int")).alias("accuracy"), F.count("*").alias("cnt"))


def counters(answers: DataFrame, topics: str = "topics") -> DataFrame:
    """Items and right items by topic and by level: (kind, name, cnt_correct, cnt_total)."""
    hit = answers.groupBy("id", "level", topics).agg(F.bool_or(correct()).alias("hit"))
    shape = lambda frame, kind, name: frame.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count_if("hit").alias("cnt_correct"), F.count("*").alias("cnt_total"))
    return shape(hit.withColumn("topic", F.explode(topics)), "topic", "topic").unionByName(shape(hit, "level", "level"))


def pivot_levels(scores: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """A row a run, a column a level."""
    return scores.groupBy(*keys).pivot("difficulty_level", [*levels, ALL]).agg(F.first("accuracy"))


def in_list_order(frame: DataFrame, column: str, wanted: list) -> DataFrame:
    """The rows whose value is in the list, in its order, with their ``place`` from 0."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(column)).cast("int") - 1
    return frame.filter(F.col(column).isin(wanted)).withColumn("place", place).orderBy("place")


def model_of_run(name) -> Column:
    """The model in a run's name: what stands before the first ``__``."""
    return F.split_part(name, F.lit("__"), F.lit(1))


def run_numbers(files: DataFrame) -> DataFrame:
    """Run numbers of a model's and shuffle's files in the order of their names."""
    return files.withColumn("run", F.dense_rank().over(W.partitionBy("model", "shuffle").orderBy("file")))


def improvement(single: DataFrame, together: DataFrame) -> DataFrame:
    """What the ensemble gains over the single run, by model."""
    return together.select("model", F.col("accuracy").alias("ensemble")).join(single.select("model", F.col("accuracy").alias("single")), "model").withColumn("improvement", F.col("ensemble") - F.col("single"))


def f1_scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class of (gold, answer) rows. An extension."""
    classes = pairs.select(F.explode(F.array_distinct(F.array("gold", "answer"))).alias("label"), "gold", "answer").filter("label is not null")
    is_gold, is_answer = F.col("gold").eqNullSafe(F.col("label")), F.col("answer").eqNullSafe(F.col("label"))
    counted = classes.groupBy("label").agg(F.count_if(is_gold & is_answer).alias("tp"), F.count_if(~is_gold & is_answer).alias("fp"), F.count_if(is_gold & ~is_answer).alias("fn"))
    return counted.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


# -- cost


def price_list(spark: SparkSession) -> DataFrame:
    """model, price_in and price_out; a handful of rows."""
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, price_in double, price_out double")


def cost_per_1k(mean_in: Column, mean_out: Column, price_in: Column, price_out: Column) -> Column:
    """US dollars for a thousand answers."""
    return mean_in / 1e3 * price_in + mean_out / 1e3 * price_out


def token_cost(usage: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Mean tokens and cost for a thousand answers, by model, of (model, tokens_in, tokens_out)."""
    means = usage.groupBy("model").agg(F.avg("tokens_in").alias("mean_in"), F.avg("tokens_out").alias("mean_out"))
    return means.withColumn("cost_per_1k_answers", cost_per_1k(F.col("mean_in"), F.col("mean_out"), F.lit(price_in), F.lit(price_out)))


def usage_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """tokens_in and tokens_out of response lines, whichever names the provider gives them."""
    get = lambda *names: F.coalesce(*[F.get_json_object(line, f"$.response.body.usage.{n}").try_cast("double") for n in names])
    return lines.select("*", get("prompt_tokens", "input_tokens").alias("tokens_in"), get("completion_tokens", "output_tokens").alias("tokens_out"))


def words_as_tokens(items: DataFrame, prompt_words: int = 0) -> DataFrame:
    """Estimated tokens of a prompt: four thirds of the mean words of question and options and of the fixed prompt."""
    from loomline.functions.text import word_count

    options = word_count(F.array_join("options", " "))
    return items.agg(((F.avg(word_count("question")) + F.avg(options) + prompt_words) * 4 / 3).alias("tokens_in"))


#: Models of a price list that is broadcast at most.
FEW = 100_000


def accuracy_and_cost(scores: DataFrame, costs: DataFrame) -> DataFrame:
    """Scores with the cost of their model, null where it has none; ``costs`` is a price list, a row a model."""
    return scores.join(F.broadcast(costs) if costs.limit(FEW + 1).count() <= FEW else costs, "model", "left")
