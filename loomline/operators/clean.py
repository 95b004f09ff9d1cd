"""Cleaning of raw question rows, and option shuffling that can be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import arrays, text
from loomline.operators.predicates import numbered

OPTIONS = [f"option{x}" for x in "ABCDEFG"]
#: Levels that a clean item may have.
VALID_LEVELS = ["Easy", "Medium", "Hard", "Challenging"]


def clean_items(raw: DataFrame) -> DataFrame:
    """Raw rows (question, optionA..optionG, correctOption, medicalTopic, difficultLevel: text) as items, ``is_valid`` and
    ``raw``, the row as it came.

    Invalid are rows without question, with an unknown level, or whose correct option is not one of those given. An id is the
    hash of the row's content and of how many equal rows have been numbered before it, so every row has its own.
    """
    given = [F.col(x) if x in raw.columns else F.lit(None).cast("string") for x in OPTIONS]
    options = F.filter(F.array(*given), lambda o: o.isNotNull() & (o != ""))
    content = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(raw.columns)])
    # equal rows follow one another when all are numbered by their content, so a row's place among them is a difference
    keyed = numbered(raw.withColumn("__content", F.md5(content)), [F.col("__content")], "__number")
    first = keyed.groupBy("__content").agg(F.min("__number").alias("__first"))
    keyed = keyed.join(first, "__content")
    made = keyed.select(
        F.md5(F.concat_ws("\x1f", "__content", (F.col("__number") - F.col("__first")).cast("string"))).alias("id"),
        F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"}).alias("raw"),
        arrays.remap(F.trim("difficultLevel")).alias("difficulty_level"),
        text.split_trimmed("medicalTopic").alias("medical_topic"),
        text.better_question("question").alias("question"),
        text.better_options(options).alias("options"),
        arrays.identity_map(F.size(options)).alias("option_map"),
        text.last_char("correctOption").alias("answer"),
        text.letter_index(text.last_char("correctOption")).cast("int").alias("answer_index"),
    )
    sound = (F.char_length("question") > 0) & F.col("difficulty_level").isin(VALID_LEVELS) & F.col("answer_index").between(0, F.size("options") - 1) & F.forall("options", lambda o: F.trim(o) != "")
    return made.withColumn("is_valid", F.coalesce(sound, F.lit(False)))


def split_valid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects): rejects are the raw rows, as JSON."""
    return items.filter("is_valid").drop("is_valid", "raw"), items.filter("not is_valid").select("raw")


def shuffle_options(items: DataFrame, seed: int) -> DataFrame:
    """Items with their options in an order that depends on id and seed alone; option_map, answer and index follow."""
    mixed = items.withColumn("option_map", arrays.hashed_order(F.col("id"), F.size("options"), seed))
    moved = mixed.withColumn("options", arrays.permute("options", "option_map")).withColumn("answer_index", arrays.position_in("option_map", "answer_index"))
    return moved.withColumn("answer", text.index_letter("answer_index"))


def unshuffle_answers(answers: DataFrame, maps: DataFrame, letters: str = arrays.LETTERS) -> DataFrame:
    """Answers to shuffled items (id, shuffle, answer) in the letters of the original order; others are dropped."""
    back = answers.join(maps.select("id", "shuffle", "option_map"), ["id", "shuffle"])
    return back.withColumn("answer", arrays.unshuffle("answer", "option_map", letters)).filter("answer is not null").drop("option_map")
