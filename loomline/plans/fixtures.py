"""Question items and answers derived from the TPC-H-like tables, for Spark and, as SQL text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import index_letter
from loomline.session import spread, table

LEVELS = ["Easy", "Medium", "Hard"]

SQL = """
items as (select p_partkey id, p_size % 4 gold_i, chr(65 + cast(p_size % 4 as int)) gold,
                 case p_partkey % 3 when 0 then 'Easy' when 1 then 'Medium' else 'Hard' end lvl,
                 string_split(p_name, ' ') topics, p_name question,
                 [p_brand, p_type, p_name, cast(p_size as varchar)] options from part),
ans as (select l_partkey id, l_linenumber run, max(l_quantity) mq, max(l_suppkey) ms from lineitem group by 1, 2),
runs as (select unnest(range(1, 8)) run),
grid as (select i.id, i.lvl, i.gold, i.topics, r.run, 'm' || ((r.run - 1) // 3) model,
                case when a.id is null then null when cast(a.mq as int) % 2 = 0 then i.gold
                     else chr(65 + cast(a.ms % 4 as int)) end answer
         from items i cross join runs r left join ans a on a.id = i.id and a.run = r.run)
"""


def items(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("answer_index"), index_letter(F.col("p_size") % 4).alias("gold"), level.alias("level"),
        F.split("p_name", " ").alias("topics"), F.col("p_name").alias("question"), F.array("p_brand", "p_type", "p_name", F.col("p_size").cast("string")).alias("options"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """A row an item and run; the answer is null where the item has no line of the run's number."""
    given = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("run")).agg(F.max("l_quantity").alias("mq"), F.max("l_suppkey").alias("ms"))
    grid = items(spark, d).select("id", "level", "gold", "topics", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("run"))
    letter = F.when(F.col("mq").isNull(), None).when(F.col("mq").cast("int") % 2 == 0, F.col("gold")).otherwise(index_letter(F.col("ms") % 4))
    joined = grid.join(given, ["id", "run"], "left")
    return joined.select("id", "level", "gold", "topics", "run", F.concat(F.lit("m"), F.floor((F.col("run") - 1) / 3).cast("string")).alias("model"), letter.alias("answer"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions whose options are language and source."""
    return spread(table(spark, d, "documents")).select(F.col("doc_id").alias("idx"), F.col("text").alias("q"), F.array("lang", "source").alias("options"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Events as response lines: content is their properties as JSON text, tokens their ``k``."""
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.struct(F.col("event_type").alias("model"), F.array(F.struct(F.struct(F.concat(F.lit('{"answer": "'), index_letter(F.col("event_id") % 4), F.lit('"}')).alias("content")).alias("message"))).alias("choices"), F.struct(k.alias("prompt_tokens"), (k * 2).alias("completion_tokens")).alias("usage"))
    line = F.to_json(F.struct(F.concat(F.lit("task_"), F.col("event_id").cast("string")).alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response")))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), line.alias("value"))
