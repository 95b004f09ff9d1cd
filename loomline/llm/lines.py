"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines of a text, at each position, are hashed together. A window whose hash occurs more than once
anywhere is repeated; its first occurrence, in the order of document ids and positions, stays, and each later one covers
its three positions. Covered positions of a text, merged, are removed. Windows without a word count for nothing, and a
text of fewer than three lines stays as it is.

Windows are shuffled as 16-byte hashes and positions; equal ones of a task are counted before they are shuffled, and the
join that finds the later occurrences is one whose large partitions Spark splits. What has to go from which text is sent to
all tasks as long as it is no more than ``FEW`` positions, and texts stay where they are; beyond that texts are shuffled once,
with the same result.

Rows: a null text stays null; rows with a null id come after all others; rows that repeat id and text are one document,
and each gets its result; lines are split at line feeds and compared byte for byte; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import reread, small_batches

WIDTH = 3
#: Positions of windows that are broadcast at most.
FEW = 4_000_000


def windows_of(text: str, width: int = WIDTH) -> Iterator[tuple[int, bytes]]:
    """(position, hash) of every window with a word."""
    lines = text.encode().split(b"\n")
    if len(lines) < width:
        return
    digests = [hashlib.blake2b(x, digest_size=16).digest() for x in lines]
    blank = [not x.split() for x in lines]
    for k in range(len(lines) - width + 1):
        if not all(blank[k : k + width]):
            yield k, hashlib.blake2b(b"".join(digests[k : k + width]), digest_size=16).digest()


def without(text: str, starts: list[int], width: int = WIDTH) -> tuple[str, int]:
    """The text without the positions that windows at ``starts`` cover, and how many lines went."""
    lines = text.split("\n")
    covered = {k + d for k in starts for d in range(width)}
    return "\n".join(x for k, x in enumerate(lines) if k not in covered), len(covered)


def _later(spark: SparkSession, keyed: DataFrame, width: int) -> DataFrame:
    """(row, starts): for every document the positions of windows that occurred before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, ats, hashes = [], [], [], []
            for doc_id, row, text in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for at, digest in windows_of(text, width):
                    ids.append(doc_id)
                    rows.append(row)
                    ats.append(at)
                    hashes.append(digest)
            if ids:
                yield pa.record_batch([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(ats, pa.int32())], ["window", "id", "row", "at"])

    found = reread(spark, keyed.filter("text is not null").select("id", "row", "text").mapInArrow(run, "window binary, id long, row long, at int"), "windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    first = found.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("final")).filter("first < final").select("window", "first")
    later = found.join(first, "window").filter(place > F.col("first"))
    return later.groupBy("id", "row").agg(F.collect_set("at").alias("starts"))


def dedup_lines(spark: SparkSession, docs: DataFrame, width: int = WIDTH, few: int = FEW) -> DataFrame:
    """``doc``: every row of ``docs`` as it was; ``text``: its text without repeated passages; n_lines and n_removed."""
    small_batches(spark)
    text = docs["text"].cast("string")
    keyed = docs.select(F.struct(*[docs[f"`{name}`"] for name in docs.columns]).alias("doc"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    later = reread(spark, _later(spark, keyed, width).select(F.col("id").alias("l_id"), F.col("row").alias("l_row"), "starts"), "later")
    size = later.agg(F.sum(F.size("starts") + 8)).first()[0] or 0
    # most rows have nothing to remove: their texts go through the join but not through Python
    joined = keyed.drop("text").join(F.broadcast(later) if size <= few else later, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("row") == F.col("l_row")), "left").select("doc", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for text, starts in zip(batch.column("doc").field("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                lines = 0 if text is None else text.count("\n") + 1
                kept, gone = (text, 0) if text is None or not starts else without(text, starts, width)
                out.append((kept, lines, gone))
            columns = zip(*out, strict=True)
            yield pa.record_batch([batch.column("doc"), *(pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True))], ["doc", "text", "n_lines", "n_removed"])

    return joined.mapInArrow(run, T.StructType([joined.schema["doc"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated passages, n_lines and n_removed of every row."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return dedup_lines(spark, plain).select("doc.doc_id", "text", "n_lines", "n_removed")


def cleaned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from text, and n_chars, where there is such a column, counted anew."""
    found = dedup_lines(spark, docs)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars") if "n_chars" in docs.columns else None)}
    return found.select(*[changed[name].alias(name) if name in changed else F.col(f"doc.`{name}`") for name in docs.columns])


ORACLE = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, generate_subscripts(lines, 1) - 1 as pos, unnest(lines) as line from d where text is not null),
w as (select doc_id, pos, line, lead(line) over o as second, lead(line, 2) over o as third from l window o as (partition by doc_id order by pos)),
k as (select *, row_number() over (partition by line, second, third order by doc_id, pos) as nth from w
      where third is not null and regexp_matches(concat(line, second, third), '[^\x20\x09-\x0D]')),
c as (select distinct doc_id, pos + s as pos from k, unnest([0, 1, 2]) as u(s) where nth > 1),
r as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) filter (c.pos is null) as text,
             count(*) as n_lines, count(c.pos) as n_removed
      from l left join c on l.doc_id = c.doc_id and l.pos = c.pos group by l.doc_id)
select d.doc_id, case when d.text is not null then coalesce(r.text, '') end as text,
       coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed
from d left join r on d.doc_id = r.doc_id
"""
