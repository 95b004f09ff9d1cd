"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import reread, shared_dir, table, work_path

__all__ = ["arrow_map", "forget", "narrow", "reread", "row_key", "shared_dir", "small_batches", "spans", "table", "tokenizer_path", "work_path", "worker_state"]

_STATE: dict = {}


#: Rows that go to a Python worker at once where they hold texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: ten thousand of them, which is a batch by default, would be held several times over by the executor
    and its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def worker_state(key, make: Callable):
    """What ``make()`` gives, kept in this worker from task to task. A worker keeps one such thing: the next drops it."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def forget() -> None:
    """Drop what earlier tasks have left in this worker."""
    _STATE.clear()


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the files are installed beside Python, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def narrow(docs: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the named types; any other column, however it is called, is left behind."""
    return docs.select([docs[f"`{name}`"].cast(kind).alias(name) for name, kind in kinds.items()])


def row_key(*names: str) -> Column:
    """A 128-bit key of a row's content; equal rows share it, which is what the operators want of repeated rows."""
    said = lambda n: F.col(f"`{n}`").cast("string")
    parts = [F.when(said(n).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.octet_length(said(n)).cast("string"), F.lit(":"), said(n))) for n in names]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def arrow_map(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with state made once a task: ``make()`` returns the function applied to each batch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if batch.num_rows:
                out = apply(batch)
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(run, schema)


def spans(total: int, size: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) over ``total`` in steps of ``size``."""
    for start in range(0, total, size):
        yield start, min(total, start + size)
