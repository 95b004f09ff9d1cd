"""Inserts, updates and upserts as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def values(spark: SparkSession, rows: list[dict], schema: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Literal rows, NaN as null, with columns of SQL text repeated on each."""
    frame = spark.createDataFrame([{k: None if v != v else v for k, v in r.items()} for r in rows], schema)
    return frame.withColumns({k: F.expr(v) for k, v in (extra or {}).items()})


def _same(keys: list[str], left: str = "t", right: str = "s"):
    if not keys:
        raise ValueError("a key column is needed")
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return out


def insert(table: DataFrame, rows: DataFrame, returning: list[str] | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The table with ``rows``; with ``returning``, also these columns of what was inserted. Nothing to insert is an error."""
    if not rows.limit(1).count():
        raise ValueError("there are no rows to insert")
    made = table.unionByName(rows, allowMissingColumns=True)
    return (made, rows.select(*returning)) if returning else made


def stage(rows: list[dict], schema: str, spark: SparkSession, name: str, chunk: int = 10_000) -> DataFrame:
    """Typed staged rows as the temporary view ``name``, built a chunk at a time; a staging name begins with ``#``, which the
    view's own name leaves out."""
    if not name.startswith("#"):
        raise ValueError("a staging name begins with #")
    frame = None
    for at in range(0, max(1, len(rows)), chunk):
        part = values(spark, rows[at : at + chunk], schema)
        frame = part if frame is None else frame.unionByName(part)
    frame.createOrReplaceTempView(name[1:])
    return frame


def one_a_key(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key: the last in the order, or without one that whose other values, compared as text column by column,
    come last; which row it is does not depend on how rows are dealt."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    ranked = F.struct(*[F.col(c) for c in order or []], *[F.col(c).cast("string") for c in others], F.struct(*others).alias("__row"))
    best = rows.groupBy(*keys).agg(F.max(ranked).getField("__row").alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def _absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """Rows of keys that the table lacks, in its columns."""
    return one_a_key(rows, keys, order).join(table, keys, "left_anti").select(*[c for c in rows.columns if c in table.columns])


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose keys the table has are left out; of new rows that repeat a key that of ``one_a_key`` is taken."""
    return table.unionByName(_absent(table, rows, keys, order), allowMissingColumns=True)


def update(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The table with the given columns (all but the keys) taken from the row of the same keys, null values too. A row of the
    table is changed once: of several staged rows with its keys that of ``one_a_key`` counts."""
    columns = columns or [c for c in rows.columns if c not in keys and c in table.columns]
    side = one_a_key(rows, keys, order).select(*keys, *columns, F.lit(True).alias("__hit"))
    joined = table.alias("t").join(side.alias("s"), _same(keys), "left")
    return joined.select(*[F.when(F.col("s.__hit"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in columns else F.col(f"t.{c}").alias(c) for c in table.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], columns: list[str] | None = None, mode: str = "both", order: list[str] | None = None) -> DataFrame:
    """``update``, ``insert`` (of absent keys) or ``both``, each key once."""
    if mode not in ("both", "update", "insert"):
        raise ValueError(f"unknown mode {mode}")
    updated = update(table, rows, keys, columns, order) if mode != "insert" else table
    return updated if mode == "update" else updated.unionByName(_absent(table, rows, keys, order), allowMissingColumns=True)


def json_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON text, the way a table of configurations stores them."""
    return frame.withColumns({c: F.to_json(c) for c in columns})


def parsed_columns(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text columns as the given types."""
    return frame.withColumns({c: F.from_json(c, kind) for c, kind in columns.items()})


class Collection:
    """A table that takes inserts and gives them to readers on commit."""

    def __init__(self, frame: DataFrame):
        self.frame, self.pending = frame, []

    def insert(self, document: dict) -> None:
        self.insert_many([document])

    def insert_many(self, documents: list[dict]) -> None:
        self.pending += documents

    def commit(self) -> int:
        """Add what is pending; how many rows that was. Without a commit nothing is added."""
        done, self.pending = self.pending, []
        if done:
            rows = self.frame.sparkSession.createDataFrame(done, self.frame.schema)
            self.frame = self.frame.unionByName(rows)
        return len(done)

    def rollback(self) -> None:
        self.pending = []

    def find(self, condition=None) -> DataFrame:
        return self.frame if condition is None else self.frame.filter(condition)


def first_or_missing(frame: DataFrame, condition, what: str = "row"):
    """The first row that meets the condition; an error where there is none."""
    found = frame.filter(condition).limit(1).collect()
    if not found:
        raise LookupError(f"no such {what}")
    return found[0]


def last_of_hash(frame: DataFrame, hash_column: str, order: list[str]) -> DataFrame:
    """Of rows with equal hashes the last in the order; equal rows of the order are told apart by all columns."""
    keys = F.struct(*order, *[c for c in frame.columns if c not in (*order, hash_column)])
    last = frame.groupBy(hash_column).agg(F.max(keys).alias("row"))
    return last.select(*[F.col(c) if c == hash_column else F.col(f"row.{c}").alias(c) for c in frame.columns])


def ordered_columns(frame: DataFrame, exclude: list[str] | None = None) -> list[str]:
    return sorted(set(frame.columns) - set(exclude or []))


def first_open(frame: DataFrame, done: str, ignored: str, key: str) -> DataFrame:
    """First row that is neither done nor ignored; there is no locking."""
    return frame.filter(~F.coalesce(F.col(done), F.lit(False)) & ~F.coalesce(F.col(ignored), F.lit(False))).orderBy(key).limit(1)


def with_dependencies(configs: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """Configs (name) with the JSON array of their parts (part_name, config) by links (name, part_name)."""
    found = links.join(parts, "part_name", "left")
    grouped = found.groupBy("name").agg(F.to_json(F.array_sort(F.collect_list(F.struct("part_name", "config")))).alias("parts"))
    return configs.join(grouped, "name", "left").withColumn("parts", F.coalesce("parts", F.lit("[]")))
