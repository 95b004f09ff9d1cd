"""Sinks: Parquet folders, JSON lines, CSV, file copies, reports and rejects."""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.predicates import numbered
from loomline.session import work_path


def overwrite_parquet(frame: DataFrame, folder: str) -> None:
    frame.write.mode("overwrite").parquet(folder)


def overwrite_increment(frame: DataFrame, folder: str, column: str) -> None:
    """Replace only the partitions of the increments that ``frame`` holds, so that loading one again repeats nothing."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(folder)


def write_batches(frame: DataFrame, folder: str, kind: str = "json", size: int = 10_000) -> None:
    """Files of at most ``size`` rows."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown kind {kind}")
    writer = frame.write.mode("append").option("maxRecordsPerFile", size)
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(folder)


def write_jsonl(frame: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Non-ASCII text stays readable; times are ISO."""
    frame.write.mode(mode).option("ignoreNullFields", "false").json(folder)


def write_csv(frame: DataFrame, folder: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).option("header", "true").option("escape", '"').csv(folder)


def write_valid(items: DataFrame, good: str, rejects: str) -> None:
    """Valid rows to one folder, the others to another: as they came, where ``raw`` holds them, else as they are."""
    write_jsonl(items.filter("is_valid").drop("is_valid", "raw"), good)
    bad = items.filter("not is_valid")
    if "raw" in items.columns:
        bad.select("raw").write.mode("overwrite").text(rejects)
    else:
        write_jsonl(bad.drop("is_valid"), rejects)


def write_pretty(frame: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """JSON objects over several lines, non-ASCII text readable."""
    frame.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(folder)


def _file_system(uri: str):
    """(file system, path) that a task's Python can write to: local, s3, hdfs or gcs addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def copy_files(blocks: DataFrame, folder: str) -> int:
    """Write files (key, content) byte for byte to ``folder``/key, each in the task that has read it; how many. A task that
    runs again writes the same files."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                system, path = _file_system(f"{root}/{key}")
                system.create_dir(posixpath.dirname(path), recursive=True)
                with system.open_output_stream(path, compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    return blocks.select("key", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def archive_files(spark: SparkSession, folder: str, out: str, glob: str = "*.jsonl") -> int:
    """All files below ``folder`` that match as one tar.gz, whose one stream one task writes; how many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(out)
        done = 0
        with system.open_output_stream(path, compression=None) as stream, gzip.GzipFile(fileobj=stream, mode="wb") as packed, tarfile.open(fileobj=packed, mode="w") as archive:
            for batch in batches:
                for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    member = tarfile.TarInfo(name.split(base, 1)[-1])
                    member.size = len(content.as_buffer())
                    archive.addfile(member, io.BytesIO(content.as_py()))
                    done += 1
        yield pa.record_batch([pa.array([done], pa.int64())], ["n"])

    return files.select("path", "content").orderBy("path").coalesce(1).mapInArrow(run, "n long").first()[0]


def append_to_json_array(spark: SparkSession, path: str, items: list[dict]) -> int:
    """Add objects to a JSON array file; how many it has then. A file that is missing or blank is an empty array; the new
    file takes the old one's place when it is whole."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    said = ""
    if system.exists(file):
        stream = system.open(file)
        try:
            said = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    known = json.loads(said) if said.strip() else []
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(("[\n" + ",\n".join(json.dumps(x, ensure_ascii=False) for x in [*known, *items]) + "\n]").encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, file, options)
    return len(known) + len(items)


def write_named_batches(frame: DataFrame, folder: str, etl: str, field: str, kind: str = "json", size: int = 10_000, mark: str | None = None, replace: bool = False, version: int | None = None) -> list[str]:
    """Files of ``size`` rows in the order of ``field``, named ``ETL_<etl>_IV_<value>_<uuid>.<kind>`` by the value up to which
    data had been written before; their names. ``replace``: files of an earlier run from the same mark go first. With a
    ``version`` the last part of a name follows from it and the file's number, and what an earlier try of it has left goes first."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown kind {kind}")
    spark = frame.sparkSession
    jvm = spark._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    there = [s.getPath() for s in system.listStatus(path(folder))]
    named = lambda k: str(uuid.uuid4() if version is None else uuid.uuid5(uuid.NAMESPACE_URL, f"{etl}/{version}/{k}"))
    earlier = set() if version is None else {f"_{named(k)}.{kind}" for k in range(len(there))}
    for file in there:
        name = file.getName()
        if name.startswith(f"ETL_{etl}_IV_") and (replace and name.startswith(f"ETL_{etl}_IV_{mark or ''}_") or name[-len(f"_{uuid.UUID(int=0)}.{kind}") :] in earlier):
            system.delete(file, False)
    staged = work_path(spark, "batches")
    paged = numbered(frame, [F.col(field)], "__at").withColumn("__page", F.floor(F.col("__at") / size)).drop("__at")
    ends = paged.groupBy("__page").agg(F.max(field).cast("string").alias("last")).orderBy("__page").collect()
    writer = paged.repartition("__page").sortWithinPartitions("__page", field).write.partitionBy("__page")
    (writer.option("header", "true").csv(staged) if kind == "csv" else writer.option("ignoreNullFields", "false").json(staged))
    befores = [mark or "", *(end["last"] for end in ends)]
    names = [f"ETL_{etl}_IV_{before}_{named(k)}.{kind}" for k, before in enumerate(befores[:-1])]

    def move(page, name: str) -> None:
        (found,) = [s.getPath() for s in system.listStatus(path(f"{staged}/__page={page}")) if s.getPath().getName().startswith("part-")]
        if not system.rename(found, path(f"{folder}/{name}")):
            raise OSError(f"could not write {name}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, [end["__page"] for end in ends], names))
    return names


def report(scores: DataFrame, counted: DataFrame) -> DataFrame:
    """One row: accuracy over ``scores`` and JSON objects of right and all items by topic and by level."""
    both = counted.select("kind", "name", "cnt_correct", "cnt_total").unionByName(scores.select(F.lit("score").alias("kind"), F.lit("").alias("name"), "cnt_correct", "cnt_total"))
    of = lambda kind, value: F.when((F.col("kind") == kind) & F.col("name").isNotNull(), value)
    entries = [F.to_json(F.map_from_entries(F.array_sort(F.collect_list(of(k, F.struct("name", c)))))).alias(f"{k}_{c}") for k in ("topic", "level") for c in ("cnt_correct", "cnt_total")]
    return both.agg((F.sum(of("score", F.col("cnt_correct"))) / F.sum(of("score", F.col("cnt_total")))).alias("accuracy"), *entries)


def jdbc_sink(url: str, table: str, size: int = 10_000, **options: str) -> dict[str, str]:
    """Options of a bulk insert."""
    return {"url": url, "dbtable": table, "batchsize": str(size), **options}


def write_jdbc(frame: DataFrame, url: str, table: str, size: int = 10_000, **options: str) -> None:
    frame.write.mode("append").format("jdbc").options(**jdbc_sink(url, table, size, **options)).save()


def replace_jdbc(frame: DataFrame, url: str, table: str, column: str, version: int, size: int = 10_000, **options: str) -> None:
    """Rows of a version, in place of those that an earlier try of it has left: they are deleted by ``column``, which the rows
    carry, before the new ones are added. A table that is not there yet is made."""
    spark = frame.sparkSession
    if options.get("driver"):
        spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(options["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, options.get("user"), options.get("password")) if options.get("user") else spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        schema, name = table.rsplit(".", 1) if "." in table else (None, table)
        there = any(connection.getMetaData().getTables(None, schema, n, None).next() for n in (name, name.upper(), name.lower()))
        if there:
            named = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
            statement = connection.prepareStatement(f"DELETE FROM {table} WHERE {named} = ?")
            statement.setLong(1, version)
            statement.executeUpdate()
            statement.close()
    finally:
        connection.close()
    write_jdbc(frame.withColumn(column, F.lit(version).cast("long")), url, table, size, **options)
