"""Content-addressed WARC archive.

An archive is a folder of three tables. ``payloads`` holds each distinct payload once under its SHA-256; ``responses`` and
``revisits`` hold the exact header block of each record beside its payload's digest. The record with the smallest page id of
equal payloads is a response; the others are revisits that refer to it. Payloads and responses are filed in buckets by digest,
so reading joins the two without shuffling a payload: every stored payload is hashed anew and compared with its address, every
response is put together byte for byte, and the length and digest that its header states are compared with those of its block.
What a revisit's payload is comes from the response of its digest; a payload that a third of all records share is joined as
a line of facts, whose large partitions Spark splits.

Rows: a null html is an empty payload. A row with a null page id is archived with an empty id and is a response only
where no equal payload has an id. Rows that repeat both page id and payload are all of the same kind and have the same record
id. Payloads smaller than ``least`` bytes are always responses. Other columns are ignored, however they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import narrow, reread, work_path

CRLF = "\r\n"
END = b"\r\n\r\n"
#: Records carry a fixed date: an archive of the same pages is the same, byte for byte.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 20 bits at a time through base 32, whose digits are then renamed."""
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _identity(page: Column, sha1: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), sha1, F.lit(">"))


def _header() -> Column:
    revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _identity(F.col("page_id"), F.col("sha1"))),
        _line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNull(), "").otherwise(_line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(REVISIT_PROFILE)), _line("WARC-Refers-To", _identity(F.col("refers_to"), F.col("sha1"))))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    ).cast("binary")


def _store(frame: DataFrame, path: str, buckets: int) -> None:
    """Files in buckets by digest, sorted; the catalog's entry goes again, the files stay."""
    name = f"archive_{uuid.uuid4().hex}"
    frame.write.bucketBy(buckets, "sha256").sortBy("sha256").format("parquet").option("path", path).saveAsTable(name)
    frame.sparkSession.sql(f"drop table {name}")


def _stored(spark: SparkSession, path: str, columns: str, buckets: int) -> DataFrame:
    name = f"archive_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (sha256) sorted by (sha256) into {buckets} buckets location '{path}'")
    frame = spark.table(name)
    spark.sql(f"drop table {name}")
    return frame


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``.

    Only digests are shuffled to find the responses; payloads are shuffled once, after equal ones of a task have become
    one, so a payload that a third of all rows share costs a task no more than one copy.
    """
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = narrow(pages, page_id="long", url="string", html="string").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    _store(rows.select("sha256", "payload").dropDuplicates(["sha256"]), f"{path}/payloads", buckets)
    facts = rows.select("page_id", "url", "sha256", sha1_base32(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = facts.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("payload_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    named = facts.join(first, "sha256").withColumn("refers_to", F.when(revisit, F.col("first_id")))
    records = reread(spark, named.select("sha256", _header().alias("header"), F.col("refers_to").isNull().alias("response")), "records")
    # by digest first, so that a bucket is written by one task, as one file
    _store(records.filter("response").drop("response").repartition(buckets, "sha256"), f"{path}/responses", buckets)
    records.filter("not response").drop("response").write.parquet(f"{path}/revisits")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """``sha256``, ``header``, ``payload`` and ``record``, the exact bytes of header, block and end, of every response."""
    buckets = spark.read.parquet(f"{path}/layout").first().buckets
    stored = _stored(spark, f"{path}/payloads", "sha256 binary, payload binary", buckets)
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("sha256"))).cast("binary"))
    joined = _stored(spark, f"{path}/responses", "sha256 binary, header binary", buckets).join(stored.withColumn("payload", sound), "sha256")
    return joined.withColumn("record", F.concat("header", "payload", F.lit(END)))


def read_revisits(spark: SparkSession, path: str) -> DataFrame:
    """``sha256``, ``header`` and ``record`` of every revisit, whose block is empty."""
    return spark.read.parquet(f"{path}/revisits").withColumn("record", F.concat("header", F.lit(END)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records with the payloads that they stand for: header, payload and record."""
    responses = read_responses(spark, path)
    payloads = responses.select("sha256", "payload").dropDuplicates(["sha256"])
    return responses.select("header", "payload", "record").unionByName(read_revisits(spark, path).join(payloads, "sha256").select("header", "payload", "record"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per record what its header says, beside length and digest taken from the rebuilt response of its payload.

    A response whose block has not the length or the digest that its header states is an error, and so is a revisit that
    states another digest than its payload's."""
    head = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"\n{name}: (.*)\r\n", 1), F.lit(""))
    page = lambda name: F.nullif(F.regexp_extract(field(name), r"^<urn:page:(-?\d*):\w+>$", 1), F.lit("")).cast("long")
    states = F.regexp_extract(field("WARC-Payload-Digest"), r"^sha1:(\w+)$", 1)
    said = ["sha256", page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), states.alias("stated")]
    block = F.substring(F.col("record"), F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - len(END))
    rebuilt = read_responses(spark, path).select(*said, field("Content-Length").cast("long").alias("length"), block.alias("block"))
    wrong = lambda what: F.raise_error(F.lit(f"a record's header states another {what}"))
    size = F.octet_length("block").cast("long")
    facts = rebuilt.select("sha256", "page_id", "record_type", "refers_to", "stated", F.when(size == F.col("length"), size).otherwise(wrong("length").cast("long")).alias("payload_bytes"), sha1_base32(F.col("block")).alias("digest"))
    same = F.when(F.col("stated") == F.col("digest"), F.col("digest")).otherwise(wrong("digest").cast("string")).alias("payload_digest")
    found = reread(spark, facts.select("sha256", "page_id", "payload_bytes", same, "record_type", "refers_to"), "responses")
    known = reread(spark, found.groupBy("sha256").agg(F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("digest")), "facts")
    revisits = read_revisits(spark, path).select(*said).join(known, "sha256").select("page_id", "payload_bytes", same, "record_type", "refers_to")
    return found.drop("sha256").unionByName(revisits)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file."""
    at, mark = 0, b"\r\n\r\n"
    while at < len(data):
        end = data.index(mark, at) + 4
        header = data[at:end]
        size = next(int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if data[end + size : end + size + 4] != mark:
            raise ValueError("a record does not end where its length says")
        yield header, data[end : end + size]
        at = end + size + 4


def write_warc_files(spark: SparkSession, path: str, out: str) -> None:
    """Export an archive as text files of base64 records, one a line; ``base64 -d`` of the lines, joined, is a WARC file."""
    read_records(spark, path).select(F.regexp_replace(F.base64("record"), r"\s", "").alias("value")).write.text(out)


def read_warc_files(spark: SparkSession, glob: str) -> DataFrame:
    """``path``, ``header`` and ``block`` of every record of plain WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for header, block in parse_warc(content.as_py()):
                    yield pa.record_batch([pa.array([name.as_py()]), pa.array([header], pa.binary()), pa.array([block], pa.binary())], ["path", "header", "block"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, "path string, header binary, block binary")


def archive_facts(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write an archive of ``pages`` in the shared folder and read it back."""
    path = work_path(spark, "warc")
    write_archive(pages, path, least)
    return read_facts(spark, path)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hexed,
             min(page_id) over (partition by sha256(html)) as first_id from p),
g as (select *, [('0x' || hexed[5 * k + 1 : 5 * k + 5])::bigint for k in range(8)] as groups from d)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(groups, lambda v: array_to_string(list_transform([15, 10, 5, 0],
           lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), '')), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from g
"""
