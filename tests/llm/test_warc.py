import base64
import hashlib

import pytest

from loomline.llm import warc
from loomline.llm.common import work_path

SCHEMA = "page_id long, url string, html string, sha256 string"
ROWS = [(5, "http://a", "<p>é</p>", "x"), (2, "http://b", "<p>é</p>", None), (9, None, None, "x"), (7, "u", "", "x"), (None, "u", "<p>é</p>", "x"), (11, "u", "y" * 300000, "x"), (2, "http://b", "<p>é</p>", None), (None, None, "only null", None), (12, "http://c\r\nX-Evil: 1", "z\r\n\r\nWARC-Type: revisit\r\n", "x")]


def brute(rows, least=0):
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = len(b) >= least and f is not None and p != f
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_facts(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = warc.archive_facts(spark, pages, least)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, least)


def test_round_trip(spark, tmp_path):
    path = work_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), path)
    rows = warc.read_records(spark, path).collect()
    ids = [bytes(r.header).split(b"<urn:page:")[1].split(b":")[0].decode() for r in rows]
    assert sorted((i, bytes(r.payload)) for i, r in zip(ids, rows)) == sorted(("" if p is None else str(p), (h or "").encode()) for p, _, h, _ in ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h, _ in ROWS})
    assert len({bytes(r.header).split(b"Record-ID: ")[1].split(b"\r")[0] for r in rows}) == len({(p, h or "") for p, _, h, _ in ROWS})
    data = b"".join(bytes(r.record) for r in rows)
    parsed = list(warc.parse_warc(data))
    assert [h for h, _ in parsed] == [bytes(r.header) for r in rows]
    for (header, block), r in zip(parsed, rows):
        assert block == (b"" if b"WARC-Type: revisit\r\n" in header.split(b"WARC-Record")[0] else bytes(r.payload)) and b"\nX-Evil" not in header
    (tmp_path / "a.warc").write_bytes(data)
    assert {(bytes(r.header), bytes(r.block)) for r in warc.read_warc_files(spark, f"file://{tmp_path}/*.warc").collect()} == set(parsed)
    warc.write_warc_files(spark, path, f"file://{tmp_path}/out")
    lines = [base64.b64decode(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert sorted(lines) == sorted(bytes(r.record) for r in rows)


@pytest.mark.parametrize(("table", "change", "what"), [
    ("payloads", "cast(concat(cast(payload as string), '!') as binary) payload", "does not match its digest"),
    ("responses", "cast(replace(cast(header as string), 'Length: ', 'Length: 1') as binary) header", "another length"),
    ("responses", "cast(replace(cast(header as string), 'sha1:', 'sha1:A') as binary) header", "another digest"),
])
def test_damage_is_found(spark, table, change, what):
    path = work_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), path)
    bad = spark.createDataFrame(spark.read.parquet(f"{path}/{table}").selectExpr("sha256", change).collect())
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    warc._store(bad, f"{path}/{table}", spark.read.parquet(f"{path}/layout").first().buckets)
    with pytest.raises(Exception, match=what):
        warc.read_facts(spark, path).collect()


def test_payloads_are_joined_where_they_lie(spark):
    path = work_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.read_responses(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_bucket_is_a_file(spark):
    path = work_path(spark, "warc")
    rows = [(i, "u", f"page {i % 400}", None) for i in range(1000)]
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(16), path)
    buckets = spark.read.parquet(f"{path}/layout").first().buckets
    for part in ("responses", "payloads"):
        names = {r.n for r in spark.read.parquet(f"{path}/{part}").selectExpr("_metadata.file_name as n").distinct().collect()}
        assert len(names) <= buckets, part
    assert warc.read_responses(spark, path).count() == 400


def test_empty(spark):
    assert warc.archive_facts(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark, sf_dir):
    import duckdb

    from loomline.llm import catalog

    got = sorted(map(tuple, catalog.QUERIES["op1_content_addressed_warc"](spark, sf_dir).collect()), key=str)
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(c.execute(catalog.ORACLES["op1_content_addressed_warc"]).fetchall(), key=str)
