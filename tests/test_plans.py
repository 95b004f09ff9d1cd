import bz2
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomline.operators import evaluate
from loomline.plans import fixtures, runner
from loomline.plans.registry import ConfigError, Pipeline, Registry, Transformer
from loomline.plans.templates import render
from loomline.sources import readers, writers
from loomline.sources.readers import JsonView
from loomline.streaming import increments

TEMPLATE = "raw{{'/' + execution_time.strftime('%Y-%m-%d') if execution_time != '*' else ''}}"


def test_templates():
    assert render(TEMPLATE) == "raw" and render(TEMPLATE, "2024-02-03T00:00:00Z") == "raw/2024-02-03" == render(TEMPLATE, datetime(2024, 2, 3))
    assert render("plain") == "plain"
    for bad in ("{{ __import__('os') }}", "{{ execution_time.__class__ }}", "{{ 1 * 2 }}"):
        with pytest.raises((ValueError, SyntaxError)):
            render(bad)


@pytest.fixture
def raw(tmp_path):
    for day in ("2024-02-03", "2024-02-04"):
        folder = tmp_path / "raw" / day / "deep"
        folder.mkdir(parents=True)
        (folder / "a.data.json.bz2").write_bytes(bz2.compress(b"".join(json.dumps({"id": k, "day": day}).encode() + b"\n" for k in range(3))))
        (folder / "b.other.json").write_text('{"id": 99}\n')
    return tmp_path


def test_transformer(spark, raw):
    registry = Registry(spark)
    view = JsonView("v", path_glob_filter="*.data.json.bz2", compress_type="bzip2", recursive_file_lookup=True, filename_field="origin")
    registry.add_transformer(Transformer("t", f"file://{raw}/{TEMPLATE}", f"file://{raw}/out", (view,), "  select id, day, origin from v  ;\n"))
    t = registry.get("transformers", "t")
    assert t.transform_sql == "select id, day, origin from v"
    rows = runner.run_transformer(spark, t, "2024-02-03T00:00:00Z").collect()
    assert sorted(r.id for r in rows) == [0, 1, 2] and all(r.origin.endswith("a.data.json.bz2") and r.day == "2024-02-03" for r in rows)
    assert runner.run_transformer(spark, t).count() == 6
    assert runner.run_transformer(spark, t, "1999-01-01T00:00:00Z") is None
    with pytest.raises(ConfigError):
        registry.add_transformer(t)
    with pytest.raises(ConfigError) as error:
        registry.add_transformer(Transformer("bad", "s", "d", (view,), "selec from"))
    assert "transformSql" in error.value.errors


def test_registry_checks():
    r = Registry()
    with pytest.raises(ConfigError):
        r.add_conn("c", "nothing")
    with pytest.raises(ConfigError) as error:
        r.add_conn("c", "aws", {"accessKey": "k", "odd": 1})
    assert set(error.value.errors) == {"secretKey", "odd"}
    c = r.add_conn("c", "aws", {"accessKey": "k", "secretKey": "hidden"})
    assert "hidden" not in repr(c)
    with pytest.raises(ConfigError):
        r.add_conn("c", "aws", {"accessKey": "k", "secretKey": "s"})
    with pytest.raises(ConfigError):
        r.add_ext("e", "awsStorage", {"prefix": "p"}, ["missing"])
    r.add_ext("e", "awsStorage", {"prefix": "p"}, ["c"])
    r.add_ext("t", "sqlServer", {"table": "t", "batchSize": 5, "orderSql": "x"})
    r.add_loader("l", "local", {"folder": "f"})
    assert [x.name for x in r.dependencies("extractors", "e")] == ["c"]
    for bad in (Pipeline("p", "none", "l"), Pipeline("p", "e", "none"), Pipeline("p", "e", "l", mode="odd"), Pipeline("p", "t", "l", mode="copyFile")):
        with pytest.raises(ConfigError):
            r.add_pipeline(bad)
    assert r.add_pipeline(Pipeline("p", "e", "l", mode="copyFile")).mode == "copyFile"
    with pytest.raises(ConfigError):
        r.get("pipelines", "q")


def test_pipelines(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"file://{tmp_path}/store/bronze/nation")
    r = Registry(spark)
    r.add_ext("files", "awsStorage", {"prefix": "bronze/nation", "root": f"file://{tmp_path}/store", "pathGlobFilter": "*.parquet"})
    r.add_ext("blocks", "awsStorage", {"prefix": "bronze", "root": f"file://{tmp_path}/store", "pathGlobFilter": "**/*.parquet", "removePrefix": "bronze"})
    r.add_loader("out", "local", {"folder": f"file://{tmp_path}/out"})
    r.add_loader("copies", "local", {"folder": f"file://{tmp_path}/copies"})
    r.add_pipeline(Pipeline("p", "files", "out", transform_sql="select n_name from data where n_regionkey = 1", include_private_fields=True, tag="x"))
    got = runner.run_pipeline(spark, r, "p")
    assert got.count() == 5 and got.first()["__etl_private_field__-tagNameValue"] == "x" and got.first()["__etl_private_field__-extNameValue"] == "files"
    r.add_pipeline(Pipeline("c", "blocks", "copies", mode="copyFile"))
    assert runner.run_pipeline(spark, r, "c") >= 1
    assert spark.read.parquet(f"file://{tmp_path}/copies/nation").count() == 25


def test_globs():
    import re

    match = lambda p, k: bool(re.search(readers.glob_pattern("a", p), k))
    assert match("*.json", "a/x.json") and not match("*.json", "a/b/x.json") and match("**/*.json", "a/b/c/x.json") and match("**/*.json", "a/.x.json")
    assert match("[!b]?.j", "a/cd.j") and not match("[!b]?.j", "a/bd.j") and not match("x.json", "a/xAjson") and match("**", "a/b/c")


def test_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,optionA\n"two\nlines","say ""x"""\nplain,007\n')
    rows = readers.read_csv(spark, f"file://{tmp_path}/q.csv", tag="file").collect()
    assert [(r.question, r.optionA, r.file) for r in rows] == [("two\nlines", 'say "x"', "q.csv"), ("plain", "007", "q.csv")]
    (tmp_path / "l.jsonl").write_text('{"qid": "1", "answer": "A"}\n\n{"qid": "2"}\n')
    assert readers.read_jsonl(spark, f"file://{tmp_path}/l.jsonl").count() == 2 and readers.read_jsonl(spark, f"file://{tmp_path}/l.jsonl", skip_blank=False).count() == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.json", '{"x": 1}')
        z.writestr("b.txt", "no")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/z.zip")
    found = readers.read_json_of_zips(files.select("path"), files, r"\.json$").collect()
    assert [(r.member, r.text) for r in found] == [("a.json", '{"x": 1}')]
    packed = readers.zip_members(spark.createDataFrame([("p", "m", "t")], "path string, member string, text string"))
    assert readers.read_json_of_zips(packed.select("path"), packed, ["m"]).first().text == "t"
    (tmp_path / "bz").mkdir()
    (tmp_path / "bz" / "x.bz2").write_bytes(bz2.compress(b"hello"))
    assert bytes(readers.read_blocks(spark, f"file://{tmp_path}/bz", compress_type="bzip2").first().content) == b"hello"


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, "é", "x"), (2, None, "y")], "id long, s string, inc string")
    writers.write_jsonl(frame, f"file://{tmp_path}/j")
    assert "é" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    writers.overwrite_increment(frame, f"file://{tmp_path}/i", "inc")
    writers.overwrite_increment(frame.filter("inc = 'x'"), f"file://{tmp_path}/i", "inc")
    assert spark.read.parquet(f"file://{tmp_path}/i").count() == 2
    writers.write_batches(spark.range(10).coalesce(1), f"file://{tmp_path}/b", "csv", 4)
    assert len(list((tmp_path / "b").glob("*.csv"))) == 3
    writers.write_valid(frame.withColumn("is_valid", F.col("s").isNotNull()), f"file://{tmp_path}/good", f"file://{tmp_path}/bad")
    assert spark.read.json(f"file://{tmp_path}/good").count() == spark.read.json(f"file://{tmp_path}/bad").count() == 1


def test_report(spark, sf_dir):
    answers = fixtures.answers(spark, sf_dir)
    row = writers.report(evaluate.accuracy(answers, ["model"]).filter("difficulty_level = 'All'"), evaluate.counters(answers)).first()
    assert 0 < row.accuracy < 1 and set(json.loads(row.level_cnt_total)) == set(fixtures.LEVELS)


def test_increments(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    seen = []
    run = lambda: increments.run_available(increments.read_new_files(spark, f"file://{tmp_path}/in", events.schema, files=1), f"file://{tmp_path}/cp", increments.append_once(f"file://{tmp_path}/out"), lambda b, n: seen.append(n))
    assert run() == 3 == len(seen) and spark.read.parquet(f"file://{tmp_path}/out").count() == 1000
    events.limit(10).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert run() >= 1 and spark.read.parquet(f"file://{tmp_path}/out").count() == 1010
    mark = readers.high_water_mark(events.filter("event_id < 500"), "ts")
    assert readers.scan_table(events, incremental="ts", mark=mark, mode=">=").count() >= readers.scan_table(events, incremental="ts", mark=mark).count()
    increments.write_by_date(events, f"file://{tmp_path}/days", "ts")
    assert spark.read.parquet(f"file://{tmp_path}/days").count() == 1000


def test_streamed_windows_equal_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = increments.tumbling(increments.read_new_files(spark, f"file://{tmp_path}/in", events.schema), late="365 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = lambda f: sorted((str(r.window_start), r.event_type, r.n) for r in f.collect())
    assert rows(spark.table("windows")) == rows(increments.tumbling(events))
    assert increments.distinct_events(events.union(events)).count() == 1000
