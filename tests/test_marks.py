from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomline.plans import runner
from loomline.plans.registry import Pipeline, Registry
from loomline.sources import readers, writers
from loomline.sources.marks import Conflict, Marks

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(autouse=True)
def quiet(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")


@pytest.fixture
def store(spark, tmp_path):
    return Marks(spark, f"file://{tmp_path}/loads of % ü")


def rows(frame):
    return sorted(map(tuple, frame.drop("version").collect()), key=repr)


FIRST = [(1, "a"), (2, "b"), (2, "b"), (None, "none")]
THEN = [*FIRST, (2, "b"), (2, "c"), (1, "late"), (5, "d")]


def frame(spark, data):
    return spark.createDataFrame(data, "k int, v string")


def test_two_runs_read_only_what_is_new(spark, store):
    assert store.read("p") is None and store.latest("p") is None
    assert rows(store.load("p", frame(spark, FIRST), "k")) == sorted(FIRST, key=repr)
    assert rows(store.load("p", frame(spark, THEN), "k")) == [(5, "d")]
    assert store.load("p", frame(spark, THEN), "k") is None
    assert [(x.version, x.mark, x.rows) for x in store.loads("p")] == [(0, "2", 4), (1, "5", 1)]
    assert rows(store.read("p", 1)) == [(5, "d")] and store.read("p").count() == 5


def test_at_the_mark_no_row_comes_twice(spark, store):
    store.load("p", frame(spark, FIRST), "k", ">=")
    assert rows(store.load("p", frame(spark, [*FIRST, (2, "b"), (2, "c"), (1, "late")]), "k", ">=")) == [(2, "b"), (2, "c")]
    assert rows(store.load("p", frame(spark, [*THEN, (2, "b")]), "k", ">=")) == [(2, "b"), (5, "d")]
    assert store.load("p", frame(spark, [*THEN, (2, "b")]), "k", ">=") is None
    assert rows(store.read("p")) == sorted([x for x in [*THEN, (2, "b")] if x != (1, "late")], key=repr)


@pytest.mark.parametrize("mode", [">", ">="])
def test_crash_before_the_commit_loses_and_repeats_nothing(spark, store, mode, monkeypatch):
    store.load("p", frame(spark, FIRST), "k", mode)
    with monkeypatch.context() as m:
        m.setattr(Marks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.load("p", frame(spark, THEN), "k", mode)
    assert rows(store.read("p")) == sorted(FIRST, key=repr) and store.latest("p").version == 0
    store.load("p", frame(spark, [*THEN, (9, "e")]), "k", mode)
    want = [*FIRST, (5, "d"), (9, "e")] + ([(2, "b"), (2, "c")] if mode == ">=" else [])
    assert rows(store.read("p")) == sorted(want, key=repr)
    assert store.vacuum("p") == 1 and store.vacuum("p") == 0 and store.read("p").count() == len(want)


def test_one_of_two_loads_wins(spark, store, monkeypatch):
    commit = Marks._commit

    def late(self, name, load):
        monkeypatch.setattr(Marks, "_commit", commit)
        self.load(name, frame(spark, FIRST), "k")
        commit(self, name, load)

    monkeypatch.setattr(Marks, "_commit", late)
    with pytest.raises(Conflict):
        store.load("p", frame(spark, FIRST), "k")
    assert rows(store.read("p")) == sorted(FIRST, key=repr) and len(store.loads("p")) == 1


@pytest.mark.parametrize("kind, values", [("timestamp", [datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1, 0, 0, 0, 2)]), ("timestamp_ntz", [datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1, 0, 0, 0, 2)]), ("date", [datetime(2024, 1, 1).date(), datetime(2024, 1, 2).date()]), ("double", [0.1, 0.30000000000000004]), ("string", ["a", "é'"]), ("decimal(38,2)", None)])
def test_marks_of_every_type(spark, store, kind, values):
    made = lambda some: spark.createDataFrame([(v,) for v in some], f"k {kind}") if values else spark.createDataFrame([(v,) for v in some], "k string").select(F.col("k").cast(kind).alias("k"))
    one, two = values or ["1.01", "99999999999999999999999999.02"]
    store.load("p", made([one]), "k")
    assert store.load("p", made([one, two]), "k").count() == 1 and store.load("p", made([one, two]), "k") is None
    with pytest.raises(ValueError):
        store.load("p", made([one]).withColumnRenamed("k", "other"), "other")


def test_nothing_and_odd_names(spark, store):
    assert store.load("p", frame(spark, []), "k") is None and store.read("p") is None
    odd = spark.createDataFrame([(None, 1)], "`a.b` int, version_of int")
    assert store.load("p", odd, "a.b").count() == 1 and store.latest("p").mark is None


def test_pages_of_a_database(spark):
    url = "jdbc:derby:memory:pages;create=true"
    data = spark.createDataFrame([(k % 40 if k else None, f"v{k}") for k in range(500)], "K int, V string")
    writers.write_jdbc(data, url, "t", driver=DRIVER, createTableColumnTypes="K INT, V VARCHAR(20)")
    got = readers.jdbc_pages(spark, url, "SELECT k, v FROM t WHERE v <> 'v3'", "k desc, v", 100, driver=DRIVER)
    assert got.rdd.getNumPartitions() == 5
    assert rows(got) == rows(data.filter("v <> 'v3'"))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 125
    assert readers.jdbc_pages(spark, url, "SELECT k FROM t", "k", 1000, driver=DRIVER).rdd.getNumPartitions() == 1
    words = readers.jdbc_pages(spark, url, "SELECT k, v FROM t", "v", 200, driver=DRIVER)
    assert rows(words) == rows(data) and words.rdd.getNumPartitions() == 3


def test_pipelines_from_and_to_a_database(spark, store, tmp_path, monkeypatch):
    url, options = "jdbc:derby:memory:lines;create=true", {"driver": DRIVER}
    add = lambda some: writers.write_jdbc(spark.createDataFrame(some, "K int, V string"), url, "src", **options)
    add([(k, f"v{k}") for k in range(10)])
    r = Registry(spark)
    r.add_conn("db", "sqlServer", {"dsn": url})
    r.add_conn("out", "clickHouse", {"dsn": url})
    r.add_ext("lines", "sqlServer", {"table": "src", "batchSize": 4, "orderSql": "k", "incrementalField": "K", "options": options}, ["db"])
    r.add_loader("table", "clickHouse", {"table": "dst", "batchSize": 100, "options": options}, ["out"])
    r.add_loader("files", "huggingFace", {"folder": "named", "root": f"file://{tmp_path}", "batchSize": 3})
    r.add_loader("folder", "local", {"folder": f"file://{tmp_path}/plain"})
    r.add_pipeline(Pipeline("p", "lines", "table", transform_sql="select K, upper(V) as V from data where k <> 3"))
    r.add_pipeline(Pipeline("named", "lines", "files"))
    r.add_pipeline(Pipeline("plain", "lines", "folder", incremental_mode=">="))
    target = lambda: sorted((x.K, x.V, x.etl_version) for x in readers.jdbc_table(spark, url, "SELECT * FROM dst", **options).collect())
    assert runner.run_pipeline(spark, r, "p", marks=store).count() == 9
    first = [(k, f"V{k}", 0) for k in range(10) if k != 3]
    assert target() == first
    assert runner.run_pipeline(spark, r, "p", marks=store) is None
    add([(20, "x"), (21, "y")])
    with monkeypatch.context() as m:
        m.setattr(Marks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            runner.run_pipeline(spark, r, "p", marks=store)
    add([(22, "z")])
    assert runner.run_pipeline(spark, r, "p", marks=store).count() == 3
    assert target() == first + [(20, "X", 1), (21, "Y", 1), (22, "Z", 1)] and store.latest("p").mark == "22"
    runner.run_pipeline(spark, r, "named", marks=store)
    add([(30, "n")])
    runner.run_pipeline(spark, r, "named", marks=store)
    names = sorted(p.name for p in (tmp_path / "named").iterdir() if p.name.endswith(".json"))
    assert len(names) == 6 and {n.rsplit("_", 1)[0] for n in names} == {f"ETL_named_IV_{x}" for x in ("", 2, 5, 8, 21, 22)}
    add([(k, "late") for k in range(40, 47)])
    with monkeypatch.context() as m:
        m.setattr(Marks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            runner.run_pipeline(spark, r, "named", marks=store)
    add([(39, "later")])
    runner.run_pipeline(spark, r, "named", marks=store)
    assert sorted(x.K for x in spark.read.json(f"file://{tmp_path}/named/*.json").collect()) == sorted([*range(10), 20, 21, 22, 30, 39, *range(40, 47)])
    assert runner.run_pipeline(spark, r, "plain", marks=store).count() == 22
    assert sorted(x.K for x in spark.read.parquet(f"file://{tmp_path}/plain").collect()) == sorted([*range(10), 20, 21, 22, 30, 39, *range(40, 47)])
    r.add_ext("bare", "postgres", {"table": "src"}, ["db"])
    r.add_pipeline(Pipeline("bare", "bare", "folder"))
    with pytest.raises(ValueError):
        runner.run_pipeline(spark, r, "bare", marks=store)
    r.add_loader("lost", "clickHouse", {"table": "dst"})
    r.add_pipeline(Pipeline("lost", "lines", "lost"))
    with pytest.raises(ValueError):
        runner.run_pipeline(spark, r, "lost")
