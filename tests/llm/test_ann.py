import numpy as np
import pytest

from loomline.llm import ann


def brute(rows, nearest=10, every=100):
    dims = [len(v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
    queries = {}
    for i, v in sound:
        if i % every == 0:
            queries[i] = min(queries.get(i, tuple(v)), tuple(v))
    out = {}
    for q, x in queries.items():
        far = {}
        for i, v in sound:
            if i != q:
                far[i] = min(far.get(i, np.inf), float(np.sqrt(((v - x) ** 2).sum())))
        out[q] = sorted((d, i) for i, d in far.items())[:nearest]
    return out


def test_hadamard_is_the_matrix():
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert ann.hadamard(x) == pytest.approx(x @ h / 4)


def test_rotation_is_the_rounds():
    index = ann.CrossPolytope(13, 2, 1)
    x = np.random.default_rng(2).normal(size=(40, 13))
    assert index.turned(x, 1, 0) == pytest.approx(np.concatenate([index.turned(x[k : k + 9], 1, 0) for k in range(0, 40, 9)]))
    assert np.linalg.norm(index.turned(x, 0, 0), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))


def test_best_probes():
    """The probes are the best of all combinations of axes."""
    index = ann.CrossPolytope(8, 1, 2)
    x = np.random.default_rng(4).normal(size=(30, 8))
    lost = []
    for k in range(2):
        y = np.stack([index.turned(x, 0, k), -index.turned(x, 0, k)], axis=2).reshape(30, -1)
        lost.append(y.max(axis=1, keepdims=True) - y)
    total = (lost[0][:, :, None] ** 2 + lost[1][:, None, :] ** 2).reshape(30, -1)
    got = np.take_along_axis(total, index.probes(x, 0, 12), 1)
    assert got == pytest.approx(np.sort(total, axis=1)[:, :12])


@pytest.mark.parametrize("hashes", [1, 2])
def test_first_probe_is_the_own_bucket(hashes):
    index = ann.CrossPolytope(13, 3, hashes)
    x = np.random.default_rng(1).normal(size=(50, 13))
    for t in range(3):
        probes = index.probes(x, t, 6)
        assert (probes[:, 0] == index.buckets(x, t)).all()
        assert all(len(set(p)) == 6 for p in probes.tolist())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = ann.search(spark, vectors).collect()
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    found = 0
    for q, near in want.items():
        rows = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11)) and [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        exact = {i: d for d, i in near}
        found += len({r.vec_id for r in rows} & set(exact))
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in rows if r.vec_id in exact)
    recall = found / sum(map(len, want.values()))
    print(sf, "recall", recall)
    assert recall >= 0.9


def test_candidates_are_few(spark, monkeypatch):
    """On sf0.1 the index names well below a tenth of the vectors, in one pass over them."""
    tables, filed = {}, []
    keep, file = ann.reread, ann._filed
    monkeypatch.setattr(ann, "reread", lambda s, frame, label: tables.setdefault(label, keep(s, frame, label)))
    monkeypatch.setattr(ann, "_filed", lambda rows, name, *a: filed.append(name) or file(rows, name, *a))
    ann.search(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()
    share = tables["candidates"].count() / tables["asked"].count() / tables["vectors"].count()
    print("share of candidates", share)
    assert share < 0.085 and filed == ["vid", "query_id"] and tables["short"].count() == 0
    assert tables["index"].count() == 64 * tables["vectors"].count()


def test_settings_follow_the_number_of_vectors():
    found = [ann.settings(n, 64)[0] for n in (10, 10**4, 10**6, 10**8, 10**10)]
    assert found == sorted(found) and found[0] == 1 and found[-1] >= 4


def test_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(205)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (400, None), (401, [0.0] * 8), (402, [1.0] * 7 + [None]), (403, [1.0] * 7 + [float("nan")]), (404, [float("inf")] + [1.0] * 7), (500, [1.0, 2.0]), (None, rows[1][1]), (100, rows[5][1]), (7, rows[0][1]), (501, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string").repartition(4)
    want = brute(rows)
    full = sorted((q, k + 1, i) for q, near in want.items() for k, (_, i) in enumerate(near))
    for chosen in ((1, 30, 16, 1), (2, 1, 1, 1)):
        got = ann.search(spark, frame, chosen=chosen, block=2)
        found = sorted((r.query_id, r.rank, r.vec_id) for r in got.collect())
        if chosen[1] == 30:
            assert found == full
        assert {q: sum(x[0] == q for x in found) for q in want} == {q: len(near) for q, near in want.items()}
    got = ann.search(spark, frame)
    assert [r.vec_id for r in got.filter("query_id = 0 and rank <= 3").orderBy("rank").collect()] == [7, 300, 301]
    assert ann.search(spark, frame.limit(0)).count() == 0
    assert ann.search(spark, frame.filter("vec_id in (1, 2)")).count() == 0
    assert [r.vec_id for r in ann.search(spark, frame.filter("vec_id in (0, 300)")).filter("query_id = 0").collect()] == [300]


def test_small_and_repeated_tables(spark):
    """With the settings in use: all candidates where there are few, and any number of copies of one vector."""
    rng = np.random.default_rng(5)
    rows = [(k * 100, rng.normal(size=64).tolist()) for k in range(6)]
    got = ann.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = brute(rows)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == sorted((q, k + 1, i) for q, near in want.items() for k, (_, i) in enumerate(near))
    copies = [(k, rows[0][1]) for k in range(1, 400)] + rows
    found = ann.search(spark, spark.createDataFrame(copies, "vec_id long, embedding array<double>").repartition(5)).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == 0) == [(k, k, 0.0) for k in range(1, 11)]
    assert all(sum(r.query_id == q for r in found) == 10 for q in range(0, 600, 100))
    many = [(7, (np.array(rows[0][1]) + rng.normal(size=64) / 100).tolist()) for _ in range(60)] + rows
    got = ann.search(spark, spark.createDataFrame(many, "vec_id long, embedding array<double>"))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == sorted((q, k + 1, i) for q, near in brute(many).items() for k, (_, i) in enumerate(near))


@pytest.mark.parametrize("axes, hashes, count", [(1, 3, 5), (6, 1, 4), (8, 2, 16), (5, 3, 20), (3, 4, 64)])
def test_choices_hold_every_smallest_sum(axes, hashes, count):
    from itertools import product

    got = ann.choices(axes, hashes, count)
    assert got == [c for c in product(range(axes), repeat=hashes) if np.prod(np.add(c, 1)) <= count]
    rng = np.random.default_rng(3)
    for _ in range(20):
        lists = np.sort(rng.random((hashes, axes)), axis=1)
        cost = lambda c: sum(lists[k][x] for k, x in enumerate(c))
        assert set(sorted(product(range(axes), repeat=hashes), key=cost)[:count]) <= set(got)


def test_probes_do_not_pass_the_driver(spark, monkeypatch):
    """Probes and candidates are merged with the index, however small the queries' file; only bounded queries are broadcast."""
    plans, keep = {}, ann.reread
    monkeypatch.setattr(ann, "reread", lambda s, frame, label: plans.setdefault(label, frame._jdf.queryExecution().executedPlan().toString()) and keep(s, frame, label))
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = [ann.search(spark, rows).collect()]
    assert "Broadcast" not in plans["candidates"] and "SortMergeJoin" in plans["candidates"]
    plans.clear()
    monkeypatch.setattr(ann, "FEW", 0)
    found.append(ann.search(spark, rows).collect())
    assert plans["nearest"].count("BroadcastExchange") == 0 and sorted(found[0]) == sorted(found[1])
