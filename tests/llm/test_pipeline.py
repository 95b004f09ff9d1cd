import numpy as np
import pytest
import xxhash

from loomline.llm import common, crf, packing, rules, words

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.reread(spark, stage(spark, out[-1], D), name))
    return [f.toArrow().to_pylist() for f in out], [f.columns for f in out]


def test_columns(steps):
    assert all(c == steps[1][0] for c in steps[1][:5])


def test_filters(spark, steps):
    tables, _ = steps
    ids = [{r["doc_id"] for r in t} for t in tables]
    assert ids[4] <= ids[3] == ids[2] <= ids[1] <= ids[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    short = {r["doc_id"] for r in tables[0] if len(r["text"].split()) < 50}
    good = {d for d, q in labels.items() if q and d not in short}
    bad = {d for d, q in labels.items() if not q}
    assert len(good & ids[2]) >= 0.95 * len(good) and len(bad & ids[2]) <= 0.05 * len(bad)
    model = crf.fit(spark, spark.createDataFrame([(r["doc_id"], r["text"]) for r in tables[1]], "doc_id long, text string"), spark.read.parquet(f"{D}/labels.parquet"))
    assert ids[2] == {r["doc_id"] for r in tables[1] if model.scores([r["text"]])[0] >= 0.5}
    data = [r["text"].encode() for r in tables[1]]
    assert not any(c[-1] for c in rules.base_counts(data, *words.word_codes(data)))


def shingles(text):
    w = text.lower().split()
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}


def test_near_copies(steps):
    tables, _ = steps
    before = sorted(tables[3], key=lambda r: r["doc_id"])
    kept = {r["doc_id"] for r in tables[4]}
    sets = [shingles(r["text"]) for r in before]
    linked, wrong = {}, 0
    for i, a in enumerate(sets):
        for j in range(i):
            common_part = len(a & sets[j])
            if common_part and common_part / (len(a) + len(sets[j]) - common_part) >= 0.8:
                linked.setdefault(i, j)
    missed = sum(before[i]["doc_id"] in kept for i in linked)
    for i, r in enumerate(before):
        wrong += r["doc_id"] not in kept and max((len(sets[i] & s) / len(sets[i] | s) for j, s in enumerate(sets) if j != i), default=0) < 0.7
    print("near copies", len(linked), "missed", missed, "wrong", wrong)
    assert missed <= 0.02 * len(linked) and wrong == 0


def test_packing(steps):
    tables, _ = steps
    words = packing.word_encoder(common.tokenizer_path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(words.encode(r["text"])) // 4 + 1 for r in tables[4]}
    got = {}
    for p in tables[5]:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == want
    used = {}
    for p in tables[5]:
        used[p["sequence_id"]] = used.get(p["sequence_id"], 0) + p["length"]
    assert all(n <= 2048 and (n & (n - 1)) == 0 for n in used.values())
    assert np.array(list(used.values())).sum() == sum(want.values())


def test_run(spark, steps):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, D)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect())[0] and {r.doc_id for r in got.select("doc_id").distinct().collect()} == {p["doc_id"] for p in steps[0][5]}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, kept string, `a.b` int, score int"


def odd_rows():
    """Prose of two languages, and nulls, blank and long texts, copies, repeated rows and ids."""
    rng = np.random.default_rng(3)
    known = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(300)]
    prose = lambda n: "\n".join(" ".join(rng.choice(known, 12)) + "." for _ in range(n))
    rows = [(k, prose(8), ["en", "de", None][k % 3], "s", 1, "r", None, "x", k, None) for k in range(90)]
    add = lambda d, t, *rest: rows.append((d, t, "en", "s", None, "r", "f", None, None, 1))
    for d, t in [(100, None), (101, ""), (102, " \n\t"), (None, prose(8)), (None, rows[0][1]), (103, rows[0][1]), (103, rows[1][1]), (104, prose(3000)), (105, "one two"), (106, "x " * 200)]:
        add(d, t)
    return rows + [rows[5], rows[5], rows[-4]]


def test_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = odd_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    labels = [(k, int(k % 9 > 0)) for k in range(90)] + [(0, None), (None, 1), (1, 1), (1, 0), (7777, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name in ("quality_rules", "quality_classifier", "line_dedup", "near_dedup"):
        frame = stages[name](spark, docs, str(tmp_path))
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
        got[name] = frame.collect()
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    texts = lambda name: [(r.doc_id, r.text) for r in got[name]]
    assert not {100, 101, 102, 105, 106} & {d for d, _ in texts("quality_rules")} and texts("quality_rules").count((5, rows[5][1])) in (0, 3)
    assert sorted(map(str, [r.doc_id for r in got["line_dedup"]])) == sorted(str(r[0]) for r in rows)
    assert (100, None) in texts("line_dedup") and (103, "") in texts("line_dedup")
    near = texts("near_dedup")
    assert near.count((5, rows[5][1])) == 1 and (103, rows[0][1]) not in near and (103, rows[1][1]) not in near and sum(d is None for d, _ in near) == 2
    assert sum(not (t or "").strip() for _, t in near) == 1 and (100, None) in near
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(p.doc_tokens == 1 for p in packed) >= 3 and stages["packing"](spark, docs.limit(0), str(tmp_path)).count() == 0
