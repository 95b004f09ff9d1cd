import zlib
from itertools import product

import numpy as np
import pytest

from loomline.llm import crf


def enumerate_all(gain, pair):
    weights = {}
    for ys in product((0, 1), repeat=len(gain)):
        weights[ys] = np.exp(sum(g * y for g, y in zip(gain, ys)) + sum(pair[a, b] for a, b in zip(ys, ys[1:])))
    z = sum(weights.values())
    good = [sum(w for ys, w in weights.items() if ys[k]) / z for k in range(len(gain))]
    pairs = np.zeros((2, 2))
    for ys, w in weights.items():
        for a, b in zip(ys, ys[1:]):
            pairs[a, b] += w / z
    return good, pairs, np.log(z)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = [3, 1, 6, 4, 1]
    starts = np.cumsum([0, *sizes])
    gain, pair = rng.normal(size=starts[-1]) * 2, rng.normal(size=(2, 2))
    good, pairs, norm = crf.forward_backward(gain, starts, pair)
    want = [enumerate_all(gain[a:b], pair) for a, b in zip(starts, starts[1:])]
    assert good == pytest.approx(np.concatenate([w[0] for w in want]))
    assert pairs == pytest.approx(sum(w[1] for w in want))
    assert norm == pytest.approx(sum(w[2] for w in want))


def test_gradient():
    rng = np.random.default_rng(2)
    starts = np.array([0, 4, 5, 11])
    x, labels = rng.normal(size=(11, 3)), rng.integers(0, 2, 11)
    theta = rng.normal(size=7)
    f = lambda t: crf.objective(x, labels, starts, t[:3], t[3:].reshape(2, 2))
    _, gw, gp = f(theta)
    for k, g in enumerate([*gw, *gp.ravel()]):
        step = np.zeros(7)
        step[k] = 1e-5
        assert (f(theta + step)[0] - f(theta - step)[0]) / 2e-5 == pytest.approx(g, abs=1e-6)


def test_neighbours_stay_inside_a_text():
    rows = np.arange(6.0).reshape(3, 2) + 1
    got = crf.with_neighbours(rows, np.array([0, 1, 3]))
    assert got[0].tolist() == [1, 2, 0, 0, 0, 0, 1, 1, 1]
    assert got[1].tolist() == [3, 4, 0, 0, 5, 6, 1, 0, 1] and got[2].tolist() == [5, 6, 3, 4, 0, 0, 0, 1, 1]


def _model(seed=4):
    rng = np.random.default_rng(seed)
    n = crf.N_MEASURES
    return crf.LineModel(rng.normal(size=n), rng.random(n) + 0.5, rng.normal(size=3 * n + 3) / 4, rng.normal(size=(2, 2)))


LONG = ["", "\n", "\n\n\n", "a\nb\na\n", "one line", "x y z\n" * 50 + "é!", "\n".join(f"line {i % 7} of it {'#' * (i % 5)}" for i in range(300))]


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 15])
def test_long_texts_by_blocks(monkeypatch, size):
    model = _model()
    want = model.scores(LONG)
    monkeypatch.setattr(crf, "SLICE", size)
    for text, score in zip(LONG, want, strict=True):
        assert model._long(text.encode()) == pytest.approx(score, abs=1e-12)
        assert [x for b in crf.line_blocks(text.encode()) for x in b] == text.encode().split(b"\n")
    monkeypatch.setattr(crf, "TOGETHER", 3)
    assert model.scores([*LONG, None, *LONG]) == pytest.approx([*want, want[0], *want], abs=1e-12)


def test_repeats():
    lines = ["", "a", "b", "a", "", "c", "b"] * 3
    seen = set()
    want = [x in seen or seen.add(x) or False for x in lines]
    assert crf.repeats("\n".join(lines).encode()).tolist() == want


def test_odds_of_extreme_gains():
    gain = np.array([900.0, -900.0, 0.0, 900.0, -2.0])
    pair = np.array([[2.0, -3.0], [-50.0, 4.0]])
    want = crf.forward_backward(gain, np.array([0, 5]), pair)[0]
    assert crf.chain_probabilities(gain.copy(), pair) == pytest.approx(want, abs=1e-12)


def test_memory_of_a_long_text():
    """600,000 short lines: what they take beside the text grows by some 40 bytes a line."""
    import subprocess
    import sys

    code = """
import resource
from tests.llm.test_crf import _model
model, text = _model(), "".join(f"{i % 1000}\\n" for i in range(600_000))
model.scores(["a"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.scores([text])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert grown < 100_000


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    wanted = {r.doc_id: r.quality for r in labels.collect()}
    sample = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = crf.classify(spark, sample, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out]
    right = sum(r.predicted == wanted[r.doc_id] for r in out) / len(out)
    good = [r.score for r in out if wanted[r.doc_id]]
    bad = [r.score for r in out if not wanted[r.doc_id]]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    print("held out", len(out), "accuracy", right, "auc", auc)
    assert right > 0.95 and auc > 0.97


def test_rows(spark):
    rows = [(1, "fine words here.\nand more of them.", 1), (2, "BAD!! BAD!! BAD!!\nBAD!! BAD!!", 1), (3, None, 1), (4, "", 1), (None, "fine", 1), (3, None, 1), (5, "a\n" * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = crf.classify(spark, docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert {r.score for r in crf.classify(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert crf.classify(spark, docs.limit(0), labels).count() == 0
    kept = crf.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns


def test_long_text_equals_its_lines():
    model = crf.train([(crf.text_measures("good words are here.\nyes they are.")[0], 1), (crf.text_measures("X!! X!! X!!\nX!!")[0], 0)])
    texts = ["a b c.\n" * 500, "", None, "X!! X!!", "one line"]
    assert model.scores(texts) == pytest.approx([model.scores([t])[0] for t in texts])


def test_query_scores_against_enumeration(spark, tmp_path):
    """Scores of the registered query: all labellings of short texts, weighted by the trained weights, and line lengths."""
    from loomline.llm import catalog

    rng = np.random.default_rng(4)
    good, bad = ["fine words here.", "and so it goes on,", "to the end."], ["BAD!! BAD!!", "### $$$ ###", "x x x x x x"]
    rows = [(k, "\n".join(rng.choice(good if k % 2 else bad, rng.integers(1, 8)).tolist() + ["same line"] * (k % 3 == 0))) for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in catalog.op10_line_crf(spark, str(tmp_path)).collect()}
    model = crf.fit(spark, docs, labels)
    for d, text in [*rows, (100, "")]:
        measures, sizes = crf.text_measures(text)
        gain = crf.with_neighbours((measures - model.centre) / model.scale, np.array([0, len(measures)])) @ model.weights
        marginals, _, _ = enumerate_all(gain, model.pair)
        assert got[d].score == pytest.approx(np.dot(marginals, sizes) / sizes.sum(), abs=1e-9)
        assert got[d].predicted == (got[d].score >= 0.5) and got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_fit_is_bounded(spark, monkeypatch):
    """Long texts, and rows that repeat an id, add no more than ``LINES`` lines a document."""
    seen = []
    train = crf.train
    monkeypatch.setattr(crf, "train", lambda samples: seen.extend(len(r) for r, _ in samples) or train(samples))
    docs = spark.createDataFrame([(k % 7, "\n".join(f"line {i}" for i in range(k * 40))) for k in range(70)], "doc_id long, text string")
    crf.fit(spark, docs, spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int"))
    assert 0 < len(seen) <= 7 and max(seen) <= crf.LINES
