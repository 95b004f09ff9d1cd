"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. A line's evidence is a vector of its own measures beside those of the lines before and after
it; two neighbouring labels have a weight of their own. Forward-backward gives each line's probability of being good, and
the mean over lines, weighted by length, is the text's score.

Training: each line of a labelled document takes the document's label. At most ``SAMPLE`` labelled documents are used,
those with the smallest hash of their id, so the sample is spread evenly and the same at each run, and of each at most
``LINES`` lines that follow one another, from a place that its id's hash names; only their measures reach the driver, 125 MB
at most. The model is a fixed number of weights. Every text is scored whole, on its own partition; one of many lines by blocks
of them, for which some 40 bytes a line are held beside the text.

Rows: null and empty texts are one empty line; repeated rows get equal scores, and of rows that repeat an id the smallest text
trains; a null id is not held out; labels that are null are ignored and of several labels of an id the largest counts;
without a label of each kind the score is the share of good labels, or one half without any; other columns play no part.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import exp, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import narrow, small_batches

#: Labelled documents that training uses at most.
SAMPLE = 4000
#: Lines of a document that training uses at most.
LINES = 100
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
#: Bytes of a text whose lines are measured at once, and lines of all texts that are taken together.
SLICE, TOGETHER = 1 << 15, 1 << 14

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:?"
CODE = b"{}()[]=_\\/^~`@"
SPACES = b" \t\r\x0b\x0c"
WIDE = bytes(range(128, 256))
CLASSES = (UPPER, DIGITS, SYMBOLS, STOPS, CODE, b"!", SPACES, WIDE, b"-'\"")
N_MEASURES = 3 * len(CLASSES) + 12


def line_measures(line: bytes, repeated: bool) -> list[float]:
    """Measures of one line; shares are of its bytes or of its words."""
    size, words = len(line), line.split()
    n, out = len(words), []
    for group in CLASSES:
        share = (size - len(line.translate(None, group))) / size if size else 0.0
        out += [share, float(share > 0.02), float(share > 0.2)]
    different = len(set(words)) / n if n else 1.0
    again = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    letters = sum(map(len, words)) / n if n else 0.0
    marked = sum(w[-1] in SYMBOLS for w in words) / n if n else 0.0
    start, end = line[:1], line[-1:]
    return [*out, np.log1p(size), np.log1p(n), letters / 8, float(letters > 8), different, float(different < 0.5), again, marked, float(repeated), float(start in UPPER if start else 0), float(end in b".!?" if end else 0), float(not n)]


def line_blocks(data: bytes, size: int = 0) -> Iterator[list[bytes]]:
    """The lines of a text, in lists of some ``size`` bytes (``SLICE`` if 0)."""
    at = 0
    while True:
        end = data.find(b"\n", at + (size or SLICE))
        if end < 0:
            yield data[at:].split(b"\n")
            return
        yield data[at:end].split(b"\n")
        at = end + 1


def repeats(data: bytes) -> np.ndarray:
    """Whether each line of a text equals an earlier one, by 64-bit hashes: eight bytes a line are held, whatever lines hold."""
    codes = array("Q")
    for lines in line_blocks(data):
        codes.extend([xxhash.xxh3_64_intdigest(line) for line in lines])
    codes = np.frombuffer(codes, np.uint64)
    parts = 1 if len(codes) <= TOGETHER else 16  # of many, a sixteenth at a time is sorted
    part, again = codes.view(np.uint8)[::8] % parts, np.ones(len(codes), bool)
    for k in range(parts):
        at = np.flatnonzero(part == k)
        again[at[np.unique(codes[at], return_index=True)[1]]] = False
    return again


def block_measures(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, measures) and the lines' lengths of a text, block by block."""
    again, at = repeats(data), 0
    for lines in line_blocks(data):
        rows = np.empty((len(lines), N_MEASURES))
        for k, line in enumerate(lines):
            rows[k] = line_measures(line, bool(again[at + k]))
        at += len(lines)
        yield rows, np.array([len(x) + 1 for x in lines], np.float64)


def text_measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, measures) and the lines' lengths of a whole text, which has to be a short one."""
    rows, sizes = zip(*block_measures((text or "").encode()), strict=True)
    return np.concatenate(rows), np.concatenate(sizes)


def some_measures(text: str | None, place: int) -> np.ndarray:
    """Measures of at most ``LINES`` lines that follow one another, from a line that ``place`` names."""
    data = (text or "").encode()
    start, at, out = place % max(1, data.count(b"\n") + 2 - LINES), 0, []
    again = repeats(data)
    for lines in line_blocks(data):
        for k in range(max(at, start), min(at + len(lines), start + LINES)):
            out.append(line_measures(lines[k - at], bool(again[k])))
        at += len(lines)
        if at >= start + LINES:
            break
    return np.array(out, np.float64)


def with_neighbours(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's measures, those of the line before and after, flags for the first and last line, and one.

    ``starts``: first line of each text, and the end."""
    first, last = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    first[starts[:-1]], last[starts[1:] - 1] = True, True
    before, after = np.roll(rows, 1, axis=0), np.roll(rows, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([rows, before, after, first[:, None], last[:, None], np.ones((len(rows), 1))])


def forward_backward(gain: np.ndarray, starts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good per line, expected label pairs (2, 2), and the log partition function, summed over texts.

    ``gain``: score of good over bad per line; ``pair``: weight of (label, next label). Texts advance together, one line
    a step; those that have ended drop out.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[:-1][order], sizes[order]
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes.max(initial=0)))]
    forward, backward = np.zeros((len(gain), 2)), np.zeros((len(gain), 2))
    node = np.stack([np.zeros(len(gain)), gain], axis=1)
    for t, n in enumerate(active):
        at = begin[:n] + t
        if not t:
            forward[at] = node[at]
        else:
            past = forward[at - 1]
            forward[at] = node[at] + np.stack([np.logaddexp(past[:, 0] + pair[0, y], past[:, 1] + pair[1, y]) for y in (0, 1)], axis=1)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        at = begin[:n] + t
        ahead = node[at + 1] + backward[at + 1]
        backward[at] = np.stack([np.logaddexp(ahead[:, 0] + pair[y, 0], ahead[:, 1] + pair[y, 1]) for y in (0, 1)], axis=1)
    total = forward + backward
    norm = np.logaddexp(total[:, 0], total[:, 1])
    good = np.exp(total[:, 1] - norm)
    inner = np.ones(len(gain), bool)
    inner[starts[1:] - 1] = False
    at = np.flatnonzero(inner)
    for y in (0, 1):
        for z in (0, 1):
            pairs[y, z] = np.exp(forward[at, y] + pair[y, z] + node[at + 1, z] + backward[at + 1, z] - norm[at]).sum()
    return good, pairs, float(norm[starts[1:] - 1].sum())


def _step(r: float, a: float, b: float, c: float, d: float) -> float:
    """log((e^b + e^(d+r)) / (e^a + e^(c+r)))"""
    p, q = d + r - b, c + r - a
    return b - a + (p + log1p(exp(-p)) if p > 0 else log1p(exp(p))) - (q + log1p(exp(-q)) if q > 0 else log1p(exp(q)))


def chain_probabilities(gain: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability of good of every line of one text, as by ``forward_backward``; of a message only the odds are kept, so two
    numbers a line are held. They take the place of ``gain``."""
    (p00, p01), (p10, p11) = pair.tolist()
    total, r = gain, 0.0
    gains = array("d", gain.tobytes())
    for t, g in enumerate(gains):  # from the line before: good's odds
        r = g + (_step(r, p00, p01, p10, p11) if t else 0.0)
        total[t] = r
    r = 0.0
    for t in range(len(gains) - 2, -1, -1):
        r = _step(r + gains[t + 1], p00, p10, p01, p11)
        total[t] += r
    np.clip(total, -700, 700, out=total)
    np.negative(total, out=total)
    np.exp(total, out=total)
    total += 1
    return np.reciprocal(total, out=total)


@dataclass
class LineModel:
    """Weights of a trained field."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    prior: float | None = None

    def line_probabilities(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of good of every line of texts that follow one another."""
        if self.prior is not None:
            return np.full(len(rows), self.prior)
        gain = with_neighbours((rows - self.centre) / self.scale, starts) @ self.weights
        return forward_backward(gain, starts, self.pair)[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A text's score: the mean of its lines' probabilities, weighted by their lengths.

        Texts are taken together up to ``TOGETHER`` lines; one that has more is taken by blocks of lines."""
        out, group, lines = np.empty(len(texts)), [], 0
        for k, text in enumerate(texts):
            n = (text or "").count("\n") + 1
            if group and lines + n > TOGETHER:
                out[group] = self._scores([texts[x] for x in group])
                group, lines = [], 0
            if n > TOGETHER:
                out[k] = self._long(text.encode())
            else:
                group.append(k)
                lines += n
        if group:
            out[group] = self._scores([texts[x] for x in group])
        return np.clip(out, 0, 1)

    def _scores(self, texts: list[str | None]) -> np.ndarray:
        found = [text_measures(t) for t in texts]
        starts = np.cumsum([0, *(len(s) for _, s in found)])
        sizes = np.concatenate([s for _, s in found])
        good = self.line_probabilities(np.concatenate([r for r, _ in found]), starts)
        return np.add.reduceat(good * sizes, starts[:-1]) / np.add.reduceat(sizes, starts[:-1])

    def _long(self, data: bytes) -> float:
        """The score of one text of many lines."""
        if self.prior is not None:
            return self.prior
        gain, at, before, rows = np.empty(data.count(b"\n") + 1), 0, None, None
        for after, _ in chain(block_measures(data), [(None, None)]):
            if after is not None:
                after = (after - self.centre) / self.scale
            if rows is not None:
                # a line of each neighbouring block goes along and is left out again
                own = np.concatenate([x for x in (before, rows, None if after is None else after[:1]) if x is not None])
                skip = 0 if before is None else 1
                gain[at : at + len(rows)] = (with_neighbours(own, np.array([0, len(own)])) @ self.weights)[skip : skip + len(rows)]
                at, before = at + len(rows), rows[-1:]
            rows = after
        good, total, at = chain_probabilities(gain, self.pair), 0.0, 0
        for lines in line_blocks(data):
            total += good[at : at + len(lines)] @ np.array([len(x) + 1 for x in lines], np.float64)
            at += len(lines)
        return total / (len(data) + 1)


def objective(x: np.ndarray, labels: np.ndarray, starts: np.ndarray, weights: np.ndarray, pair: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood a line with a ridge, and its gradients."""
    good, pairs, norm = forward_backward(x @ weights, starts, pair)
    inner = np.ones(len(x), bool)
    inner[starts[1:] - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at], labels[at + 1]), 1)
    loss = (norm - (x @ weights)[labels == 1].sum() - (seen * pair).sum()) / len(x) + RIDGE * ((weights**2).sum() + (pair**2).sum())
    return loss, x.T @ (good - labels) / len(x) + 2 * RIDGE * weights, (pairs - seen) / len(x) + 2 * RIDGE * pair


def train(samples: list[tuple[np.ndarray, int]]) -> LineModel:
    """Fit by gradient steps with adaptive rates; ``samples``: (lines, measures) and label of each document."""
    kinds = {label for _, label in samples}
    if len(kinds) < 2:
        return LineModel(np.zeros(N_MEASURES), np.ones(N_MEASURES), np.zeros(3 * N_MEASURES + 3), np.zeros((2, 2)), float(next(iter(kinds), 0.5)))
    rows = np.concatenate([r for r, _ in samples])
    starts = np.cumsum([0, *(len(r) for r, _ in samples)])
    labels = np.concatenate([np.full(len(r), label) for r, label in samples])
    centre, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3)
    x = with_neighbours((rows - centre) / scale, starts)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, gw, gp = objective(x, labels, starts, theta[:-4], theta[-4:].reshape(2, 2))
        grad = np.concatenate([gw, gp.ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return LineModel(centre, scale, theta[:-4], theta[-4:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineModel:
    """Train on labelled rows of ``docs`` that are not held out."""
    usable = narrow(labels, doc_id="long", quality="int").filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for text, place in zip(batch.column("text"), batch.column("place").to_pylist(), strict=True):
                data.append(some_measures(text.as_py(), place).tobytes())
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(data, pa.binary())], ["doc_id", "quality", "data"])

    # ``chosen`` has at most ``sample`` rows of two numbers, so every task can hold it
    found = narrow(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = found.withColumn("place", F.crc32(F.col("doc_id").cast("string").cast("binary"))).mapInArrow(run, "doc_id long, quality int, data binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([(np.frombuffer(r.data).reshape(-1, N_MEASURES), r.quality) for r in rows])


def _scored(spark: SparkSession, docs: DataFrame, model: LineModel) -> DataFrame:
    """``doc`` (all columns of ``docs``) and ``score``."""
    boxed = docs.select(F.struct(*[docs[f"`{name}`"] for name in docs.columns]).alias("doc"))
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                doc = batch.column("doc").slice(at, 500)
                texts = doc.field("text").to_pylist()
                yield pa.record_batch([doc, pa.array(sent.value.scores(texts))], ["doc", "score"])

    return boxed.mapInArrow(run, T.StructType([boxed.schema["doc"], T.StructField("score", T.DoubleType())]))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = _scored(spark, narrow(docs, doc_id="long", text="string"), fit(spark, docs, labels))
    return scored.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score below one half."""
    return _scored(spark, docs, fit(spark, docs, labels)).filter("score >= 0.5").select("doc.*")
