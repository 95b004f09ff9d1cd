import random
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import packing
from loomline.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def as_ids(n: int, seed: int = 0) -> bytes:
    return np.random.default_rng(seed).integers(0, 49000, n).astype("<u4").tobytes()


def check(docs: dict, pieces: list, capacity: int) -> int:
    """Every id in one piece, gapless sequences; returns the padding."""
    by_doc, by_seq = {}, {}
    for d, start, length, crc, total, seq, offset in pieces:
        by_doc.setdefault(d, []).append((start, length))
        by_seq.setdefault(seq, []).append((offset, length))
        assert crc == zlib.crc32(docs[d][start * 4 : (start + length) * 4]) and total == len(docs[d]) // 4 and length > 0
    for d, ids in docs.items():
        at = 0
        for start, length in sorted(by_doc.get(d, [])):
            assert start == at
            at += length
        assert at == len(ids) // 4
    padding = 0
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fill_is_best(counts, room):
    used = packing.best_fill(counts, room)
    assert all(n <= counts[k] for k, n in used.items())
    best = max((s for n in product(*[range(v + 1) for v in counts.values()]) if (s := sum(a * b for a, b in zip(n, counts))) <= room), default=0)
    assert sum(k * n for k, n in used.items()) == best


@pytest.mark.parametrize("block", [500, 10**9])
def test_stream(block):
    rng = random.Random(5)
    docs = {i: as_ids(rng.choice([1, 5, 63, 64, 65, 100, rng.randint(1, 400)]), i) for i in range(700)}
    pieces = [p for x in packing.pack_stream(docs.items(), 0, 64, block) for p in x]
    assert check(docs, pieces, 64) == 0


@pytest.mark.parametrize("length", [33, 40, 43, 63])
def test_equal_lengths_take_linear_time(length, monkeypatch):
    """No pattern fills a window, and still a block is gone over once: a call of ``pack`` for each half block."""
    calls, filled = [], packing.fill_windows
    monkeypatch.setattr(packing, "fill_windows", lambda *a: calls.append(1) or filled(*a))
    docs = {i: as_ids(length, i) for i in range(3000)}
    pieces = [p for x in packing.pack_stream(docs.items(), 0, 64, 6400) for p in x]
    assert check(docs, pieces, 64) == 0
    assert len(calls) <= 3000 * length / 3200 + 2
    # the first piece of a window is still whole in most: patterns stay, slack alone is cut
    whole = sum(p[2] == length for p in pieces)
    assert whole >= 3000 * length // 64 * 0.9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40))
def test_any_lengths(lengths):
    docs = {i: as_ids(n, i) for i, n in enumerate(lengths)}
    assert check(docs, [p for x in packing.pack_stream(docs.items(), 0, 16) for p in x], 16) == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'!ABlstré\xa0\x1c <|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_like_the_library(text):
    e = packing.word_encoder(PATH)
    for x in (text, f"{text} <|endoftext|>a", "don't 'LL X́ Ⅷ"):
        assert np.frombuffer(e.encode(x), "<u4").tolist() == e.library.encode(x, add_special_tokens=False).ids


def test_query(spark, sf_dir):
    from loomline.llm import catalog

    words = packing.word_encoder(PATH)
    got = catalog.QUERIES["op8_minimum_bin_slack"](spark, sf_dir).collect()
    end = np.array([1], "<u4").tobytes()
    ids_of = lambda t: np.array(words.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() + end
    docs = {d: ids_of(t) for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert check(docs, [tuple(r) for r in got], 2048) == 0
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x " * 9000, 5)], "doc_id long, text string, length int")
    pieces = [tuple(r) for r in packing.pack_documents(odd.repartition(1)).collect()]
    assert check({1: end, 2: end, 3: words.encode("x " * 9000) + end}, pieces, 2048) == 0
    assert packing.pack_documents(odd.limit(0)).count() == 0
    # null ids and repeated rows: every row's ids are there, each in one piece
    rows = [(None, "one two"), (None, "three"), (7, "four five six"), (7, "four five six"), (7, "seven")]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    of = lambda d: sum(p.length for p in pieces if p.doc_id == d)
    sizes = {t: len(ids_of(t)) // 4 for _, t in rows}
    assert of(None) == sizes["one two"] + sizes["three"] and of(7) == 2 * sizes["four five six"] + sizes["seven"]
    assert sorted(p.doc_tokens for p in pieces if p.start == 0) == sorted(sizes[t] for _, t in rows)
