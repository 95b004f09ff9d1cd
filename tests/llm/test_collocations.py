import random
import re
from collections import Counter

import duckdb
import pytest

from loomline.llm import collocations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, words=3, least=10, held=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UP, LOW))):
            said = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(said)
            for k in range(1, words + 1):
                f.update((lang, tuple(said[i : i + k])) for i in range(len(said) - k + 1))
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = []
    for (lang, phrase), a in candidates.items():
        if any(x == lang and len(b) > len(phrase) and 100 * v >= held * a and inside(phrase, b) for (x, b), v in candidates.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k, f[lang, phrase[:k]], f[lang, phrase[k:]]) for k in range(1, len(phrase)))
        out.append((lang, -score, -a, " ".join(phrase).encode(), left, right))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(k, *r, 7, "x") for k, r in enumerate(rows)], "doc_id long, lang string, text string, `left` int, word string")
    return sorted(tuple(r) for r in collocations.collocations(spark, docs, **kw).collect())


def said(seed, n=4000, vocabulary=18):
    rng = random.Random(seed)
    return "".join(rng.choice(LOW[:vocabulary]) * rng.choice([1, 1, 2]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(n))


ODD = [("en", said(1)), ("en", said(1)), ("de", said(2, vocabulary=5)), (None, "Été À la Carte " * 20), ("und", "été À la carte;été"), ("en", None), ("en", ""), ("fr", " \t.,;\n"), ("en", "A b x\x00y " * 15), ("zz", "solo " * 40), ("ko", "하나 둘 셋. " * 12)]


def test_odd_rows(spark):
    assert got(spark, ODD) == sorted(brute(ODD))


def test_longer_phrases_small_blocks_and_slices(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, "lang string, text string")
    whole = collocations.collocations(spark, docs, words=4, least=5, held=70, top=50)
    rows = sorted(tuple(r) for r in whole.collect())
    assert rows == sorted(brute(ODD, 4, 5, 70, 50))
    assert collocations.blocks_of(docs.selectExpr("coalesce(lang, 'und') as lang", "cast(text as binary) as text"), 300).select("block").distinct().count() > 3
    for size in (1, 7, 1000):
        text = ODD[0][1].encode() + ("한국" * 400).encode()
        parts = list(collocations.slices(text, size))
        assert b"".join(parts) == text
        assert [w for p in parts for w in collocations._PARTS.findall(p) if w[0] not in collocations._ENDS] == [w for w in collocations._PARTS.findall(text) if w[0] not in collocations._ENDS]


def test_names_are_the_same_in_every_block(spark):
    docs = spark.createDataFrame(ODD, "lang string, text string").selectExpr("coalesce(lang, 'und') as lang", "cast(text as binary) as text")
    grams = collocations._kept(spark, collocations.blocks_of(docs, 200), "blocks")
    names = collocations.named(grams.filter("word is not null"), ["lang", "word"], 10)
    by = {}
    for r in names.collect():
        by.setdefault((r.lang, bytes(r.word)), set()).add((r.id, r.f))
    assert by and all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x, _ in v}) == len(by)


def test_counts_beyond_64_bits(spark):
    a = 3_000_000_000
    frame = spark.createDataFrame([(a, [4 * a, a], [a, a])], "f long, heads array<long>, tails array<long>")
    (cut,) = frame.select(collocations._cut(2).alias("cut")).first()
    assert (cut.score, cut.k, cut.l, cut.r) == (1_000_000 * a * a // (4 * a * a), 1, 4 * a, a)
    frame = spark.createDataFrame([(10**12 - 7, [10**12, 0], [10**12 + 3, 0])], "f long, heads array<long>, tails array<long>")
    assert frame.select(collocations._cut(2).alias("cut")).first().cut.score == 1_000_000 * (10**12 - 7) ** 2 // (10**12 * (10**12 + 3))


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", None), (None, "a b")]) == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    found = duck.execute(collocations.ORACLE)
    names = [x[0] for x in found.description]
    frame = collocations.collocations(spark, spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    assert frame.columns == names
    assert sorted(tuple(r) for r in frame.collect()) == sorted(found.fetchall())
