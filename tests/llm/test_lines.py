import random

import pytest

from loomline.llm import lines


def brute(rows):
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows if t is not None}, key=lambda r: (r[0], r[1]))
    seen, result = set(), {}
    for none, d, t in docs:
        parts = t.split("\n")
        covered = set()
        for k in range(len(parts) - 2):
            w = tuple(parts[k : k + 3])
            if not "".join(w).strip(" \t\n\r\x0b\x0c"):
                continue
            if w in seen:
                covered |= {k, k + 1, k + 2}
            seen.add(w)
        result[none, d, t] = ("\n".join(x for k, x in enumerate(parts) if k not in covered), len(parts), len(covered))
    return sorted(((d, *(result[d is None, d or 0, t] if t is not None else (None, 0, 0))) for d, t in rows), key=str)


def corpus():
    rng = random.Random(2)
    pool = [f"line {k} of a text" for k in range(12)] + ["", " ", "é\r"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(80)]
    block = "\n".join(f"passage {k} " + "word " * 30 for k in range(5))
    rows += [(100 + k, f"own start {k}\n{block}\nown end {k}") for k in range(4)]
    return rows + [(200, None), (201, ""), (202, "a\na\na\na\na"), (203, "\n\n\n\n"), (204, "\n \n\n"), (205, "x\ny\nz\n" * 3000), rows[3], rows[100 - 30]]


@pytest.mark.parametrize("few", [0, lines.FEW])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(lines.dedup_lines, "__defaults__", (lines.WIDTH, few))
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "e", 3) for d, t in rows], "doc_id long, text string, starts string, row int").repartition(5)
    got = lines.report(spark, docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    changed = lines.cleaned(spark, docs)
    assert changed.columns == docs.columns and changed.count() == len(rows)
    assert lines.report(spark, docs.limit(0)).count() == 0


def test_null_ids_come_last(spark):
    text = "one\ntwo\nthree"
    docs = spark.createDataFrame([(None, f"{text}\nmine"), (9, text)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in lines.report(spark, docs).collect()} == {(9, text), (None, "mine")}


def test_n_chars(spark):
    text = "one\ntwo\nthree"
    docs = spark.createDataFrame([(1, text, "en", "s", 13), (2, f"{text}\nü", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {tuple(r) for r in lines.cleaned(spark, docs).collect()} == {(1, text, "en", "s", 13), (2, "ü", "en", "s", 1)}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_oracle(spark, sf):
    import duckdb

    from loomline.llm import catalog

    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = c.execute(catalog.ORACLES["op2_three_line_windows"]).fetchall()
    got = list(map(tuple, catalog.QUERIES["op2_three_line_windows"](spark, d).collect()))
    assert sorted(got) == sorted(want) and any(r[3] for r in got)
