"""Filters of a document store against their meaning, document by document."""

import itertools
import re

import pytest

from loomline.sources import readers

SCHEMA = "id int, n double, s string, b boolean, tags array<string>, a struct<x: int, c: struct<y: string>>, items array<struct<k: int, v: string, deep: array<int>>>, m map<string, int>"

ROWS = [
    (0, 1.0, "one", True, ["p", "q"], (1, ("deep",)), [(1, "a", [1, 2]), (5, "b", [])], {"k": 1}),
    (1, 2.5, "two", False, [], (None, None), [], {}),
    (2, None, None, None, None, None, None, None),
    (3, -1.0, "", True, ["q"], (7, (None,)), [(5, "a", [9]), (None, None, None)], {"k": 3, "z": 0}),
    (4, 1.0, "One", False, ["p"], (2, ("deep",)), [(2, "b", [2])], {"z": 5}),
]


def doc(row):
    """The row as a document without what is null."""
    named = lambda names, values: None if values is None else {k: v for k, v in zip(names, values) if v is not None}
    out = dict(zip(("id", "n", "s", "b", "tags"), row))
    out["a"] = None if row[5] is None else named(("x", "c"), (row[5][0], named(("y",), row[5][1])))
    out["items"] = None if row[6] is None else [named(("k", "v", "deep"), x) for x in row[6]]
    out["m"] = row[7]
    return {k: v for k, v in out.items() if v is not None}


def values(value, path):
    """What lies at a path: through arrays every element's, at the end the elements and the array."""
    if isinstance(value, list):
        found = [y for x in value for y in values(x, path)]
        if path and path[0].isdigit() and int(path[0]) < len(value):
            found += values(value[int(path[0])], path[1:])
        return found + ([value] if not path else [])
    if not path:
        return [value]
    return values(value[path[0]], path[1:]) if isinstance(value, dict) and path[0] in value else [None] if not isinstance(value, list) else []


def like(a, b):
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return number(a) and number(b) or isinstance(a, type(b)) and type(a) is type(b)


def equal(a, b):
    return a is None if b is None else like(a, b) and a == b


def operator(found, name, wanted):
    if name in ("$ne", "$nin"):
        return not operator(found, {"$ne": "$eq", "$nin": "$in"}[name], wanted)
    if name == "$not":
        return not all(operator(found, n, w) for n, w in wanted.items())
    if name == "$exists":
        return any(v is not None for v in found) == bool(wanted)
    if name == "$all":
        return bool(wanted) and all(operator(found, "$eq", w) for w in wanted)
    if name == "$size":
        return any(isinstance(v, list) and len(v) == wanted for v in found)
    if name == "$regex":
        return any(isinstance(v, str) and re.search(wanted, v) for v in found)
    if name == "$elemMatch":
        plain = any(n.startswith("$") for n in wanted)
        return any(isinstance(v, list) and any((all(operator([x], n, w) for n, w in wanted.items()) if plain else x is not None and matches(x, wanted)) for x in v) for v in found)
    test = {"$eq": equal, "$in": lambda v, w: any(equal(v, x) for x in w), "$gt": lambda v, w: like(v, w) and v > w, "$gte": lambda v, w: like(v, w) and v >= w, "$lt": lambda v, w: like(v, w) and v < w, "$lte": lambda v, w: like(v, w) and v <= w}[name]
    return any(test(v, wanted) for v in found)


def matches(document, match):
    for name, wanted in match.items():
        if name == "$and":
            ok = all(matches(document, x) for x in wanted)
        elif name in ("$or", "$nor"):
            ok = any(matches(document, x) for x in wanted) == (name == "$or")
        else:
            tests = wanted if isinstance(wanted, dict) and wanted and all(k.startswith("$") for k in wanted) else {"$eq": wanted}
            found = values(document, name.split("."))
            ok = all(operator(found, n, w) for n, w in tests.items())
        if not ok:
            return False
    return True


PARTS = [
    {"n": 1}, {"n": {"$gt": 0, "$lte": 2.5}}, {"n": {"$ne": 1}}, {"s": "one"}, {"s": {"$in": ["one", "two", None]}}, {"s": {"$nin": ["one"]}}, {"s": None}, {"n": "1"}, {"s": {"$gt": 3}}, {"b": True}, {"b": {"$ne": True}},
    {"tags": "q"}, {"tags": {"$ne": "q"}}, {"tags": ["p", "q"]}, {"tags": []}, {"tags": {"$all": ["p", "q"]}}, {"tags": {"$size": 1}}, {"tags.0": "p"}, {"tags.5": "p"}, {"tags": {"$exists": True}}, {"tags": {"$exists": False}}, {"tags": {"$in": ["p", "z"]}},
    {"a.x": {"$gte": 2}}, {"a.c.y": "deep"}, {"a.c.y": {"$exists": False}}, {"a": {"x": 1, "c": {"y": "deep"}}}, {"a.c": {"y": "deep"}}, {"a.x": {"$not": {"$gt": 1}}}, {"a.none": 1}, {"a.none": {"$ne": 1}}, {"none.at.all": {"$exists": False}},
    {"items.k": 5}, {"items.k": {"$gt": 1, "$lt": 5}}, {"items.v": {"$regex": "^[ab]$"}}, {"items.deep": 2}, {"items.deep.0": 9}, {"items.1.k": 5}, {"items": {"$elemMatch": {"k": {"$gt": 1}, "v": "a"}}}, {"items.deep": {"$elemMatch": {"$gt": 1, "$lt": 9}}}, {"items.k": {"$nin": [5]}}, {"items": {"$size": 0}},
    {"m.k": 1}, {"m.z": {"$gte": 0}}, {"m.k": {"$exists": True}}, {"s": {"$regex": "(?i)^one$"}}, {"s": {"$not": {"$regex": "o"}}},
]


def test_filters_against_their_meaning(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    trees = [*PARTS, {}, {"n": 1, "b": True}]
    for x, y in itertools.islice(itertools.combinations(PARTS, 2), 0, None, 23):
        trees += [{"$or": [x, y]}, {"$nor": [x, y]}, {"$and": [x, {"$or": [y, {"id": 4}]}]}]
    columns = [readers.match_filter(t, frame.schema).alias(f"c{k}") for k, t in enumerate(trees)]
    got = frame.select("id", *columns).collect()
    for r in got:
        for k, t in enumerate(trees):
            assert bool(r[f"c{k}"]) == matches(doc(ROWS[r.id]), t), (t, ROWS[r.id])


def test_plain_comparisons_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"file://{tmp_path}/t")
    frame = spark.read.parquet(f"file://{tmp_path}/t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = frame.filter(readers.match_filter({"n": {"$gt": 1}, "a.x": 2, "$or": [{"s": "one"}, {"s": "two"}]}, frame.schema))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(n,1" in plan and "EqualTo(a.x,2)" in plan and "Or(EqualTo(s,one),EqualTo(s,two))" in plan


def test_unknown_comparisons(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for bad in ({"n": {"$near": 1}}, {"$where": "1"}, {"n": {"$not": {"$odd": 1}}}):
        with pytest.raises(ValueError):
            readers.match_filter(bad, frame.schema)
