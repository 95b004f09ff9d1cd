"""Merkle manifest of a dataset: digests of rows, trees of them by group, one root over all.

Rows are numbered in order, so every leaf knows its tree, its place there and how many leaves the tree has; the arity of every
run of siblings follows from that. A forest is a set of nodes without a parent yet, keyed by tree, level and index. Two forests
merge by union, and as soon as a run of siblings is whole its parent takes its place, which may complete the run above: the
operation is associative and commutative, so any dealing of nodes to tasks gives the same root. A task folds its leaves, which
stand in order, in stretches of ``STRETCH``; of each, few nodes per level stay open. Open nodes are then reduced in rounds: dealt
by place, so that neighbours meet, until one task holds all that is left. (``RDD.treeReduce`` merges partitions by their number's
remainder, which are no neighbours: next to no run would be whole before the last merge, on the driver.) Only the root's digest
reaches the driver.

What a round resolves it leaves behind as a path: for each node, the digests beside its way up to a node that stayed open. Joined
back from the last round to the first these are the siblings of each leaf up to the root, its proof.

Digests are lower-case hexadecimal SHA-256 of what they are made of, one behind the other: of a row, its fields, each as
``-`` if null, else as the number of its bytes, a colon and the value; of a run, its nodes' digests. Trees ascend by name, null
first, byte by byte, and their roots are the leaves of the tree above.

Rows: null ids come first in their tree; rows that share an id are ordered by their digest, so equal rows may change places; a
null text is a leaf like any other; other columns, however they are called, play no part; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import narrow, reread
from loomline.operators.predicates import numbered

ARITY = 2
#: Leaves that are folded at once; open nodes that one task reduces; names of trees that are broadcast at most.
STRETCH, NODES, TREES = 8192, 100_000, 1_000_000
#: The tree whose leaves are the roots of the others.
ABOVE = -1

Key = tuple[int, int, int]


def digest(*parts: Column) -> Column:
    """The digest of fields: text in UTF-8, numbers in decimal."""
    said = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said]), 256)


def run_of(level: int, index: int, n: int, arity: int) -> tuple[int, int]:
    """First index and end of the run of siblings that a node of a tree of ``n`` leaves belongs to."""
    width = -(-n // arity**level)
    first = index - index % arity
    return first, min(first + arity, width)


class Forest:
    """Nodes without a parent yet; ``up`` has, for nodes that got one, its key and their siblings, left to right."""

    def __init__(self, trees: int, arity: int = ARITY):
        self.trees, self.arity = trees, arity
        self.open: dict[Key, tuple[bytes, int]] = {}
        self.up: dict[Key, tuple[Key, bytes]] = {}
        self.tops: dict[int, bytes] = {}

    def add(self, key: Key, n: int, value: bytes) -> None:
        while True:
            tree, level, index = key
            first, end = run_of(level, index, n, self.arity)
            if index == 0 and end == 1:  # alone on its level
                self.tops[tree] = value
                if tree == ABOVE:
                    return
                parent, n = (ABOVE, 0, tree), self.trees
                self.up[key] = (parent, b"")
                key = parent
                continue
            self.open[key] = (value, n)
            run = [(tree, level, k) for k in range(first, end)]
            if any(k not in self.open for k in run):
                return
            values = [self.open.pop(k)[0] for k in run]
            parent = (tree, level + 1, index // self.arity)
            for k, own in enumerate(run):
                self.up[own] = (parent, b"".join(values[:k] + values[k + 1 :]))
            value = hashlib.sha256("".join(v.hex() for v in values).encode()).digest()
            key = parent

    def way(self, key: Key) -> tuple[Key, bytes]:
        """The open node, or root, above ``key`` and the siblings on the way."""
        beside = []
        while key in self.up:
            key, siblings = self.up[key]
            beside.append(siblings)
        return key, b"".join(beside)


def fold(value: bytes, siblings: bytes, tree: int, index: int, n: int, trees: int, arity: int = ARITY) -> bytes:
    """The root that a leaf and its siblings lead to."""
    at, level = 0, 0
    said = value.hex()
    while True:
        first, end = run_of(level, index, n, arity)
        if index == 0 and end == 1:
            if tree == ABOVE:
                return bytes.fromhex(said)
            tree, level, index, n = ABOVE, 0, tree, trees
            continue
        before, after = 32 * (index - first), 32 * (end - index - 1)
        said = hashlib.sha256((siblings[at : at + before].hex() + said + siblings[at + before : at + before + after].hex()).encode()).hexdigest()
        at += before + after
        level, index = level + 1, index // arity


#: kind 0: a node, or a leaf, with its way; 1: an open node; 2: the root of a tree.
_NODES = "kind int, tree long, level int, index long, n long, value binary, top_tree long, top_level int, top_index long, siblings binary"
_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary())


def _batch(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
    return [pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)]


def _left(forest: Forest) -> list[tuple]:
    rows = [(1, *key, n, value, None, None, None, None) for key, (value, n) in forest.open.items()]
    return rows + [(2, tree, None, None, None, value, None, None, None, None) for tree, value in forest.tops.items()]


def _climb(nodes: DataFrame, trees: int, arity: int, stretch: int | None, carried: str = "") -> DataFrame:
    """Fold the nodes of each stretch, or partition, into one forest; leaves keep what they carry."""
    names = [x.split()[0] for x in _NODES.split(", ")]
    extra = [x.split()[0] for x in carried.split(", ")] if carried else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            forest = Forest(trees, arity)
            block = pa.Table.from_batches(held).combine_chunks()
            keys = list(zip(*[block.column(c).to_pylist() for c in ("tree", "level", "index")], strict=True))
            sizes, values = block.column("n").to_pylist(), block.column("value").to_pylist()
            for key, n, value in zip(keys, sizes, values, strict=True):
                forest.add(key, n, value)
            rows = []
            for key, n, value in zip(keys, sizes, values, strict=True):
                top, siblings = forest.way(key)
                rows.append((0, *key, n, value, *top, siblings))
            left = _left(forest)
            columns = _batch(rows + left)
            for name in extra:
                own = block.column(name).combine_chunks()
                own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
                columns.append(pa.concat_arrays([own, pa.nulls(len(left), own.type)]))
            return pa.record_batch(columns, names + extra)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if stretch and size >= stretch:
                yield resolved(held)
                held, size = [], 0
        if held:
            yield resolved(held)

    return nodes.mapInArrow(run, _NODES + (f", {carried}" if carried else ""))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, index, n, value (digest), siblings up to the root and what rows carry; ``roots``: tree, name, value;
    ``root`` (None of no rows); ``trees``, how many there are."""

    leaves: DataFrame
    roots: DataFrame
    root: bytes | None
    trees: int
    arity: int


def manifest(spark: SparkSession, rows: DataFrame, carried: str = "", arity: int = ARITY) -> Manifest:
    """The manifest of rows of ``name`` (of a tree), ``id`` (its order), ``leaf`` (a digest in hexadecimal) and the columns
    ``carried``, which stay with their leaf."""
    extra = [x.split()[0] for x in carried.split(", ")] if carried else []
    placed = numbered(rows.select("name", "id", F.unhex("leaf").alias("value"), *extra), [F.asc_nulls_first("name"), F.asc_nulls_first("id"), F.asc("value")], "at")
    sizes = numbered(placed.groupBy("name").agg(F.count("*").alias("n"), F.min("at").alias("first")), [F.asc_nulls_first("name")], "tree")
    names = reread(spark, sizes.select(F.col("name").alias("of"), "n", "first", "tree"), "trees")
    trees = names.count()
    few = trees <= TREES
    leaves = placed.join(F.broadcast(names) if few else names, F.col("name").eqNullSafe(F.col("of")))
    if not few:  # the join has lost the order, which keeps forests small
        leaves = leaves.repartitionByRange("at").sortWithinPartitions("at")
    leaves = leaves.select("tree", F.lit(0).alias("level"), (F.col("at") - F.col("first")).alias("index"), "n", "value", *extra)
    rounds = [reread(spark, _climb(leaves, trees, arity, STRETCH, carried), "forest")]
    while True:
        left = rounds[-1].filter("kind = 1").select("tree", "level", "index", "n", "value")
        count = left.count()
        if not count:
            break
        place = F.col("index") * F.pow(F.lit(float(arity)), F.col("level"))
        dealt = left.coalesce(1) if count <= NODES else left.withColumn("place", place).repartitionByRange(-(-count // NODES), "tree", "place").drop("place")
        rounds.append(reread(spark, _climb(dealt, trees, arity, None), "forest"))
    found = [r.filter("kind = 2").select("tree", "value") for r in rounds]
    roots = found[0]
    for more in found[1:]:
        roots = roots.unionByName(more)
    root = roots.filter(F.col("tree") == ABOVE).first()
    ways = None
    for k in range(len(rounds) - 1, -1, -1):
        own = rounds[k].filter("kind = 0")
        if ways is not None:
            above = ways.select(F.col("tree").alias("top_tree"), F.col("level").alias("top_level"), F.col("index").alias("top_index"), F.col("siblings").alias("higher"))
            own = own.join(above, ["top_tree", "top_level", "top_index"], "left").withColumn("siblings", F.concat("siblings", F.coalesce("higher", F.lit(b""))))
        ways = own.select("tree", "level", "index", "n", "value", "siblings", *(extra if k == 0 else []))
        ways = reread(spark, ways, "ways") if 0 < k < len(rounds) - 1 else ways
    named = roots.filter(F.col("tree") != ABOVE).join(names.select("tree", F.col("of").alias("name")), "tree")
    return Manifest(ways.drop("level"), named, root.value if root else None, trees, arity)


def verify(made: Manifest, leaves: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``leaves`` (rows like those of the manifest), with ``proof`` (the digest of a leaf's siblings), ``folded`` (the
    root to which the digest in ``value`` and the siblings lead) and ``verified`` (it is the manifest's)."""
    trees, arity, root = made.trees, made.arity, made.root
    kept = leaves.select(*keep, "tree", "index", "n", "siblings", F.col(value).alias("__value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for own, siblings, tree, index, n in zip(*[batch.column(c).to_pylist() for c in ("__value", "siblings", "tree", "index", "n")], strict=True):
                proofs.append(hashlib.sha256(siblings.hex().encode()).hexdigest())
                folded.append(fold(own, siblings, tree, index, n, trees, arity))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(proofs, pa.string()), pa.array([x.hex() for x in folded], pa.string()), pa.array([x == root for x in folded], pa.bool_())], [*keep, "proof", "folded", "verified"])

    return kept.mapInArrow(run, f"{schema}, proof string, folded string, verified boolean")


def proofs(spark: SparkSession, docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document: the manifest of all, against which
    documents are verified of which some have been tampered with (``n_chars`` one higher where 7 divides the id's CRC-32)."""
    rows = narrow(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    fields = lambda n: digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fields(F.col("n_chars").cast("decimal(20,0)") + 1))
    leaves = rows.select(F.col("lang").alias("name"), F.col("doc_id").alias("id"), fields(F.col("n_chars")).alias("leaf"), "doc_id", F.unhex(changed).alias("tampered"))
    made = manifest(spark, leaves, "doc_id long, tampered binary", arity)
    roots = made.roots.select("tree", F.col("value").alias("subroot"))
    joined = made.leaves.withColumn("now", F.coalesce("tampered", "value")).join(F.broadcast(roots) if made.trees <= TREES else roots, "tree")
    found = verify(made, joined, "now", ["doc_id", "value", "subroot"])
    said = lambda name: F.lower(F.hex(name))
    return found.select("doc_id", said("value").alias("leaf"), said("subroot").alias("subroot"), F.lit(made.root.hex() if made.root else None).cast("string").alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


ORACLE = r"""
with recursive crcs as (
  select doc_id, list_reduce([4294967295::bigint] || list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, (i + 1)::int, 1))::bigint),
    lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda i: 0::bigint), lambda c, d: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as c
  from (select distinct doc_id from documents where doc_id is not null)),
said as (
  select doc_id, lang, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as before,
    coalesce(strlen(text) || ':' || text, '-') as after
  from documents),
leaves as (
  select s.doc_id, s.lang, sha256(before || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || after) as leaf,
    case when xor(c.c, 4294967295) % 7 = 0 then sha256(before || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || after) end as tampered
  from said s left join crcs c on s.doc_id = c.doc_id),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n,
    dense_rank() over (order by lang nulls first) - 1 as tree from leaves),
nodes(tree, level, idx, n, value) as (
  select tree, 0, idx, n, leaf from placed
  union all
  select tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(value, '' order by idx)) from nodes where n > 1 group by tree, level, idx // 2, n),
roots as (select tree, value from nodes where n = 1),
above(level, idx, n, value) as (
  select 0, tree, (select count(*) from roots), value from roots
  union all
  select level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(value, '' order by idx)) from above where n > 1 group by level, idx // 2, n),
every as (
  select tree, level, idx, n, value from nodes union all select -1, level, idx, n, value from above),
ways(tree, k, of, level, idx, n, beside, folded) as (
  select tree, idx, tree, 0, idx, n, '', coalesce(tampered, leaf) from placed
  union all
  select w.tree, w.k, case when w.n = 1 then -1 else w.of end, case when w.n = 1 then 0 else w.level + 1 end, case when w.n = 1 then w.tree else w.idx // 2 end,
    case when w.n = 1 then (select count(*) from roots) else (w.n + 1) // 2 end, w.beside || coalesce(e.value, ''),
    case when w.n = 1 then w.folded when w.idx % 2 = 1 then sha256(e.value || w.folded) else sha256(w.folded || coalesce(e.value, '')) end
  from ways w left join every e on w.n > 1 and e.tree = w.of and e.level = w.level and e.idx = (case when w.idx % 2 = 1 then w.idx - 1 else w.idx + 1 end)
  where not (w.of = -1 and w.n = 1)),
ends as (select tree, k, beside, folded from ways where of = -1 and n = 1)
select p.doc_id, p.leaf, r.value as subroot, a.value as root, sha256(e.beside) as proof_sha256, e.folded as folded_root, e.folded = a.value as verified
from placed p join roots r on p.tree = r.tree join ends e on p.tree = e.tree and p.idx = e.k cross join (select value from above where n = 1) a
"""
