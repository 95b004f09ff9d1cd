"""SimHash near-duplicate groups, found with BK-trees.

Fingerprints: each text's word shingles are hashed; a bit of the fingerprint is set where over half of the hashes have
it. Equal fingerprints become one before anything else happens. A fingerprint is then filed under several keys, each made
of some of its bits; two that share a key meet in that key's shard. Keys have more bits, and there are more of them, the
more fingerprints there are, so that a shard keeps its size. Where every choice of blocks of bits that ``radius`` errors
can leave untouched is a key, two fingerprints within the radius share one, and no link is lost.

A BK-tree holds the fingerprints of a shard: children are keyed by their integer Hamming distance to the parent, and a
search follows only edges within the radius of the query's own distance. The trees of all shards of a task are arrays that
are built and searched together, level by level. A shard's tree stays where its members meet. Shards above ``SHARD`` members
are not brought together: their trees, if they are no larger than ``TREES`` altogether, are broadcast, and members are
searched where they are; larger ones are split by a hash, and each pair of splits is searched on its own.

Only a spanning forest of the links leaves a task, so a shard of n near copies gives fewer than n rows. Components come from
alternating large-star and small-star rounds, each written to the shared folder.

Rows: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle are one
shingle; rows that repeat an id are one member whose fingerprints are all linked; rows with a null id get the component
of their fingerprint's group; texts of any length are read whole; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import arrow_map, forget, narrow, reread, row_key, small_batches
from loomline.llm.words import SLICE, mix, packed, unpacked, word_codes

SEED = 42
#: Largest number of fingerprints that one shard brings together, and the mean that keys aim at.
SHARD, MEAN = 8192, 64
#: Bytes of trees that are broadcast at most, and rows of small tables.
TREES, FEW = 32 << 20, 500_000
CHUNK = 1 << 17


# -- fingerprints


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included, of the text with A-Z lower-cased."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return np.array([digest(b" ".join(tokens), seed)], np.uint64)
    shingles = map(b" ".join, zip(*[tokens[k:] for k in range(words)], strict=False))
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(tokens) - words + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian fingerprint of 64 * ``lanes`` bits: those set in over half of the hashes. Lane 0 takes the hashes
    themselves, the others mix them anew."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            block = hashes[at : at + CHUNK]
            block = (mix(block + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if lane else block).astype(">u8")
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (binary, 64 bits) of every text."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = [fingerprint(shingle_hashes(text.as_py(), words)) for text in batch.column("text")]
            return pa.record_batch([batch.column("doc_id"), pa.array(prints, pa.binary())], ["doc_id", "fp"])

        return apply

    return arrow_map(narrow(docs, doc_id="long", text="string"), make, "doc_id long, fp binary")


def distance(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, row by row: (n, lanes)."""
    return np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)


# -- BK-trees


class Forest:
    """A Burkhard-Keller tree for each shard, in arrays: every node's children, sorted by their distance to it.

    ``shard`` is sorted; the first member of a shard is its root. ``steps`` counts the distances that searches took.
    """

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        self.prints, self.width, self.steps = prints, 64 * prints.shape[1] + 1, 0
        self.shards, first = np.unique(shard, return_index=True)
        self.roots = first
        n = len(shard)
        node = np.repeat(first, np.diff(np.append(first, n)))
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        parents, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(waiting):
            code = node[waiting] * self.width + distance(prints[waiting], prints[node[waiting]])
            order = np.argsort(code, kind="stable")
            waiting, code = waiting[order], code[order]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            parents.append(code[new])
            children.append(waiting[new])
            node[waiting] = waiting[new][np.cumsum(new) - 1]
            waiting = waiting[~new]
        edges, nodes = np.concatenate(parents), np.concatenate(children)
        order = np.argsort(edges, kind="stable")
        self.edges, self.children = edges[order], nodes[order]

    def links(self, shard: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of the queries, members within the radius), for queries of a shard each, which all go down together."""
        at = np.minimum(np.searchsorted(self.shards, shard), max(0, len(self.shards) - 1))
        known = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.empty(0, int)
        stack = [(known[k : k + CHUNK], self.roots[at[known[k : k + CHUNK]]]) for k in range(0, len(known), CHUNK)]
        while stack:
            asked, node = stack.pop()
            far = distance(prints[asked], self.prints[node])
            self.steps += len(asked)
            near = far <= radius
            if near.any():
                yield asked[near], node[near]
            low = np.searchsorted(self.edges, node * self.width + np.maximum(far - radius, 0))
            count = np.searchsorted(self.edges, node * self.width + np.minimum(far + radius, self.width - 1), "right") - low
            asked = np.repeat(asked, count)
            child = self.children[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(asked))]
            stack += [(asked[k : k + CHUNK], child[k : k + CHUNK]) for k in range(0, len(asked), CHUNK)]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b. ``label`` gives every member the smallest member of its set and is changed in place."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def forest_edges(shard: np.ndarray, prints: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (rows a, rows b) of the links inside whole shards. A link needs a member that is in the shard's tree
    and one that is asked of it."""
    label = np.arange(len(shard))
    inside, asked = np.flatnonzero(tree), np.flatnonzero(query)
    for q, m in Forest(shard[inside], prints[inside]).links(shard[asked], prints[asked], radius):
        unite(label, asked[q], inside[m])
    linked = np.flatnonzero(label != np.arange(len(shard)))
    return linked, label[linked]


def star_edges(shard: np.ndarray, prints: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member that is linked inside its shard, with the middle of what hangs together there: the member nearest to
    the majority of their bits."""
    a, b = forest_edges(shard, prints, tree, query, radius)
    if not len(a):
        return a, b
    members, group = np.append(a, np.unique(b)), np.append(b, np.unique(b))
    order = np.argsort(group, kind="stable")
    members, group = members[order], group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, len(group)))
    bits = np.unpackbits(prints[members].view(np.uint8).reshape(len(members), -1), axis=1)
    most = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > sizes[:, None], axis=1).view(np.uint64)
    far = distance(prints[members], np.repeat(most, sizes, axis=0))
    best = np.lexsort((members, far, group))[first]
    middle = np.repeat(members[best], sizes)
    other = members != middle
    return members[other], middle[other]


def pair_edges(shard: np.ndarray, prints: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int, label: np.ndarray, size: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows a, rows b) inside whole shards between members whose labels differ and that can be similar: of two sets
    as similar as ``SIMILAR``, each has at least so many members that some other set has too, and neither is much larger."""
    part, whole = SIMILAR
    inside, asked = np.flatnonzero(tree), np.flatnonzero(query)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for q, m in Forest(shard[inside], prints[inside]).links(shard[asked], prints[asked], radius):
        a, b = asked[q], inside[m]
        can = ((part + whole) * np.minimum(shared[a], shared[b]) >= part * (size[a] + size[b])) & (whole * np.minimum(size[a], size[b]) >= part * np.maximum(size[a], size[b]))
        other, back = can & (label[a] < label[b]), can & (label[a] > label[b])
        found += [(a[other], b[other]), (b[back], a[back])]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique(np.stack([a, b], axis=1), axis=0)
    return both[:, 0], both[:, 1]


# -- keys


def exact_keys(n: int, bits: int = 64, radius: int = 3, mean: int = MEAN) -> list[list[int]]:
    """Half-bytes of each key, such that fingerprints within the radius share one: of some blocks, all but ``radius``.

    The fewest blocks whose keys file ``n`` fingerprints in shards of about ``mean`` or smaller."""
    digits = bits // 4
    for blocks in range(radius + 1, digits + 1):
        cuts = [list(x) for x in np.array_split(np.arange(digits), blocks)]
        keys = [[int(d) for k in chosen for d in cuts[k]] for chosen in combinations(range(blocks), blocks - radius)]
        if n <= mean << 4 * min(map(len, keys)) or blocks == digits:
            return keys
    raise ValueError("more errors than half-bytes")


def sampled_keys(n: int, bits: int, agree: float, lost: float = 0.005, mean: int = MEAN, seed: int = 9) -> list[list[int]]:
    """Half-bytes of each key, such that fingerprints whose bits agree with probability ``agree`` share none with
    probability ``lost`` or less."""
    digits = 4
    while n > mean << 4 * digits:
        digits += 1
    count, rng, keys = math.ceil(math.log(lost) / math.log(1 - agree ** (4 * digits))), np.random.default_rng(seed), []
    while len(keys) < count:
        turn = rng.permutation(bits // 4)
        keys += [sorted(turn[k : k + digits].tolist()) for k in range(0, len(turn) - digits + 1, digits)]
    return keys


def _digits(prints: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), -1).astype(np.uint64)


def _bands(digits: np.ndarray, nth: np.ndarray | int, keys: int) -> np.ndarray:
    """The shard of each row's digits under the key of that number."""
    value = digits @ (np.uint64(1) << np.arange(0, 4 * digits.shape[1], 4, dtype=np.uint64))
    return mix(value * np.uint64(keys) + np.asarray(nth, np.uint64)).view(np.int64)


def filed(groups: DataFrame, keys: list[list[int]]) -> DataFrame:
    """A row for every key of every row of ``groups`` (``fp``, and others, which stay): ``band``."""
    places = [np.array(k) for k in keys]
    others = [f for f in groups.schema.fields if f.name != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, CHUNK // len(places))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                digits = _digits(_lanes(batch.column("fp").to_pylist()))
                band = np.stack([_bands(digits[:, p], k, len(places)) for k, p in enumerate(places)], axis=1)
                again = pa.array(np.repeat(np.arange(len(digits)), len(places)))
                yield pa.record_batch([pa.array(band.ravel()), *(batch.column(c).take(again) for c in ("fp", *(f.name for f in others)))], ["band", "fp", *(f.name for f in others)])

    return groups.select("fp", *(f.name for f in others)).mapInArrow(run, ", ".join(["band long", "fp binary", *(f"{f.name} {f.dataType.simpleString()}" for f in others)]))


def first_meeting(prints: np.ndarray, a: np.ndarray, b: np.ndarray, keys: list[list[int]]) -> np.ndarray:
    """The shard of the first key that the fingerprints of each pair share; keys of one length."""
    places, out = np.array(keys), []
    for at in range(0, len(a), 1 << 13):
        one, other = _digits(prints[a[at : at + (1 << 13)]]), _digits(prints[b[at : at + (1 << 13)]])
        nth = (one == other)[:, places].all(axis=2).argmax(axis=1)
        out.append(_bands(np.take_along_axis(one, places[nth], axis=1), nth, len(places)))
    return np.concatenate(out) if out else np.empty(0, np.int64)


# -- links


def _lanes(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


def _edge_rows(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), CHUNK):
        yield pa.record_batch([pa.array([prints[i].tobytes() for i in x[at : at + CHUNK].tolist()], pa.binary()) for x in (a, b)], ["a", "b"])


def _number(shard: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A hash of shard and fingerprint."""
    out = shard.view(np.uint64)
    for lane in prints.T:
        out = mix(out + lane)
    return out


def _broadcast_edges(spark: SparkSession, members: DataFrame, radius: int) -> DataFrame:
    """Spanning edges of large shards, whose trees are sent to all tasks; ``members``: shard and fp."""
    rows = members.select("shard", "fp").toArrow()
    shard, prints = rows["shard"].to_numpy(), _lanes(rows["fp"].to_pylist())
    order = np.argsort(shard, kind="stable")
    shard, prints = shard[order], prints[order]
    numbers = _number(shard, prints)
    sent = spark.sparkContext.broadcast((Forest(shard, prints), numbers[np.argsort(numbers)], np.argsort(numbers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, numbers, places = sent.value
        label = np.arange(len(places))
        for batch in batches:
            shard, prints = batch.column("shard").to_numpy(), _lanes(batch.column("fp").to_pylist())
            own = places[np.searchsorted(numbers, _number(shard, prints))]
            for q, m in forest.links(shard, prints, radius):
                unite(label, own[q], m)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield from _edge_rows(forest.prints, linked, label[linked])

    return members.select("shard", "fp").mapInArrow(run, "a binary, b binary")


def link_edges(groups: DataFrame, keys: list[list[int]], radius: int, find=forest_edges, shard_size: int = SHARD, trees: int = TREES) -> DataFrame:
    """Edges (``a``, ``b``: fingerprints) that ``find`` makes of the links among distinct fingerprints of ``groups`` (``fp``
    and, for ``pair_edges``, ``label``, ``size`` and ``shared``)."""
    spark = groups.sparkSession
    named = ["label", "size", "shared"] if find is pair_edges else []
    rows = filed(groups.select("fp", *named), keys)
    large = rows.groupBy("band").count().filter(F.col("count") > shard_size).select("band", F.col("count").alias("size"), F.ceil(F.col("count") / shard_size).alias("splits"))
    large = reread(spark, large, "large")
    several, members = large.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # without large shards, or with few, the filed fingerprints are shuffled once, to their shards
    sized = rows.join(F.broadcast(large) if several <= FEW else large, "band", "left") if several else rows.withColumn("splits", F.lit(None).cast("long"))
    one = F.lit(True)
    dealt = sized.filter("splits is null").select(F.col("band").alias("shard"), "fp", one.alias("tree"), one.alias("query"), *named)
    split = sized.filter("splits is not null")
    bits = 8 * len(groups.first().fp) if several else 0
    sent = several > 0 and find is forest_edges and members * (bits // 8 + 24) <= trees
    if several and not sent:
        pairs = split.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("splits"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
        of_pair = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.unionByName(pairs.select(of_pair.alias("shard"), "fp", (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("query"), *named))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        def edges(shard, prints, tree, query, *more) -> Iterator[pa.RecordBatch]:
            a, b = find(shard, prints, tree, query, radius, *more)
            if find is pair_edges:
                # a pair meets in several shards; unless some are split, that of the first key gives it
                first = (shard[a] == first_meeting(prints, a, b, keys)) | bool(several)
                a, b = a[first], b[first]
            yield from _edge_rows(prints, a, b)

        for batch in batches:
            held.append([batch.column("shard").to_numpy(), _lanes(batch.column("fp").to_pylist()), *(batch.column(x).to_numpy(zero_copy_only=False) for x in ("tree", "query", *named))])
            if sum(len(x[0]) for x in held) > 50_000:
                rows = joined()
                start = int(np.searchsorted(rows[0], rows[0][-1]))  # the last shard may go on in the next batch
                held = [[x[start:] for x in rows]]
                if start:
                    yield from edges(*(x[:start] for x in rows))
        if held:
            yield from edges(*joined())

    found = dealt.mapInArrow(run, "a binary, b binary")
    if sent:
        found = found.unionByName(_broadcast_edges(spark, split.select(F.col("band").alias("shard"), "fp"), radius))
    return found


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with, for every node of ``edges`` (``a``, ``b``).

    Large-star and small-star rounds until the edges are stars. What a round finds out for each node lies in the shared
    folder before it is joined, so that the join's partitions, a hub's with all its neighbours too, can be split.
    """
    edges = reread(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = reread(spark, both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "lowest")
        large = reread(spark, both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = reread(spark, large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        step = reread(spark, small, "links")
        tops, nodes = step.select(F.col("v").alias("u")).distinct(), step.groupBy("u").agg(F.count("*").alias("n"))
        moving = nodes.filter("n > 1").limit(1).count() or tops.join(nodes, "u", "left_semi").limit(1).count()
        if not moving:
            return step.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = step


# -- 64 bits, linked at 3


RADIUS = 3


def near_groups(spark: SparkSession, prints: DataFrame, radius: int = RADIUS, mean: int = MEAN) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``prints`` (doc_id, fp of 64 bits)."""
    prints = reread(spark, prints, "prints")
    groups = reread(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")
    found = link_edges(groups, exact_keys(groups.count(), 64, radius, mean), radius)
    linked = components(spark, found.unionByName(_shared_ids(prints)))
    rooted = reread(spark, groups.join(linked, groups.fp == linked.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = reread(spark, rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = reread(spark, rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _shared_ids(prints: DataFrame) -> DataFrame:
    """Edges between the fingerprints of rows that repeat an id."""
    several = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").select("doc_id", "b")
    return prints.join(several, "doc_id").filter("fp > b").select(F.col("fp").alias("a"), "b")


def simhash_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits: doc_id, fingerprint, component_id."""
    found = near_groups(spark, fingerprints(docs, words=3))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# -- near copies: 256 bits name candidates, shingles decide


#: The different 5-word shingles of two texts are similar where they share 4 of 5 (Jaccard), which is a cosine of 0.889, at
#: which 0.152 of the bits differ: 39 of 256, with a deviation of 6. Candidates are within three deviations.
WORDS, LANES, WIDE = 5, 4, 57
SIMILAR = (4, 5)
AGREE = 1 - math.acos(8 / 9) / math.pi


def wide_prints(docs: DataFrame) -> DataFrame:
    """``fp`` and ``shingles`` (their different hashes, sorted, packed) of every text, beside the other columns.

    Shingles are hashed from the words' hashes; 32 bits of them are kept.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]

    def of_texts(texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        codes, counts = word_codes(texts)
        ends = np.cumsum(counts)
        prints, sets = [], []
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            own = mix(codes[end - n : end])
            hashes = own[: max(0, n - WORDS + 1)] if n >= WORDS else own.sum(keepdims=True)[: min(n, 1)]
            for k in range(1, WORDS if n >= WORDS else 1):
                hashes = mix(hashes) + own[k : k + len(hashes)]
            hashes = np.unique(mix(hashes))
            prints.append(fingerprint(hashes, LANES))
            sets.append(packed(np.diff(np.unique((hashes >> np.uint64(32)).astype(np.uint32)), prepend=np.uint32(0))))
        return prints, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, end = [], 0, at
                while end < batch.num_rows and size < SLICE:
                    texts.append((batch.column("text")[end].as_py() or "").encode().lower())
                    size, end = size + len(texts[-1]), end + 1
                prints, sets = of_texts(texts)
                yield pa.record_batch([*(batch.column(f.name).slice(at, end - at) for f in others), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], [*(f.name for f in others), "fp", "shingles"])
                at = end

    return docs.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "fp binary", "shingles binary"]))


def similar(one: bytes, other: bytes) -> bool:
    """Whether two packed sets have a Jaccard similarity of at least ``SIMILAR``."""
    a, b = (np.cumsum(unpacked(x)[0], dtype=np.uint32) for x in (one, other))
    both = len(np.intersect1d(a, b, assume_unique=True))
    part, whole = SIMILAR
    return whole * both >= part * (len(a) + len(b) - both)


def candidates(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Each edge (a, b) once, the smaller end first."""
    return reread(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "candidates")


def sets_of(spark: SparkSession, edges: DataFrame, prints: DataFrame) -> DataFrame:
    """``fp`` and ``shingles`` of the ends of ``edges``."""
    ends = reread(spark, edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).distinct(), "ends")
    wanted = prints.select("fp", "shingles").join(_small(ends), "fp", "left_semi")
    return reread(spark, wanted.groupBy("fp").agg(F.min("shingles").alias("shingles")), "sets")


def confirmed(spark: SparkSession, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``edges`` (a, b: fingerprints) whose texts' shingles, in ``sets``, are similar, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of_a, of_b = (sets.select(F.col("fp").alias(k), F.col("shingles").alias(n)) for k, n in (("a", "x"), ("b", "y")))
    return reread(spark, edges.join(of_a, "a").join(of_b, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"), "confirmed")


def shared_counts(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """``fp``, ``size`` and ``shared``: how many shingles a set has, and how many of them another set has too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, data in zip(batch.column("of").to_pylist(), batch.column("shingles"), strict=True):
                hashes = np.cumsum(unpacked(data.as_py())[0], dtype=np.uint32).view(np.int32)
                yield pa.record_batch([pa.array(np.full(len(hashes), of, np.int64)), pa.array(hashes)], ["of", "shingle"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("fp"), batch.column("of"), pa.array([len(unpacked(x.as_py())[0]) for x in batch.column("shingles")], pa.int64())], ["fp", "of", "size"])

    keyed = sets.withColumn("of", F.xxhash64("fp"))
    said = keyed.select("of", "shingles").mapInArrow(each, "of long, shingle int").groupBy("shingle").agg(F.min("of").alias("of"), F.max("of").alias("last"))
    alone = reread(spark, said.filter("of = last").groupBy("of").agg(F.count("*").alias("alone")), "alone")
    sized = keyed.select("fp", "of", "shingles").mapInArrow(sizes, "fp binary, of long, size long")
    return sized.join(alone, "of", "left").select("fp", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _small(frame: DataFrame) -> DataFrame:
    """``frame``, to be broadcast if it has few rows; larger ones are joined by a shuffle, with the same result."""
    return F.broadcast(frame) if frame.limit(FEW + 1).count() <= FEW else frame


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: rows that hang together by a similarity of 0.8 or more of their
    5-word shingles. That with the smallest doc_id stays, of several the one whose content hashes lowest.

    First every fingerprint is compared with the middle of what it shares a shard with, which links a group of copies
    without listing its pairs. Then all candidate pairs that are still apart are listed and counted, but for those that
    cannot be similar because too much of one of the texts is in no other.

    Rows: different texts of one doc_id are different rows, which stay unless they are near copies; rows that are equal in
    all columns are copies; rows with a null id all stay; null and blank texts are copies of one another; texts of fewer than
    five words are one shingle; equal fingerprints are copies.
    """
    small_batches(spark)
    key = row_key(*docs.columns)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("key"), docs["text"].cast("string").alias("text"))
    prints = reread(spark, wide_prints(keyed), "prints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key")))
    groups = reread(spark, prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("rows")), "groups")
    keys = sampled_keys(groups.count(), 64 * LANES, AGREE)
    stars = candidates(spark, link_edges(groups.select("fp"), keys, WIDE, star_edges))
    sets = sets_of(spark, stars, prints)
    close = confirmed(spark, stars, sets)
    roots = components(spark, close)
    met = shared_counts(spark, sets)
    labelled = met.join(roots, met.fp == roots.node, "left").select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("label"), "size", "shared")
    others = confirmed(spark, candidates(spark, link_edges(reread(spark, labelled, "labelled"), keys, WIDE, pair_edges)), sets)
    linked = components(spark, close.unionByName(others))
    rooted = reread(spark, groups.join(_small(linked), groups.fp == linked.node, "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    chosen = rooted.groupBy("root").agg(F.min("first").alias("chosen"), F.sum("rows").alias("rows")).filter("rows > 1").select("root", "chosen")
    chosen = reread(spark, chosen, "chosen")
    members = reread(spark, rooted.select("fp", "root").join(chosen, "root").select("fp", "chosen"), "members")
    rows = prints.filter("doc_id is not null").select("fp", "doc_id", "key").join(_small(members), "fp")
    stays = F.struct("doc_id", "key") == F.col("chosen")
    verdict = rows.groupBy("key").agg(F.min(stays).alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1")
    verdict = reread(spark, verdict.select(F.col("key").alias("of"), "stays"), "verdict")
    boxed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), key.alias("row"))
    marked = boxed.join(_small(verdict), F.col("row") == F.col("of"), "left")
    once = marked.filter("stays").dropDuplicates(["row"])
    return marked.filter("stays is null").unionByName(once).select("doc.*")
