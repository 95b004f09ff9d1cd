import random

import numpy as np
import pytest
import xxhash

from loomline.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def brute_components(rows):
    prints = [(d, int(brute_fingerprint(t), 16)) for d, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3 or (prints[i][0] is not None and prints[i][0] == prints[j][0]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def texts(rng):
    words = [f"w{k}" for k in range(300)]
    out = [None, "", "  \n", "one", "One", "one two", "A\xa0b c", "x\x0by z", "é É", "a b c " * 30000]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
    return out


def test_components(spark):
    rng = random.Random(3)
    rows = [(i + 5, t) for i, t in enumerate(texts(rng))]
    rows += [(None, rows[-1][1]), (None, "quite alone here"), rows[20], (rows[21][0], "another text of the same id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, b"1", 2) for d, t in rows], "doc_id long, text string, fp binary, component_id int").repartition(4)
    got = sorted(map(tuple, simhash.simhash_components(spark, docs).collect()), key=str)
    assert got == brute_components(rows)
    assert simhash.simhash_components(spark, docs.limit(0)).count() == 0


def brute_labels(prints, shard, tree, query, radius):
    near = (np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2) <= radius) & (shard[:, None] == shard) & (tree[:, None] & query)
    label = np.arange(len(prints))
    simhash.unite(label, *np.nonzero(near | near.T))
    return label


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_shards_against_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64), axis=1) * (rng.random(400) < 0.8).astype(np.uint64)
    prints = (base[rng.integers(0, 30, 400)] ^ flips).reshape(-1, 1)
    shard = np.sort(rng.choice([1, 2, 2, 2, 2, 9, 10], 400))
    tree, query = rng.random(400) < 0.7, rng.random(400) < 0.7
    want = brute_labels(prints, shard, tree, query, radius)
    a, b = simhash.forest_edges(shard, prints, tree, query, radius)
    got = np.arange(400)
    simhash.unite(got, a, b)
    assert (got == want).all() and len(a) == 400 - len(np.unique(want))
    every = np.ones(400, bool)
    label = rng.integers(0, 5, 400)
    size, shared = rng.integers(1, 100, 400), rng.integers(0, 100, 400)
    a, b = simhash.pair_edges(shard, prints, every, every, radius, label, size, shared)
    can = (9 * np.minimum(shared[:, None], shared) >= 4 * (size[:, None] + size)) & (5 * np.minimum(size[:, None], size) >= 4 * np.maximum(size[:, None], size))
    near = can & (np.bitwise_count(prints ^ prints.T) <= radius) & (shard[:, None] == shard) & (label[:, None] < label)
    assert {*zip(a.tolist(), b.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(near)))}
    a, b = simhash.star_edges(shard, prints, every, every, radius)
    want = brute_labels(prints, shard, every, every, radius)
    got = np.arange(400)
    simhash.unite(got, a, b)
    assert (got == want).all() and len(set(a.tolist())) == len(a)


@pytest.mark.parametrize("trees", [0, 1 << 25])
def test_large_shards_are_broadcast_or_split(spark, trees):
    rng = np.random.default_rng(1)
    prints = {int(x) for x in rng.integers(0, 2**16, 900, dtype=np.uint64)}
    groups = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in prints], "fp binary").repartition(3)

    def roots(size):
        edges = simhash.link_edges(groups, simhash.exact_keys(900), 2, shard_size=size, trees=trees)
        return {(bytes(r.node), bytes(r.root)) for r in simhash.components(spark, edges).collect()}

    assert roots(100) == roots(10**6) != set()


def test_tree_follows_only_near_edges():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, (3000, 1), dtype=np.uint64)
    prints[1500:] = prints[:1500] ^ (np.uint64(1) << rng.integers(0, 64, (1500, 1), dtype=np.uint64))
    shard = np.zeros(3000, np.int64)
    forest = simhash.Forest(shard, prints)
    got = {(int(x), int(y)) for q, m in forest.links(shard, prints, 3) for x, y in zip(q, m)}
    x, y = np.nonzero(np.bitwise_count(prints ^ prints.T) <= 3)
    assert got == set(zip(x.tolist(), y.tolist()))
    assert len(forest.edges) == 2999 and forest.steps < 0.7 * 3000**2
    far = np.bitwise_count(prints[forest.edges // 65, 0] ^ prints[forest.children, 0])
    assert (far == forest.edges % 65).all()


def test_keys_cover_all_errors():
    for n, least in ((10, 4), (1 << 24, 4), (1 << 32, 6), (1 << 40, 8)):
        keys = simhash.exact_keys(n)
        assert n <= simhash.MEAN << 4 * min(map(len, keys)) and min(map(len, keys)) >= least
        from itertools import combinations

        assert all(any(not set(k) & set(bad) for k in keys) for bad in combinations(range(16), 3))


def test_trees_on_the_data(spark):
    """On the table of sf0.1 trees are built, prune, and give the components of a comparison of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = simhash.simhash_components(spark, docs).collect()
    prints = np.array(sorted({int(r.fingerprint, 16) for r in rows}), np.uint64)
    label = np.arange(len(prints))
    for at in range(0, len(prints), 500):
        a, b = np.nonzero(np.bitwise_count(prints[at : at + 500, None] ^ prints) <= 3)
        simhash.unite(label, a + at, b)
    place = {int(p): k for k, p in enumerate(prints)}
    least = {}
    for r in rows:
        k = label[place[int(r.fingerprint, 16)]]
        least[k] = min(r.doc_id, least.get(k, r.doc_id))
    assert all(r.component_id == least[label[place[int(r.fingerprint, 16)]]] for r in rows)
    groups = spark.createDataFrame([(int(x).to_bytes(8, "big"),) for x in prints], "fp binary")
    filed = simhash.filed(groups, simhash.exact_keys(len(prints))).orderBy("band").toArrow()
    shard, fps = filed["band"].to_numpy(), simhash._lanes(filed["fp"].to_pylist())
    forest = simhash.Forest(shard, fps)
    found = sum(len(q) for q, _ in forest.links(shard, fps, 3))
    _, sizes = np.unique(shard, return_counts=True)
    print("shards", len(sizes), "largest", sizes.max(), "edges of trees", len(forest.edges), "steps", forest.steps, "all pairs of shards", (sizes**2).sum(), "links", found)
    assert len(forest.edges) == len(shard) - len(sizes) > 1000 and forest.steps < 0.95 * (sizes**2).sum() < 0.01 * len(prints) ** 2


def test_long_chain(spark):
    edges = spark.createDataFrame([(bytes([k // 200, k % 200]), bytes([(k + 1) // 200, (k + 1) % 200])) for k in range(500)], "a binary, b binary")
    rows = simhash.components(spark, edges).collect()
    assert len(rows) == 500 and {bytes(r.root) for r in rows} == {b"\0\0"}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, `a.b` int"


def test_keep_one(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    rows, copies = [], set()
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([80, 300, 900]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(k % 3):
            near = list(base)
            for _ in range(max(1, len(base) // 100)):
                near[rng.randrange(len(near))] = rng.choice(words)
            copies.add(len(rows))
            rows.append((len(rows), " ".join(near)))
    other = " ".join(rng.choice(words) for _ in range(90))
    odd = [(None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (5000, other), (5000, "quite another text of the same id"), (5000, other), (6000, None), (6001, ""), (6002, " \n"), (6003, "One two three"), (6004, "one TWO three"), (6005, "one two four")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x", 2) for d, t in rows + odd], COLUMNS).repartition(5)
    got = simhash.keep_one(spark, docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted([d for d, _ in rows if d not in copies] + [None, 5000, 5000, 6000, 6003, 6005], key=str)
    assert {r.text for r in got.filter("doc_id = 5000").collect()} == {other, "quite another text of the same id"}
    assert simhash.keep_one(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("scattered", [False, True])
def test_recall_by_similarity(spark, scattered):
    """Planted pairs at 0.8, 0.85 and 0.9, replaced at the end or all over; pairs below 0.8 stay."""
    rng = random.Random(5)

    def sets(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    rows, gone = [], {0.8: set(), 0.85: set(), 0.9: set()}
    for k in range(400):
        base = [f"w{rng.getrandbits(30)}" for _ in range(rng.choice([104, 304]))]
        near, aim = list(base), (0.8, 0.85, 0.9, 0.74)[k % 4]
        order = rng.sample(range(len(base)), len(base)) if scattered else range(len(base) - 1, -1, -1)
        a = sets(" ".join(base))
        for at in order:
            was, near[at] = near[at], f"w{rng.getrandbits(30)}"
            b = sets(" ".join(near))
            if len(a & b) < aim * len(a | b):
                near[at] = was
                if not scattered:
                    break
        b = sets(" ".join(near))
        real = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        if k % 4 == 3:
            assert real < 0.8
        else:
            assert aim <= real < aim + 0.05
            gone[aim].add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(spark, docs).collect()}
    found = {aim: 1 - len(ids & kept) / len(ids) for aim, ids in gone.items()}
    print("found", scattered, found)
    assert kept >= {d for d, _ in rows} - set().union(*gone.values())
    assert found[0.8] >= 0.95 and found[0.85] >= 0.98 and found[0.9] == 1


def test_a_group_hangs_together_by_its_middle(spark):
    """Copies of one text that are alike to it but not to one another are one group, and few pairs are counted."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(400)]
    rows = [(500, " ".join(base))]
    for k in range(300):
        near = list(base)
        for at in rng.sample(range(0, 400, 5), 8):
            near[at] = f"v{rng.getrandbits(30)}"
        rows.append((k, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(spark, docs).collect()}
    assert 0 in kept and len(kept) <= 7


def test_shared_counts(spark):
    sets = {b"a": [1, 2, 3], b"b": [3, 4], b"c": [5], b"d": [], b"e": [4, 3, 2**32 - 1]}
    rows = [(fp, simhash.packed(np.diff(np.array(sorted(x), np.uint32), prepend=np.uint32(0)).astype(np.uint32))) for fp, x in sets.items()]
    got = {bytes(r.fp): (r.size, r.shared) for r in simhash.shared_counts(spark, spark.createDataFrame(rows, "fp binary, shingles binary")).collect()}
    assert got == {b"a": (3, 1), b"b": (2, 2), b"c": (1, 0), b"d": (0, 0), b"e": (3, 2)}


def test_pairs_come_from_one_shard(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    prints = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, (40, 4), dtype=np.uint64)), base ^ np.uint64(1)])
    rows = [(p.tobytes(), k, 100, 100) for k, p in enumerate(prints)]
    keys = simhash.sampled_keys(120, 256, simhash.AGREE)
    got = [(bytes(r.a), bytes(r.b)) for r in simhash.link_edges(spark.createDataFrame(rows, "fp binary, label long, size long, shared long").repartition(3), keys, 30, simhash.pair_edges).collect()]
    assert len(got) == len(set(got)) == 120
