"""A modified Kneser-Ney model of word bigrams, counted by Spark and kept in sorted arrays of hashes.

The model is interpolated, of order 2, one for each language, and counts all texts that pass the base rules. A bigram's count
is the number of different copy classes that hold it: texts share a class where the smallest hash of their windows is the
same, so exact copies always do and near copies mostly. There are ``VIEWS`` ways to hash windows, each with classes of its
own, and the least of their counts is taken: near copies that share a class in any view count once. A text is part of the
corpus it is scored against and would be predicted by itself; each count is therefore taken without the text's own class,
that is, less one. Words without a letter or digit are context, but are not themselves scored.

First every text's words are counted. A word that two classes hold is known and gets a number, its place in the sorted array
of the words' hashes; the others are unknown words of their language, of which only the number is kept. At most
``VOCABULARY`` words, the most frequent ones, have a number, so the array is small enough to send to every task. Known words
beyond these are rare words: the texts that hold them get them by a join, and bigrams with a rare word are rows, which Spark
counts and prices by grouping and joining. The result is that of one vocabulary, whatever its size.

Then a task sends the bigrams of a block of texts to their shards. A shard gets, for each block, one packed array of sorted
bigrams beside the texts of the block that hold them, so a bigram costs four bytes or so where a row would cost thirty. It
counts the classes of each bigram, and what the counts say of contexts and continuations is added up by word. Once that has
been sent to all, the same shards (the shuffle is kept, not repeated) add up what their bigrams cost each text. Costs are
whole numbers, in millionths, whose sums do not depend on their order.

Bigrams go by the hash of their first word, those of a very frequent first word by that of both, and those of two very
frequent words, which may stand in every text, by the class of the text in the first view, their counts in it being added up
afterwards. So no shard has to take what one word, or one pair of words, brings.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import forget, reread, row_key, small_batches, work_path

VIEWS = 3
#: Words that have a number at most, and how many of the most frequent count as very frequent.
VOCABULARY, COMMON = 1 << 22, 1024
#: Pairs of a bigram and a text that a shard gets, about, and how many shards travel together.
PAIRS, TOGETHER = 1_000_000, 4
#: A block ends behind so many words, or texts.
BLOCK_WORDS, BLOCK_TEXTS = 1_000_000, 1 << 16
#: Words that a task holds before it merges them.
HELD = 1_000_000
#: Bytes of texts that are cut into words at once.
SLICE = 1 << 18
#: Numbers of words have so many bits; classes inside a shard, and texts inside a block, have ``SMALL``.
ID_BITS, SMALL = 24, 16
ID_MASK, SMALL_MASK = np.uint64((1 << ID_BITS) - 1), np.uint64((1 << SMALL) - 1)
#: Words whose numbers share the upper bits are added up together.
RANGE = 1 << 16
#: Classes that several texts have, of which all tasks are told.
SHARED = 1 << 22
#: Of estimates: numbers of classes that are checked in all views, and those that are counted again by 24 bits.
FINE, MANY = 16, 4096
UPPER = 8
START, UNKNOWN, RARE = 0x5BD1E995A5A4, 0x2545F4914F6C, 0x1B873593CC9E
FIELDS = ("total", "types", "n1", "n2", "n3", "n4", "before")


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- packed arrays


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one dimension, byte planes apart: the upper bytes of small numbers take next to no room."""
    planes = [(c.dtype.str, len(c), np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpacked(data: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.empty(0, kind) for kind, n, p in planes]


class Sent:
    """Arrays travel packed: every executor and its workers keep a copy of what is broadcast on disk."""

    def __getstate__(self) -> dict:
        return {k: (True, packed(v)) if isinstance(v, np.ndarray) and v.ndim == 1 else (False, v) for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({k: unpacked(v)[0] if is_packed else v for k, (is_packed, v) in state.items()})


# -- words of texts


def _powers(of: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, of, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


FACTOR = 0x9E3779B97F4A7C15
DOWN, UP = _powers(FACTOR, 2 * SLICE), _powers(pow(FACTOR, -1, 1 << 64), 2 * SLICE)
#: A number for each byte, whether it is white space, and whether it makes a word a proper one: letters, digits, all beyond ASCII.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
SPACE, PROPER = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PROPER[[k for k in range(256) if k > 127 or chr(k).isalnum()]] = True


def _slice_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and code of every word. A word's hash is a sum over its bytes, each times a power of its place, so all words'
    sums come from the running sum of the whole."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[False], ~SPACE[raw], [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    down, up = (DOWN, UP) if len(raw) < len(DOWN) else (_powers(FACTOR, len(raw)), _powers(pow(FACTOR, -1, 1 << 64), len(raw)))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * down[: len(raw)], out=sums[1:])
    proper = np.concatenate([[0], np.cumsum(PROPER[raw], dtype=np.int32)])
    hashes = mix((sums[ends] - sums[starts]) * up[starts])
    return starts, hashes & ~np.uint64(1) | (proper[ends] > proper[starts]).astype(np.uint64)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of texts, one behind the other, odd if the word has a letter or digit; and how many words
    each text has. Long texts are cut at white space, so that memory stays bounded."""
    codes, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) < SLICE):
            size, end = size + len(texts[end]) + 1, end + 1
        if end == at + 1:
            rest = texts[at]
            while rest:
                here = len(rest)
                if here > SLICE:
                    here = next((k for k in range(SLICE, here) if SPACE[rest[k]]), here)
                starts, found = _slice_codes(rest[:here])
                codes.append(found)
                counts[at] += len(found)
                rest = rest[here:]
        else:
            starts, found = _slice_codes(b"\n".join(texts[at:end]))
            codes.append(found)
            begin = np.cumsum([0, *(len(x) + 1 for x in texts[at:end])])
            counts[at:end] = np.diff(np.searchsorted(starts, begin))
        at = end
    return np.concatenate(codes) if codes else np.empty(0, np.uint64), counts


def lang_code(lang: str | None) -> int:
    """An even number of 48 bits."""
    return 0 if lang is None else xxhash.xxh64_intdigest(lang.encode(), 7) >> 17 << 1


def lang_words(codes: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """48-bit numbers of words that differ from language to language; ``langs``: the code of each word's language."""
    return (codes >> np.uint64(17) << np.uint64(1) | codes & np.uint64(1)) ^ langs


def copy_classes(codes: np.ndarray, counts: np.ndarray, views: int = VIEWS) -> np.ndarray:
    """In each view 32 bits that texts share which are copies: the smallest hash of four consecutive words. (texts, views)"""
    out = np.zeros((len(counts), views), np.uint32)
    ends = np.cumsum(counts)
    for k in np.flatnonzero((counts > 0) & (counts < 4)).tolist():
        out[k] = int(mix(codes[ends[k] - counts[k] : ends[k]].sum(keepdims=True))[0]) >> 32
    long = np.flatnonzero(counts >= 4)
    if len(long):
        windows = np.append(codes[:-3] + np.uint64(3) * codes[1:-2] + np.uint64(5) * codes[2:-1] + np.uint64(7) * codes[3:], np.uint64(0))
        bounds = np.stack([ends[long] - counts[long], ends[long] - 3], axis=1).ravel()
        for view in range(views):
            out[long, view] = (np.minimum.reduceat(mix(windows + np.uint64(view)), bounds)[::2] >> np.uint64(32)).astype(np.uint32)
    return out


def _texts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, list[bytes], list]]:
    """(languages, texts, rows of the other columns) of about ``SLICE`` bytes at a time."""
    for batch in batches:
        langs, texts, rest = [], [], []
        size = 0
        for k in range(batch.num_rows):
            data = (batch.column("text")[k].as_py() or "").encode()
            langs.append(batch.column("lang")[k].as_py())
            texts.append(data)
            rest.append(tuple(batch.column(n)[k].as_py() for n in names))
            size += len(data)
            if size >= SLICE:
                yield langs, texts, rest
                langs, texts, rest, size = [], [], [], 0
        if texts:
            yield langs, texts, rest


# -- vocabulary


def _merge_words(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Different words, sorted, with a class of theirs, whether they have several, and the number of their texts."""
    words, of, several, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(words, kind="stable")
    words, of = words[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])[: len(words)])
    if not len(first):
        return words, of, several, texts
    low, high = np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)
    return words[first], low, (low != high) | np.logical_or.reduceat(several[order], first), np.add.reduceat(texts[order], first)


def count_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``word`` and ``n``, its texts, of every word that two classes hold; a null word beside the number of the
    others. Each task merges its own words first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found, held = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, ((words, of, several, texts),) in found.items():
                ends = np.searchsorted(words >> np.uint64(40), np.arange(257))
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    s = slice(ends[k], ends[k + 1])
                    data = packed(np.diff(words[s], prepend=np.uint64(0)), np.where(several[s], 0, of[s]).astype(np.uint32), several[s], texts[s])
                    yield pa.record_batch([pa.array([lang], pa.string()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["lang", "part", "data"])
            found.clear()

        for langs, texts, _ in _texts(batches):
            codes, counts = word_codes(texts)
            classes = copy_classes(codes, counts, 1)[:, 0]
            by_lang = np.array([lang_code(x) for x in langs], np.uint64)
            text = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
            some = np.flatnonzero(counts)
            words = np.append(lang_words(codes, by_lang[text]), by_lang[some] ^ np.uint64(START))
            text = np.append(text, some.astype(np.uint64))
            # a text is no longer than SLICE, or alone, so its number fits beside the word
            order = np.lexsort((words, text)) if len(texts) > SMALL_MASK else np.argsort(text << np.uint64(48) | words)
            words, text = words[order], text[order]
            first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (text[1:] != text[:-1])])[: len(words)])
            words, text = words[first], text[first]
            kinds = {x: k for k, x in enumerate(dict.fromkeys(langs))}
            kind = np.array([kinds[x] for x in langs])[text.astype(np.int64)]
            for lang, k in kinds.items():
                at = np.flatnonzero(kind == k)
                if len(at):
                    found[lang].append((words[at], classes[text[at].astype(np.int64)], np.zeros(len(at), bool), np.ones(len(at), np.uint32)))
                    held += len(at)
            if held >= HELD:
                for lang, parts in found.items():
                    found[lang] = [_merge_words(parts)]
                held = sum(len(x[0][0]) for x in found.values())
                if held >= HELD // 2:
                    yield from flush()
                    held = 0
        for lang, parts in found.items():
            found[lang] = [_merge_words(parts)]
        yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            words, _, known, texts = _merge_words(parts)
            yield pa.record_batch([pa.array([key[0]] * (int(known.sum()) + 1), pa.string()), pa.array([*words[known].tolist(), None], pa.int64()), pa.array([*texts[known].tolist(), int((~known).sum())], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, part, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "data")), strict=True):
                if parts and key != (lang, part):
                    yield from done()
                    parts = []
                step, of, several, texts = unpacked(data)
                key, parts = (lang, part), [*parts, (np.cumsum(step, dtype=np.uint64), np.where(several, 0, of).astype(np.uint32), several, texts)]
                if sum(len(x[0]) for x in parts) > 2 * HELD:
                    parts = [_merge_words(parts)]
        if parts:
            yield from done()

    sent = docs.select("lang", "text").mapInArrow(gather, "lang string, part int, data binary")
    return sent.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(settle, "lang string, word long, n long")


def shared_classes(spark: SparkSession, docs: DataFrame, most: int = SHARED) -> np.ndarray | None:
    """The classes that two texts or more have, sorted, a view and its 32 bits each; none where there are more than ``most``.
    A class of one text needs no name to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for _, texts, _ in _texts(batches):
            codes, counts = word_codes(texts)
            yield pa.record_batch([pa.array(class_keys(copy_classes(codes, counts)[counts > 0]).ravel().astype(np.int64))], ["key"])

    found = reread(spark, docs.select("lang", "text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared")
    return None if found.count() > most else np.sort(found.toArrow()["key"].to_numpy()).astype(np.uint64)


def class_keys(classes: np.ndarray) -> np.ndarray:
    """Classes (texts, views) with their view above their 32 bits."""
    return classes.astype(np.uint64) | np.arange(classes.shape[1], dtype=np.uint64) << np.uint64(32)


def named_classes(classes: np.ndarray, shared: np.ndarray | None) -> np.ndarray:
    """Of each class (texts, views) a number that is its own, from 1 on; 0 where no other text has it."""
    names = classes.astype(np.uint64) + np.uint64(1)
    if shared is None or not len(shared):
        return names if shared is None else np.zeros_like(names)
    keys = class_keys(classes)
    return np.where(shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys, names, np.uint64(0))


def _empty(kind) -> np.ndarray:
    return field(default_factory=lambda: np.empty(0, kind))


@dataclass
class Vocabulary(Sent):
    """Known words, sorted, as steps from one to the next, and their numbers, the most frequent first; the other arrays are in
    the order of the numbers. Every language that has a known word also has a start and an unknown word."""

    steps: np.ndarray = _empty(np.uint64)
    number: np.ndarray = _empty(np.int32)
    lang: np.ndarray = _empty(np.int32)
    unknown: np.ndarray = _empty(bool)
    proper: np.ndarray = _empty(bool)
    n_unknown: np.ndarray = _empty(np.int64)
    langs: dict = field(default_factory=dict)
    pairs: int = 0
    common: int = COMMON
    #: Where the rare words lie, if there are any.
    rare: str = ""

    @cached_property
    def words(self) -> np.ndarray:
        return np.cumsum(self.steps, dtype=np.uint64)

    def __getstate__(self) -> dict:
        self.__dict__.pop("words", None)
        return super().__getstate__()

    def numbers(self, words: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Numbers of words; ``unknown``: for each the number that stands in where it has none."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.number[at], unknown).astype(np.int64)

    def special(self, lang: str | None, which: int) -> int:
        return int(self.number[np.searchsorted(self.words, np.uint64(lang_code(lang) ^ which))])


def vocabulary(spark: SparkSession, docs: DataFrame, most: int = VOCABULARY, common: int = COMMON) -> Vocabulary:
    counted = reread(spark, count_words(docs), "words")
    known = counted.filter("word is not null")
    rare, special = "", (START, UNKNOWN)
    if (n := known.count()) > most:
        numbered = reread(spark, known.orderBy(F.desc("n"), "word").limit(most), "words")
        rare, special = work_path(spark, "rare"), (START, UNKNOWN, RARE)
        of = numbered.select(F.col("lang").alias("of_lang"), F.col("word").alias("of_word"))
        known.join(of, (F.col("word") == F.col("of_word")) & F.col("lang").eqNullSafe(F.col("of_lang")), "left_anti").select("lang", "word").write.parquet(rare)
        known = numbered
    by_lang = counted.groupBy("lang").agg(F.sum(F.when(F.col("word").isNull(), F.col("n")).otherwise(1)).alias("types"), F.sum("n").alias("texts"), F.count("word").alias("known")).filter("known > 0")
    rows = known.toArrow()
    if not n:
        return Vocabulary()
    sides = by_lang.collect()
    langs = {r.lang: k for k, r in enumerate(sorted(sides, key=lambda r: (r.lang is not None, r.lang)))}
    words = rows["word"].to_numpy().astype(np.uint64)
    texts = rows["n"].to_numpy()
    names = rows["lang"].combine_chunks().dictionary_encode(null_encoding="encode")
    of = np.array([langs[x] for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()]
    del rows, names
    markers = np.array([lang_code(x) ^ which for x in langs for which in special], np.uint64)
    new = ~np.isin(markers, words)
    words, of, texts = np.append(words, markers[new]), np.append(of, np.repeat(np.arange(len(langs), dtype=np.int32), len(special))[new]), np.append(texts, np.full(new.sum(), np.iinfo(np.int64).max))
    order = np.lexsort((words, -texts))
    words, of = words[order], of[order]
    unknown = np.isin(words, np.array([lang_code(x) ^ UNKNOWN for x in langs], np.uint64))
    proper = (words & np.uint64(1)).astype(bool) | unknown
    n_unknown = np.zeros(len(langs), np.int64)
    for r in sides:
        n_unknown[langs[r.lang]] = r.types - r.known
    number = np.argsort(words)
    return Vocabulary(np.diff(words[number], prepend=np.uint64(0)), number.astype(np.int32), of.astype(np.int32), unknown, proper, n_unknown, langs, int(sum(r.texts for r in sides)), common, rare)


def with_rare_words(docs: DataFrame, sent, rare: str) -> DataFrame:
    """``docs`` with ``rare``: those of the rare words that each text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for langs, texts, keys in _texts(batches, "key"):
            codes, counts = word_codes(texts)
            text = np.repeat(np.arange(len(texts)), counts)
            said = lang_words(codes, np.array([lang_code(x) for x in langs], np.uint64)[text])
            new = known.numbers(said, np.full(len(said), -1)) < 0
            text, said = np.unique(np.stack([text[new].astype(np.uint64), said[new]]), axis=1)
            at = text.astype(np.int64).tolist()
            yield pa.record_batch([pa.array([keys[k][0] for k in at], pa.binary()), pa.array([langs[k] for k in at], pa.string()), pa.array(said.astype(np.int64))], ["key", "of_lang", "of_word"])

    keyed = docs.withColumn("key", row_key("lang", "text"))
    new = keyed.select("lang", "text", "key").mapInArrow(run, "key binary, of_lang string, of_word long")
    words = docs.sparkSession.read.schema("lang string, word long").parquet(rare)
    held = new.join(words, (F.col("word") == F.col("of_word")) & F.col("lang").eqNullSafe(F.col("of_lang"))).groupBy("key").agg(F.collect_set("word").alias("rare"))
    return keyed.join(held, "key", "left").drop("key")


# -- bigrams, to their shards


class Block:
    """Texts of a task whose bigrams leave it together."""

    def __init__(self, number: int, words: Vocabulary, shards: int, common_shards: int, shared: np.ndarray | None):
        self.number, self.words, self.shards, self.common_shards, self.shared = number, words, shards, common_shards, shared
        self.codes, self.sizes, self.langs, self.classes, self.facts, self.rare = [], [], [], [], [], []
        self.held = 0

    def add(self, codes: np.ndarray, counts: np.ndarray, langs: list, facts: list[tuple], rare: list) -> None:
        """Texts; those with a count of 0 have no bigrams to be counted. ``rare``: rare words that they hold."""
        self.rare += rare
        self.codes.append(codes)
        self.sizes.append(counts)
        self.langs += langs
        self.classes.append(copy_classes(codes, counts))
        self.facts += facts
        self.held += len(codes)

    @property
    def full(self) -> bool:
        return self.held >= BLOCK_WORDS or len(self.facts) >= BLOCK_TEXTS // 2

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Bigram, text and how often the text holds it, sorted by both; and text, language and both words of every place of a
        bigram with a rare word, which stands as the negative of itself and 1."""
        sizes = np.concatenate(self.sizes)
        special = (START, UNKNOWN, RARE) if self.words.rare else (START, UNKNOWN)
        place = {x: (lang_code(x), self.words.langs[x], *(self.words.special(x, which) for which in special)) for x in set(self.langs) & set(self.words.langs)}
        code, lang, start, unknown, *other = (np.array([place[x][k] if x in place else 0 for x in self.langs], np.int64 if k else np.uint64) for k in range(2 + len(special)))
        text = np.repeat(np.arange(len(sizes)), sizes)
        said = lang_words(np.concatenate(self.codes), code[text])
        v = self.words.numbers(said, unknown[text])
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        if self.rare:
            # only what has no number is looked for among the rare words
            rare = (v == unknown[text]) & np.isin(said, np.array(self.rare, np.uint64))
            v = np.where(rare, -1 - said.astype(np.int64), v)
        u = np.empty_like(v)
        u[1:] = v[:-1]
        u[begin] = start[sizes > 0]
        rows = np.flatnonzero((u < 0) | (v < 0))
        rows = text[rows], lang[text[rows]], u[rows], v[rows]
        if len(rows[0]):
            plain = (u >= 0) & (v >= 0)
            u, v, text = u[plain], v[plain], text[plain]
        key = np.sort(((u << ID_BITS | v) << SMALL | text).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        return key[first] >> np.uint64(SMALL), key[first] & SMALL_MASK, np.diff(np.append(first, len(key))), rows

    def shard_of(self, gram: np.ndarray, of: np.ndarray) -> np.ndarray:
        u, most = gram >> np.uint64(ID_BITS), np.uint64(self.words.common)
        first, n = u < most, np.uint64(self.shards)
        return np.where(first & (gram & ID_MASK < most), n + of % np.uint64(self.common_shards), mix(np.where(first, gram, u)) % n).astype(np.int32)

    def rows(self) -> pa.RecordBatch:
        """part, block and data: the facts of the texts, and for each part the classes of the texts and its shards' bigrams."""
        rows = [(-1 - self.number % self.shards, pickle.dumps(self.facts))]
        if self.held:
            gram, text, times, rare = self.pairs()
            of = np.concatenate(self.classes)
            classes, names = mix(of), named_classes(of, self.shared)
            if len(rare[0]):
                rows.append((-1 - self.shards - self.number % self.shards, packed(*rare, *(of[rare[0], k] for k in range(VIEWS)))))
            shard = self.shard_of(gram, classes[text, 0] >> np.uint64(SMALL))
            order = np.argsort(shard, kind="stable")
            parts, there = defaultdict(dict), defaultdict(list)
            for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                own = int(shard[at[0]])
                parts[own // TOGETHER][own] = packed(np.diff(gram[at], prepend=np.uint64(0)), text[at].astype(np.uint16), (times[at] - 1).astype(np.uint32))
                there[own // TOGETHER].append(text[at])
            # a part gets the classes of the texts that it has bigrams of, so however many parts there are, no more than a pair a class
            for part, found in parts.items():
                texts = np.unique(np.concatenate(there[part])).astype(np.int64)
                rows.append((part, pickle.dumps((packed(np.diff(texts, prepend=0).astype(np.uint16), *names[texts].T), found))))
        parts, data = zip(*rows, strict=True)
        return pa.record_batch([pa.array(parts, pa.int32()), pa.array([self.number] * len(parts), pa.int64()), pa.array(data, pa.binary())], ["part", "block", "data"])


# -- shards


def held_by(blocks: list[list[np.ndarray]], views: int = VIEWS) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of a shard, sorted, and in how many classes each is, the least of the views. Texts whose class no other has
    are counted as they are, of the other classes the different ones."""
    grams = np.concatenate([x[0] for x in blocks])
    found = np.sort(grams)
    found = found[np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]]
    at, n = np.searchsorted(found, grams), None
    del grams
    texts = np.bincount(at, minlength=len(found))
    for k in range(views):
        of = np.concatenate([x[3 + k][x[1]] for x in blocks])
        some = np.flatnonzero(of)
        where = at[some]
        several = np.sort(where.astype(np.uint64) << np.uint64(33) | of[some])
        several = several[np.concatenate([[True], several[1:] != several[:-1]])[: len(several)]]
        seen = texts - np.bincount(where, minlength=len(found)) + np.bincount((several >> np.uint64(33)).astype(np.int64), minlength=len(found))
        n = seen if n is None else np.minimum(n, seen)
    return found, n


def counted(blocks: list[list[np.ndarray]], views: int = VIEWS) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of a shard, sorted, and an estimate of how many classes each is in, where no more than bits of classes are
    there; the model counts by ``held_by``.

    Classes are told apart by 16 bits, and their number is taken from how many of these occur: for small numbers, up to
    ``FINE`` of which the other views check, exactly, for ``MANY`` within 0.3 %. Bigrams of ``MANY`` classes or more are
    counted again by ``UPPER`` further bits of the first view: within 0.02 % for a million and for 5 million, 0.1 % for 60
    million; the count ends at 279 million classes of one bigram in one shard."""
    n = None
    for k in range(views):
        keys = np.concatenate([g << np.uint64(SMALL) | c[k][t] for g, t, _, *c in blocks])
        keys.sort()
        gram = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> np.uint64(SMALL)
        del keys
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        seen = np.diff(np.append(first, len(gram)))
        gram = gram[first]
        full = 1 << (8 if k else SMALL)
        seen = np.rint(-full * np.log1p(-np.minimum(seen, full - 1) / full)).astype(np.int64)
        n = seen if n is None else np.where(n <= FINE, np.minimum(n, seen), n)
    if (n >= MANY).any() and all(len(x) > 3 + VIEWS for x in blocks):
        n[n >= MANY] = _by_more_bits(blocks, gram[n >= MANY])
    return gram, n


def _by_more_bits(blocks: list[list[np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """Classes of each of these (sorted) bigrams in the first view, told apart by 24 bits."""
    keys = []
    for g, t, _, *c in blocks:
        at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        there = grams[at] == g
        keys.append(at[there].astype(np.uint64) << np.uint64(SMALL + UPPER) | (c[VIEWS] << np.uint64(SMALL) | c[0])[t[there]])
    seen = np.bincount((np.unique(np.concatenate(keys)) >> np.uint64(SMALL + UPPER)).astype(np.int64), minlength=len(grams))
    full = 1 << (SMALL + UPPER)
    return np.rint(-full * np.log1p(-np.minimum(seen, full - 1) / full)).astype(np.int64)


def tallies(gram: np.ndarray, n: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, of ``FIELDS`` the numbers of each): of a context its bigrams, by count; of a word those that end in it.
    An unknown word is a different one each time."""
    u, v = (gram >> np.uint64(ID_BITS)).astype(np.int32), (gram & ID_MASK).astype(np.int32)
    many = unknown[v]
    out = []
    for words, fields in ((u, {0: lambda: n, 1: lambda: np.where(many, n, 1), 2: lambda: np.where(many, n, n == 1), **{k + 1: lambda k=k: ~many & (n == k) for k in (2, 3, 4)}}), (v, {6: lambda: np.where(unknown[u], n, 1)})):
        order = np.argsort(words, kind="stable")
        ids = words[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
        sums = np.zeros((len(FIELDS), len(first)), np.int64)
        for k, values in fields.items():
            sums[k] = np.add.reduceat(values()[order], first, dtype=np.int64) if len(first) else 0
        out.append((ids[first].astype(np.int64), sums))
    return np.concatenate([x for x, _ in out]), np.hstack([x for _, x in out])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(n)[k].as_py() for n in names)


def _shards(rows: Iterator[tuple]) -> Iterator[tuple[int, list[tuple[int, list[np.ndarray]]]]]:
    """(shard, its blocks) of rows (block, data); one shard at a time is unpacked."""
    found = defaultdict(list)
    for block, data in rows:
        classes, shards = pickle.loads(data)
        for shard, own in shards.items():
            found[shard].append((block, classes, own))
    for shard in list(found):
        blocks = []
        for block, classes, data in sorted(found.pop(shard), key=lambda x: x[0]):
            step, text, times = unpacked(data)
            texts, *small = unpacked(classes)
            texts, spread = np.cumsum(texts, dtype=np.int64), []
            for c in small:
                spread.append(np.zeros(texts[-1] + 1, np.uint64))
                spread[-1][texts] = c
            blocks.append((block, [np.cumsum(step, dtype=np.uint64), text, times, *spread]))
        yield shard, blocks


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, packed sums) of rows (part, packed ids and values)."""
    sums: dict[int, np.ndarray] = {}
    for part, data in _rows(batches, "part", "data"):
        ids, *values = unpacked(data)
        size = COMMON * COMMON if part < 0 else RANGE
        if part not in sums:
            sums[part] = np.zeros((len(values), size), np.int64)
        for total, x in zip(sums[part], values, strict=True):
            np.add.at(total, ids, x)
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([packed(*x) for x in sums.values()], pa.binary())], ["part", "data"])


def shuffled_once(frame: DataFrame) -> DataFrame:
    """``frame``, whose last shuffle is made now and read by every job that uses the result, instead of once a job."""
    session = frame.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(frame._jdf.queryExecution().toRdd(), frame._jdf.schema(), False), session)


@dataclass
class Model(Sent):
    """What contexts and words say, by number."""

    total: np.ndarray
    back: np.ndarray
    low: np.ndarray
    cuts: np.ndarray
    both_common: np.ndarray
    low_cuts: np.ndarray
    whole: np.ndarray
    new: np.ndarray

    def cost(self, words: Vocabulary, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Negative log probabilities, in millionths, of bigrams that ``n`` classes hold, one of them the text's own."""
        u, v = gram >> np.uint64(ID_BITS), gram & ID_MASK
        others = n - 1
        cut = self.cuts[words.lang[u], np.clip(others, 0, 3)]
        seen = np.where((others > 0) & ~words.unknown[v], (others - cut) / np.maximum(self.total[u], 1), 0.0)
        p = np.where(words.unknown[u], self.low[v], seen + self.back[u] * self.low[v])
        return np.where(words.proper[v], np.rint(-1e6 * np.log(np.maximum(p, 1e-12))), 0).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """(0, D1, D2, D3) of each row of (n1, n2, n3, n4); where counts of counts are missing, half below the count."""
    n = n.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = n[:, 0] / (n[:, 0] + 2 * n[:, 1])
        raw = [k - (k + 1) * y * n[:, k] / n[:, k - 1] for k in (1, 2, 3)]
    return np.stack([np.zeros(len(n)), *(np.clip(np.where(np.isfinite(d), d, k - 0.5), 0.1, k - 0.1) for k, d in enumerate(raw, 1))], axis=1)


def settle(words: Vocabulary, sums: np.ndarray, both_common: np.ndarray, rare: dict[str, np.ndarray]) -> Model:
    """The model from the sums of all shards; ``sums``: of ``FIELDS`` the numbers of each word, to which is added; ``rare``: what
    the rare words of each language add."""
    grid = np.flatnonzero(both_common)
    gram = (grid // COMMON << ID_BITS | grid % COMMON).astype(np.uint64)
    at, more = tallies(gram, both_common[grid], words.unknown)
    for total, x in zip(sums, more, strict=True):
        np.add.at(total, at, x)
    total, types, n1, n2, n3, n4, before = sums
    n_langs, lang, real = len(words.langs), words.lang, ~words.unknown
    by_lang = lambda x: np.bincount(lang, x, n_langs)
    more = lambda name: rare.get(name, 0)
    cuts = discounts(np.stack([by_lang(x) + more(f"n{k}") for k, x in enumerate((n1, n2, n3, n4), 1)], axis=1))
    low_cuts = discounts(np.stack([by_lang(real & (before == k)) + (k == 1) * words.n_unknown + more(f"b{k}") for k in (1, 2, 3, 4)], axis=1))
    whole = by_lang(np.where(real, before, 0)) + words.n_unknown + more("before")
    part = np.where(real, before - low_cuts[lang, np.clip(before, 0, 3)], 0.0)
    n_types = by_lang(real & (before > 0)) + words.n_unknown + more("types")
    parts = by_lang(part) + more("before") - low_cuts[:, 1] * more("b1") - low_cuts[:, 2] * more("b2") - low_cuts[:, 3] * (more("types") - more("b1") - more("b2"))
    new = (1 - parts / np.maximum(whole, 1)) / (n_types + 1)
    mass = cuts[lang, 1] * n1 + cuts[lang, 2] * n2 + cuts[lang, 3] * (types - n1 - n2)
    back = np.where(total > 0, mass / np.maximum(total, 1), 1.0)
    low = part / np.maximum(whole, 1)[lang] + new[lang]
    return Model(total, back.astype(np.float32), low.astype(np.float32), cuts, both_common, low_cuts, whole, new)


# -- bigrams with a rare word


@dataclass
class Rare:
    """Places of bigrams with a rare word (block, text, lang, u, v and the classes of the text), in how many classes each bigram
    is, and ``FIELDS`` of their first and second words. Rare words are negative, others have their number."""

    places: DataFrame
    grams: DataFrame
    contexts: DataFrame
    ends: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, dealt: DataFrame, words: Vocabulary, shards: int) -> Rare:
        names = ["block", "text", "lang", "u", "v", *(f"c{k}" for k in range(VIEWS))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, block, data in _rows(batches, "part", "block", "data"):
                if part < -shards:
                    columns = unpacked(data)
                    yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (np.full(len(columns[0]), block), *columns)], names)

        places = dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))
        n, unknown = F.col("n"), np.flatnonzero(words.unknown).tolist()
        grams = reread(spark, places.groupBy("lang", "u", "v").agg(F.least(*(F.count_distinct(f"c{k}") for k in range(VIEWS))).alias("n")), "rare-grams")
        many, whole = F.col("v").isin(unknown), lambda c: F.sum(c.cast("long"))
        fields = {"total": n, "types": F.when(many, n).otherwise(1), "n1": F.when(many, n).otherwise((n == 1).cast("long")), **{f"n{k}": ~many & (n == k) for k in (2, 3, 4)}}
        contexts = grams.groupBy("lang", "u").agg(*(whole(c).alias(name) for name, c in fields.items()))
        ends = grams.groupBy("lang", "v").agg(whole(F.when(F.col("u").isin(unknown), n).otherwise(1)).alias("before"))
        return cls(places, grams, reread(spark, contexts, "rare-contexts"), reread(spark, ends, "rare-ends"))

    def add_to(self, sums: np.ndarray, n_langs: int) -> dict[str, np.ndarray]:
        """Adds what words with a number get to ``sums``; what rare words add to their languages."""
        for frame, word in ((self.contexts, "u"), (self.ends, "v")):
            rows = frame.filter(F.col(word) >= 0).toArrow()
            for k, name in enumerate(FIELDS):
                if name in rows.column_names:
                    np.add.at(sums[k], rows[word].to_numpy(), rows[name].to_numpy())
        before = F.col("before")
        said = [
            self.contexts.filter("u < 0").groupBy("lang").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4))),
            self.ends.filter("v < 0").groupBy("lang").agg(F.sum("before").alias("before"), F.count("*").alias("types"), *(F.count_if(before == k).alias(f"b{k}") for k in (1, 2, 3, 4))),
        ]
        out: dict[str, np.ndarray] = {}
        for frame in said:
            rows = frame.toArrow()
            for name in rows.column_names[1:]:
                out[name] = np.zeros(n_langs, np.int64)
                out[name][rows["lang"].to_numpy()] = rows[name].to_numpy()
        return out

    def costs(self, sent, model) -> DataFrame:
        """(block, text, cost) of the bigrams with a rare word that each text holds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, m = sent.value, model.value
            for batch in batches:
                lang, u, v, n, total, types, n1, n2, before = (batch.column(x).to_numpy() for x in ("lang", "u", "v", "n", "total", "types", "n1", "n2", "before"))
                own_u, own_v, to_u, to_v, cuts, others = u < 0, v < 0, np.maximum(u, 0), np.maximum(v, 0), m.cuts[lang], n - 1
                back = np.where(own_u, (cuts[:, 1] * n1 + cuts[:, 2] * n2 + cuts[:, 3] * (types - n1 - n2)) / np.maximum(total, 1), m.back[to_u])
                low = np.where(own_v, (before - m.low_cuts[lang, np.clip(before, 0, 3)]) / np.maximum(m.whole[lang], 1) + m.new[lang], m.low[to_v])
                seen = np.where((others > 0) & (own_v | ~known.unknown[to_v]), (others - m.cuts[lang, np.clip(others, 0, 3)]) / np.maximum(np.where(own_u, total, m.total[to_u]), 1), 0.0)
                p = np.where(~own_u & known.unknown[to_u], low, seen + back * low)
                cost = np.where(np.where(own_v, (-1 - v) & 1 == 1, known.proper[to_v]), np.rint(-1e6 * np.log(np.maximum(p, 1e-12))), 0)
                yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (lang, u, v, cost)], ["lang", "u", "v", "cost"])

        whole = self.grams.join(self.contexts.filter("u < 0"), ["lang", "u"], "left").join(self.ends.filter("v < 0"), ["lang", "v"], "left").na.fill(0)
        priced = whole.mapInArrow(run, "lang long, u long, v long, cost long")
        return self.places.join(priced, ["lang", "u", "v"]).groupBy("block", "text").agg(F.sum("cost").alias("cost"))


def text_costs(spark: SparkSession, docs: DataFrame, facts_of, most: int = VOCABULARY, pairs: int = PAIRS) -> DataFrame:
    """``data``: pickled lists of the facts of texts, each with the number of words scored and their cost behind it: null
    where it has no language model.

    ``docs`` has ``lang``, ``text`` and other columns; ``facts_of(texts, codes, counts, rows)`` gives, for texts with the
    codes of their words and the rows of their other columns, facts and whether each text counts.
    """
    small_batches(spark)
    words = vocabulary(spark, docs, most)
    shards = max(TOGETHER * spark.sparkContext.defaultParallelism, -(-words.pairs // pairs))
    common_shards = -(-shards // 2)
    sent = spark.sparkContext.broadcast(words)
    names = [c for c in docs.columns if c not in ("lang", "text")]
    shared = shared_classes(spark, docs)
    told = spark.sparkContext.broadcast(None if shared is None else packed(np.diff(shared, prepend=np.uint64(0))))
    if words.rare:
        docs = with_rare_words(docs, sent, words.rare)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, number = sent.value, TaskContext.get().partitionId() << 32
        several = None if told.value is None else np.cumsum(unpacked(told.value)[0], dtype=np.uint64)
        block = Block(number, known, shards, common_shards, several)
        for langs, texts, rows in _texts(batches, *names, *(["rare"] if known.rare else [])):
            rare = [w for row in rows for w in row[-1] or ()] if known.rare else []
            rows = [row[: len(names)] for row in rows]
            codes, counts = word_codes(texts)
            facts, fine = facts_of(texts, codes, counts, rows)
            counts_of = np.where(fine & np.array([x in known.langs for x in langs], bool), counts, 0)
            codes = codes[np.repeat(counts_of > 0, counts)]
            scored = np.diff(np.concatenate([[0], np.cumsum(codes & np.uint64(1))])[np.concatenate([[0], np.cumsum(counts_of)])].astype(np.int64))
            block.add(codes, counts_of, langs, [(lang, *f, n) for lang, f, n in zip(langs, facts, scored.tolist(), strict=True)], rare)
            if block.full:
                yield block.rows()
                block = Block(block.number + 1, known, shards, common_shards, several)
        if block.facts:
            yield block.rows()

    dealt = shuffled_once(docs.mapInArrow(gather, "part int, block long, data binary").repartition(-(-(shards + common_shards) // TOGETHER), "part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for shard, blocks in _shards((block, data) for part, block, data in _rows(batches, "part", "block", "data") if part >= 0):
            gram, n = held_by([x for _, x in blocks], VIEWS if shard < shards else 1)
            if shard >= shards:
                out = [(-1, packed((gram >> np.uint64(ID_BITS)) * np.uint64(COMMON) + (gram & ID_MASK), n))]
            else:
                ids, values = tallies(gram, n, known.unknown)
                del gram, n, blocks
                order = np.argsort(ids, kind="stable")
                ids, values = ids[order], values[:, order]
                out = [(int(ids[at[0]] // RANGE), packed((ids[at] % RANGE).astype(np.uint16), *values[:, at])) for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids // RANGE)) + 1)]
            parts, data = zip(*out, strict=True)
            yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    ranges = -(-max(1, len(words.words)) // RANGE)
    sums, both_common = np.zeros((len(FIELDS), ranges * RANGE), np.int64), np.zeros(COMMON * COMMON, np.int64)
    for part, data in dealt.mapInArrow(count, "part int, data binary").repartition(ranges + 1, "part").mapInArrow(added_up, "part int, data binary").collect():
        if part < 0:
            both_common = unpacked(data)[0]
        else:
            sums[:, part * RANGE : (part + 1) * RANGE] = np.stack(unpacked(data))
    rare = Rare.of(spark, dealt, words, shards) if words.rare else None
    added = rare.add_to(sums, len(words.langs)) if rare else {}
    model = spark.sparkContext.broadcast(settle(words, sums[:, : len(words.words)], both_common, added))
    del sums, both_common

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m, held = sent.value, model.value, []
        row = lambda block, facts, data: pa.record_batch([pa.array([block], pa.int64()), pa.array([facts]), pa.array([data], pa.binary())], ["block", "facts", "data"])
        for part, block, data in _rows(batches, "part", "block", "data"):
            if part < -shards:
                continue
            if part < 0:
                yield row(block, True, data)
            else:
                held.append((block, data))
        for shard, blocks in _shards(held):
            if shard >= shards:
                gram = np.unique(np.concatenate([x[0] for _, x in blocks]))
                n = m.both_common[(gram >> np.uint64(ID_BITS)) * np.uint64(COMMON) + (gram & ID_MASK)]
            else:
                gram, n = held_by([x for _, x in blocks])
            each = m.cost(known, gram, n)
            for block, (own, text, times, *_) in blocks:
                cost = each[np.searchsorted(gram, own)] * (times.astype(np.int64) + 1)
                texts, place = np.unique(text, return_inverse=True)
                out = np.zeros(len(texts), np.int64)
                np.add.at(out, place, cost)
                yield row(block, False, packed(np.diff(texts.astype(np.int64), prepend=0).astype(np.uint16), out))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, costs = {}, {}
        for block, is_facts, data in _rows(batches, "block", "facts", "data"):
            if is_facts:
                facts[block] = pickle.loads(data)
            else:
                step, more = unpacked(data)
                texts, had = np.cumsum(step, dtype=np.int64), costs.get(block, np.zeros(0, np.int64))
                costs[block] = np.append(had, np.zeros(max(0, texts[-1] + 1 - len(had)), np.int64))
                costs[block][texts] += more
        for block, texts in facts.items():
            had = costs.get(block, np.zeros(0, np.int64)).tolist()
            cost = had + [0] * (len(texts) - len(had))
            yield pa.record_batch([pa.array([pickle.dumps([(*f, c if f[-1] else None) for f, c in zip(texts, cost, strict=True)])], pa.binary())], ["data"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, text, cost = (batch.column(c).to_numpy() for c in ("block", "text", "cost"))
            order = np.lexsort((text, block))
            for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
                yield pa.record_batch([pa.array(block[at[:1]]), pa.array([False]), pa.array([packed(np.diff(text[at], prepend=0).astype(np.uint16), cost[at])])], ["block", "facts", "data"])

    priced = dealt.mapInArrow(price, "block long, facts boolean, data binary")
    if rare:
        priced = priced.unionByName(rare.costs(sent, model).mapInArrow(gathered, "block long, facts boolean, data binary"))
    priced = priced.repartition("block")
    found = reread(spark, priced.mapInArrow(meet, "data binary"), "costs")
    for held in (sent, model, told):
        held.unpersist()
    return found
