"""Document fingerprints: threshold-scaled sketches of five-word shingles, with DataFrame functions only.

A shingle's hash has 63 bits. A sketch retains every hash below one in ``SCALE`` of their range; of a short text, which has
few of those, the ``FEWEST`` smallest. Sketches can be merged: of the union, what lies below the threshold stays, and the
smallest where that is little, which is the sketch of both texts' shingles. Since the threshold is the same for all texts, the
share of a sketch that another one holds estimates how much of the one text stands in the other, however unequal they are in
length. Two sketches are compared up to the hash to which both are whole. ``containment`` gives that share for one
direction, ``likeness`` for the smaller of the two.

Words are what stands between white space (``[^\\x20\\x09-\\x0D]+``), compared as they are written; a text of fewer than five
words is one shingle, and a text without words has an empty sketch, which is like another empty one (1) and like no other (0).

``edited_pairs`` compares every text with an edited copy and with the document behind it. Only ids and lengths are sorted for
that. Texts are shuffled once, by row, and both joins read that shuffle; of the document behind, only what is taken from
it travels on, beside its sketch.

Rows: a null text is an empty one; null ids come last; rows that share an id follow each other by the hash of their content;
rows that repeat id and text each get their result (the one behind the last of them is the next other row); other columns,
however they are called, are ignored; an empty table gives an empty one. A text is split in slices of ``SLICE`` characters, whose
sketches are merged, so its words are never all in memory at once. A slice sees ``BEYOND`` characters of the next one, to end
the shingles that begin in it; a word that reaches further is cut there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import narrow, reread, row_key
from loomline.operators.predicates import numbered

#: Words of a shingle, the share of hashes that are retained, as one in so many, and how many are at least.
WORDS, SCALE, FEWEST = 5, 8, 16
#: Characters of a text that are split at once, and how far a slice looks into the next.
SLICE, BEYOND = 1 << 20, 1 << 16
_SPACE = " \t\n\x0b\x0c\r"


def _once(value: Column) -> Column:
    """The value as a generator of one row, so that a function over an array that refers to it finds it computed."""
    return F.explode(F.array(value))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(text: Column) -> Column:
    """What stands between white space; no text, no words."""
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(bare != "", F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def _lowest(hashes: Column, scale: int) -> Column:
    """What a sketch retains of hashes, in any order: those below the threshold, or the smallest where these are few."""
    below = F.array_distinct(F.filter(hashes, lambda h: h < (1 << 63) // scale))
    return _let(below, lambda b: F.when(F.size(b) >= FEWEST, b).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, FEWEST)))


def _hashes(words: Column, first: Column, words_of: int, whole: Column, scale: int) -> Column:
    """What is retained of the shingles that begin in the ``first`` words; ``whole``: these are all, and if few one shingle."""
    shift = lambda h: F.shiftrightunsigned(h, 1)

    def of(h: Column) -> Column:
        at = lambda k: F.get(h, k)
        starts = F.slice(h, F.lit(1), F.greatest(F.least(first, F.size(h) - words_of + 1), F.lit(0)))
        long = _let(F.transform(starts, lambda x, i: shift(F.xxhash64(x, *[at(i + d) for d in range(1, words_of)]))), lambda s: _lowest(s, scale))
        short = F.array(shift(F.aggregate(h, F.lit(42).cast("long"), lambda a, w: F.xxhash64(a, w))))
        return F.when(whole & (F.size(h) < words_of) & (F.size(h) > 0), short).otherwise(long)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE, size: int | None = None, beyond: int | None = None) -> Column:
    """The sketch of a text, an ascending array of longs; null of a null text."""
    size, beyond = size or SLICE, beyond or BEYOND

    def part(k: Column) -> Column:
        # one character before the slice tells whether its first word has begun before it
        start = k * size
        before = F.when(k == 0, F.lit(" ")).otherwise(F.substring(text, start, F.lit(1)))
        inside = F.when(before.rlike("^[ \\t-\\r]$"), F.substring(text, start + 1, F.lit(size))).otherwise(F.regexp_replace(F.substring(text, start + 1, F.lit(size)), "^[^ \\t-\\r]+", ""))
        after = F.substring(text, start + size + 1, F.lit(beyond))
        return _let(inside, lambda own: _hashes(_words(F.concat(own, after)), F.size(_words(own)), words, F.lit(False), scale))

    n = F.char_length(text)
    few = _let(_words(text), lambda w: _hashes(w, F.size(w), words, F.lit(True), scale))
    many = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), part))
    # a text of few words in many slices is one shingle, as any other
    sliced = _let(many, lambda m: F.when(F.size(m) > 0, _lowest(m, scale)).otherwise(few))
    return F.when(text.isNotNull(), F.sort_array(F.when(n <= size, few).otherwise(sliced)))


def with_sketch(frame: DataFrame, text: str, name: str, words: int = WORDS, scale: int = SCALE, size: int | None = None, beyond: int | None = None) -> DataFrame:
    """``frame`` with the sketch of a text column; a generator keeps what refers to it from computing it anew."""
    return frame.select("*", _once(sketch(F.col(text), words, scale, size, beyond)).alias(name))


def merged(one: Column, other: Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles of both."""
    both = F.sort_array(F.array_union(one, other))
    below = F.filter(both, lambda h: h < (1 << 63) // scale)
    return F.when(F.size(below) >= FEWEST, below).otherwise(F.slice(both, 1, FEWEST))


def _common(one: Column, other: Column, scale: int) -> tuple[Column, Column, Column]:
    """Sizes of both sketches, and of what they share, up to the hash to which both are whole."""
    whole = lambda s: F.when(F.size(s) < FEWEST, (1 << 63) - 1).otherwise(F.greatest(F.element_at(s, -1), F.lit((1 << 63) // scale)))
    most = F.least(whole(one), whole(other))
    size = lambda s: F.size(F.filter(s, lambda h: h <= most))
    return size(one), size(other), size(F.array_intersect(one, other))


def containment(one: Column, other: Column, scale: int = SCALE) -> Column:
    """Share of the shingles of ``one`` that ``other`` holds; 0 where there are none to go by, 1 for two empty sketches."""
    size, _, shared = _common(one, other, scale)
    return F.when((F.size(one) == 0) & (F.size(other) == 0), 1.0).when(size == 0, 0.0).otherwise(shared / size)


def likeness(one: Column, other: Column, scale: int = SCALE) -> Column:
    """Share of the smaller one's shingles that the other one holds; alike in both directions."""
    return F.greatest(containment(one, other, scale), containment(other, one, scale))


def printed(sketch: Column) -> Column:
    """Hashes as 16 hex digits each, behind one another."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def edited_pairs(spark: SparkSession, docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited (the text whose last third is taken from the document behind it), sketch, edited_sketch and
    next_sketch of every row. Behind a document stands the one with the next smaller id, behind the last one the first."""
    rows = narrow(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    order = numbered(rows.select("doc_id", "key", F.char_length("text").cast("long").alias("n_chars")), [F.desc_nulls_last("doc_id"), F.asc("key")], "at")
    runs = reread(spark, order.groupBy("key", "doc_id", "n_chars").agg(F.count("*").alias("copies"), F.min("at").alias("first"), F.max("at").alias("last")), "runs")
    total = runs.agg(F.coalesce(F.sum("copies"), F.lit(1))).first()[0]
    behind = runs.select(F.col("key").alias("next"), F.col("first").alias("n_first"))
    taken = F.expr("n_chars div 3").cast("int")
    links = reread(spark, runs.join(behind, F.pmod(F.col("last") + 1, F.lit(total)) == F.col("n_first")).select("key", "doc_id", "n_chars", "copies", taken.alias("taken"), "next"), "links")
    # one shuffle and sort by key serves both joins: they ask for the same two columns of it
    texts = rows.select("key", "text").repartition("key").groupBy("key").agg(F.first("text").alias("text"))
    given = texts.join(links.select(F.col("next").alias("key"), F.col("key").alias("to"), "taken"), "key")
    given = with_sketch(given, "text", "next_sketch", words, scale).select(F.col("to").alias("key"), F.substring("text", F.lit(1), F.col("taken")).alias("tail"), "next_sketch")
    met = with_sketch(texts.join(links.drop("next"), "key").join(given, "key"), "text", "sketch", words, scale)
    own = F.struct(F.substring("text", F.lit(1), F.col("taken")).alias("tail"), F.col("sketch").alias("next_sketch"), (F.col("copies") - 1).cast("int").alias("times"))
    other = F.struct("tail", "next_sketch", F.lit(1).alias("times"))
    ways = F.when(F.col("copies") > 1, F.array(other, own)).otherwise(F.array(other))
    each = met.select("doc_id", "n_chars", "taken", "text", "sketch", F.explode(ways).alias("way"))
    head = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("taken")).cast("int"))
    changed = each.select("doc_id", "n_chars", F.concat(head, F.col("way.tail")).alias("edited"), "sketch", F.col("way.next_sketch").alias("next_sketch"), F.col("way.times").alias("times"))
    made = with_sketch(changed, "edited", "edited_sketch", words, scale)
    return made.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    pairs = edited_pairs(spark, docs)
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed("sketch").alias("fingerprint"), printed("edited_sketch").alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
