"""Phrase collocation mining by hierarchical pair naming.

Texts, lower-cased in A-Z, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A phrase is a
pair of names: of what stands in it before the last word and of what stands behind the first. A task turns its texts into blocks,
a sequence of numbers each, and counts each different word of a block once. The counts of all blocks meet by language and word;
what occurs often enough gets a name, the smallest (block, number) that it has anywhere, which is joined back to the blocks that
hold it. In the blocks, adjacent names are the pairs of the next round: they are counted, meet by pair, are named and joined back
alike, until phrases are as long as asked for. A pair is only formed of names, so what is rare is never counted again.

The table of a round is a dictionary of (name, left, right, count), and left and right are pointers to the round before. By them
each phrase gets the counts of everything it begins and ends with, for its cuts, and tells the two phrases inside it how often it
occurs. A phrase that lies in one that is longer by more than a word lies in one of these two as well, which is no less frequent,
so the next round alone decides what is dropped.

What is shuffled is a row a block and different word or pair, so a word that is a third of all words is a row a block; blocks hold
``BLOCK`` bytes of text, more only where a single piece is longer. Sequences travel as integers.

Rows: a null text has no words, a null language is ``und``; rows that repeat are counted each; ids play no part, nor do other
columns, however they are called; an empty table has no phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.llm.common import narrow, small_batches, work_path
from loomline.operators.predicates import numbered

LEAST, WORDS, TOP = 10, 3, 2000
#: A phrase is dropped where one that holds it occurs at least so many times in a hundred of its own.
HELD = 50
#: Bytes of text a block, and bytes of a text that are split at once.
BLOCK, SLICE = 16 << 20, 1 << 20
#: Bits of a name that tell the numbers of a block apart, and those that tell the blocks of a task apart.
NUMBERS, BLOCKS = 31, 12

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PARTS = re.compile(rb"[.,;:!?\n-\r]+|[^ \t.,;:!?\n-\r]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GRAMS = "block long, name long, lang string, word binary, left long, right long, n long, seq binary"
_TYPES = pa.schema([("block", pa.int64()), ("name", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64()), ("seq", pa.binary())])


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut where no word is; what stands between two words may be cut, too."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            while end < len(text) and text[end] not in b" \t" + _ENDS:
                end += 1
        yield text[start:end]
        start = end


def _rows(**columns) -> pa.RecordBatch:
    size = max(len(c) for c in columns.values())
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _TYPES], schema=_TYPES)


def _kept(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder, packed more tightly than work tables are."""
    path = work_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def blocks_of(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row a block with its sequence, -1 where a piece ends, and a row for each of its different words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId() << BLOCKS, 0
        known: dict[tuple[str, bytes], int] = {}
        parts: list[np.ndarray] = []
        held = 0

        def finished() -> Iterator[pa.RecordBatch]:
            block = task + made
            seq = np.concatenate(parts)
            counts = np.bincount(seq[seq >= 0], minlength=len(known))
            words = list(known)
            for k in range(0, len(words), 100_000):
                some = words[k : k + 100_000]
                numbers = (block << NUMBERS) + np.arange(k, k + len(some), dtype=np.int64)
                yield _rows(block=np.full(len(some), block, np.int64), name=numbers, lang=[x for x, _ in some], word=[w for _, w in some], n=counts[k : k + len(some)])
            yield _rows(block=[block], seq=[seq.tobytes()])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                number = known.setdefault
                for part in slices(text.translate(_LOWER)):
                    parts.append(np.fromiter((-1 if w[0] in _ENDS else number((lang, w), len(known)) for w in _PARTS.findall(part)), np.int32))
                parts.append(np.array([-1], np.int32))
                held += len(text)
                if held >= size:
                    yield from finished()
                    made, known, parts, held = made + 1, {}, [], 0
        if known:
            yield from finished()

    return docs.mapInArrow(run, _GRAMS)


def named(grams: DataFrame, by: list[str], least: int) -> DataFrame:
    """The grams that occur ``least`` times or more in all blocks, with ``f``, how often, and the name ``id`` they share."""
    same = W.partitionBy(*by)
    return grams.withColumns({"f": F.sum("n").over(same), "id": F.min("name").over(same)}).filter(F.col("f") >= least).select("block", "name", "id", *by, "f")


def paired(grams: DataFrame, names: DataFrame, last: bool) -> DataFrame:
    """The grams of the next round: each block's sequence with names in place of numbers, and its pairs of adjacent names."""

    def run(key, seqs: pa.Table, known: pa.Table) -> pa.Table:
        if not seqs.num_rows or not known.num_rows:
            return _TYPES.empty_table()
        block = key[0].as_py()
        seq = np.frombuffer(seqs.column("seq")[0].as_py(), np.int32)
        numbers = known.column("name").to_numpy() & ((1 << NUMBERS) - 1)
        of = np.full(int(max(seq.max(initial=-1), numbers.max())) + 1, -1, np.int32)
        of[numbers] = np.arange(len(numbers), dtype=np.int32)
        ids = known.column("id").to_numpy()
        now = np.where(seq >= 0, of[seq], -1)  # places in ids
        both = (now[:-1] >= 0) & (now[1:] >= 0)
        pairs, where, counts = np.unique(now[:-1][both].astype(np.int64) * len(ids) + now[1:][both], return_inverse=True, return_counts=True)
        out = [_rows(block=np.full(len(pairs), block, np.int64), name=(block << NUMBERS) + np.arange(len(pairs), dtype=np.int64), left=ids[pairs // len(ids)], right=ids[pairs % len(ids)], n=counts)]
        if not last and len(pairs):
            follow = np.full(len(seq), -1, np.int32)
            follow[:-1][both] = where
            out.append(_rows(block=[block], seq=[follow.tobytes()]))
        return pa.Table.from_batches(out)

    seqs = grams.filter("seq is not null").select("block", "seq")
    return seqs.groupBy("block").cogroup(names.select("block", "name", "id").groupBy("block")).applyInArrow(run, _GRAMS)


def mine(spark: SparkSession, docs: DataFrame, words: int = WORDS, least: int = LEAST) -> list[DataFrame]:
    """For each length from 1 to ``words`` the phrases that occur often enough: id, lang, phrase, last (its last word), f, the
    pointers ``left`` and ``right``, and ``heads`` and ``tails``, how often what it begins and ends with occurs, shortest first. The
    phrases of one word have n, the number of words of their language, as well."""
    rows = narrow(docs, lang="string", text="string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    grams = _kept(spark, blocks_of(rows), "blocks")
    totals = grams.filter("word is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    names = _kept(spark, named(grams.filter("word is not null"), ["lang", "word"], least), "names")
    own = F.array("f")
    made = names.filter("name = id").join(totals, "lang").select("id", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "f", own.alias("heads"), own.alias("tails"), "n")
    found = [_kept(spark, made, "phrases")]
    for length in range(2, words + 1):
        grams = paired(grams, names, length == words)
        grams = _kept(spark, grams, "blocks") if length < words else grams
        names = named(grams.filter("left is not null"), ["left", "right"], least)
        names = _kept(spark, names if length < words else names.filter("name = id"), "names")
        one, other = (found[-1].select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side, columns in (("left", ["lang", "phrase", "heads", "n"]), ("right", ["last", "tails"])))
        joined = names.filter("name = id").join(one, "left").join(other, "right")
        longer = joined.select("id", F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"), "f", F.concat("left_heads", own).alias("heads"), F.concat("right_tails", own).alias("tails"), F.col("left_n").alias("n"), "left", "right")
        found.append(_kept(spark, longer, "phrases"))
    return found


def _cut(length: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of a phrase; exact, in up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    a = wide(F.col("f"))
    cuts = []
    for k in range(1, length):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        score = F.call_function("div", (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(spark: SparkSession, docs: DataFrame, words: int = WORDS, least: int = LEAST, held: int = HELD, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two words or more: by score, then count, then
    the phrase's bytes. ``top``: how many of a language; None for all."""
    found = mine(spark, docs, words, least)
    scored = None
    for length in range(2, words + 1):
        phrases = found[length - 1]
        if length < words:
            longer = found[length]
            inside = longer.select(F.col("left").alias("id"), F.col("f").alias("most")).unionByName(longer.select(F.col("right").alias("id"), F.col("f").alias("most"))).groupBy("id").agg(F.max("most").alias("most"))
            phrases = phrases.join(inside, "id", "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * held))
        part = phrases.withColumn("cut", _cut(length)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        scored = part if scored is None else scored.unionByName(part)
    placed = numbered(scored, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], "at")
    first = placed.groupBy(F.col("lang").alias("of")).agg(F.min("at").alias("first"))
    ranked = placed.join(first, F.col("lang") == F.col("of")).withColumn("rank", F.col("at") - F.col("first") + 1)
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
s as (select lang, row_number() over () as id, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as words from p),
w as (select lang, id, generate_subscripts(words, 1) as pos, unnest(words) as w1 from s),
g as (select lang, w1, lead(w1) over o as w2, lead(w1, 2) over o as w3 from w window o as (partition by id order by pos)),
f1 as (select lang, w1, count(*) as f from g group by all),
f2 as (select lang, w1, w2, count(*) as f from g where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) as f from g where w3 is not null group by all having count(*) >= 10),
n as (select lang, count(*) as n from w group by lang),
held as (select lang, a, b, max(f) as most from (select lang, w1 as a, w2 as b, f from f3 union all select lang, w2, w3, f from f3) group by all),
cuts as (
  select x.lang, x.w1 || ' ' || x.w2 as phrase, x.f as a, 1 as k, l.f as l, r.f as r
  from f2 x join f1 l on x.lang = l.lang and x.w1 = l.w1 join f1 r on x.lang = r.lang and x.w2 = r.w1
  left join held h on x.lang = h.lang and x.w1 = h.a and x.w2 = h.b where x.f >= 10 and (h.most is null or 100 * h.most < 50 * x.f)
  union all
  select x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, l.f, r.f
  from f3 x join f1 l on x.lang = l.lang and x.w1 = l.w1 join f2 r on x.lang = r.lang and x.w2 = r.w1 and x.w3 = r.w2
  union all
  select x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, l.f, r.f
  from f3 x join f2 l on x.lang = l.lang and x.w1 = l.w1 and x.w2 = l.w2 join f1 r on x.lang = r.lang and x.w3 = r.w1),
scored as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from best)
select r.lang, rank, phrase, a, l, r, n, score from ranked r join n on r.lang = n.lang where rank <= 2000
"""
