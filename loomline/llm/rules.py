"""Quality rules: base counts of a text, and perplexity bands of its language.

Perplexity is that of the word bigrams of ``words``. A text's measure is its negative log probability per word with a letter
or digit, the logarithm of its perplexity. The bands of a language come from all its texts that pass the base rules: the median, less ``BELOW`` or
plus ``ABOVE`` times the distance to the lower or upper quartile.

Rows: a null text has no words and fails the base rules; a null language is a language of its own; rows that repeat language
and text are scored alike and are one copy class; a language without a word in texts of two classes has no model, and its
texts are kept if they pass the base rules; texts of any length are counted and scored whole; other columns play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import narrow, reread
from loomline.llm.words import mix, text_costs

MIN_WORDS = 50
BELOW, ABOVE = 12.0, 4.0
#: Languages whose bands are broadcast at most, and keys of rejected texts.
FEW, FEW_KEYS = 10_000, 500_000
SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
FACTS = "lang string, doc_id long, row binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_scored long, cost long"
RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


# -- base rules


def repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text the number of words in windows of three that occur twice or more in it."""
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(counts), np.int64)
    whole = np.flatnonzero(text[2:] == text[:-2]) if len(codes) > 2 else np.empty(0, int)
    if not len(whole):
        return out
    windows = mix(mix(mix(codes[whole]) + codes[whole + 1]) + codes[whole + 2] + text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[whole[order[again]] + k] = True
    return out + np.bincount(text[inside], minlength=len(counts))


def base_counts(texts: list[bytes], codes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text, given the codes of its words."""
    out = []
    for data, n, repeated in zip(texts, counts.tolist(), repeated_words(codes, counts).tolist(), strict=True):
        dense = data.translate(None, SPACES)
        chars = len(dense) if dense.isascii() else len(dense.decode())
        lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
        out.append((n, chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, n < MIN_WORDS or 100 * repeated > 50 * n))
    return out


# -- verdicts


def _row_key(lang: Column, text: Column) -> Column:
    """Key of a language and text, whose verdict is one."""
    return F.substring(F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("v"), lang), F.lit("n")), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)), 1, 16)


def _facts(texts: list[bytes], codes: np.ndarray, counts: np.ndarray, rows: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    found = base_counts(texts, codes, counts)
    return [(*row, *f) for row, f in zip(rows, found, strict=True)], np.array([not f[-1] for f in found], bool)


def scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``FACTS`` and log_perplexity (null where a text fails the base rules or its language has no model) of
    every row of ``docs`` (doc_id, lang, text). They lie in the shared folder, so nothing is scored twice."""
    names = [x.split(" ")[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                rows = pickle.loads(data.as_py())
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split(" ")[1]] for x in FACTS.split(", ")]
    keyed = docs.select("lang", "text", "doc_id", _row_key(F.col("lang"), F.col("text")).alias("row"))
    found = text_costs(spark, keyed, _facts).mapInArrow(run, FACTS)
    return reread(spark, found.withColumn("log_perplexity", F.round(F.try_divide("cost", "n_scored") / 1e6, 3)), "scores")


def judged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``scores`` with ``kept``."""
    scored = scores(spark, docs)
    q = F.percentile("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    low, mid, high = (F.col("q")[k] for k in range(3))
    bands = scored.filter(F.col("log_perplexity").isNotNull()).groupBy(F.col("lang").alias("of_lang")).agg(q.alias("q"))
    bands = reread(spark, bands.select("of_lang", (mid - BELOW * (mid - low)).alias("least"), (mid + ABOVE * (high - mid)).alias("most")), "bands")
    side = F.broadcast(bands) if bands.limit(FEW + 1).count() <= FEW else bands
    placed = scored.join(side, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("least"), F.col("most")), F.lit(True))
    return placed.withColumn("kept", ~F.col("base_failed") & inside).drop("of_lang", "least", "most")


def verdicts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and log_perplexity of every row."""
    return judged(spark, narrow(docs, doc_id="long", lang="string", text="string")).select(*RESULT)


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; the columns stay as they are. Only keys of what is rejected are
    joined with the texts, which stay where they are as long as the keys are few."""
    plain = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"), F.lit(None).cast("long").alias("doc_id"))
    gone = reread(spark, judged(spark, plain).filter("not kept").select(F.col("row").alias("__gone")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= FEW_KEYS else gone
    return docs.join(side, _row_key(docs["lang"].cast("string"), docs["text"].cast("string")) == F.col("__gone"), "left_anti")
