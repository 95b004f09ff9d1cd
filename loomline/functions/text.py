"""Text functions as Column expressions; only the fuzzy ratio needs a Python worker."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import lcs

#: The white space of Python's ``\s``, which Java's ``\s`` does not cover.
WHITE = " \\t\\n\\r\\f\\x0b\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The vowels that may stand in the word that introduces a question's number.
MARKER_A, MARKER_U = "aáàảãạâấầẩẫậăắằẳẵặ", "ùúủũụưứừửữự"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) for ``translate``: characters of the basic plane whose decomposition, without the marks U+0300 to
    U+036F, is one other character; then the marks themselves, which have no counterpart and so are deleted."""
    pairs = [("đ", "d"), ("Đ", "D")]
    for code in range(0xC0, 0xFFFF):
        if 0xD800 <= code < 0xE000 or 0x300 <= code < 0x370:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(x) < 0x370)
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


def remove_accents(text: Column | str) -> Column:
    """Letters without combining marks; đ and Đ become d and D."""
    t = _c(text)
    return F.when(t.rlike(r"[^\x00-\x7f]"), F.translate(t, *accent_table())).otherwise(t)


def normal_form(text: Column | str) -> Column:
    """Accent-free lower case of ASCII letters, digits and single spaces, trimmed; null stays null."""
    # a class of many ranges is slow to match: what ASCII can have is translated, and only what is left is matched
    white = "".join(map(chr, range(0x3001))).translate({c: None for c in range(0x3001) if not re.match(f"[{WHITE}]", chr(c))})
    other = "".join(chr(c) for c in range(0x80) if not (chr(c).isalnum() or chr(c) in white))
    kept = F.translate(F.lower(remove_accents(text)), white + other, " " * len(white))
    kept = F.when(kept.rlike(r"[^\x00-\x7f]"), F.regexp_replace(kept, r"[^\x00-\x7f]", "")).otherwise(kept)
    return F.trim(F.when(F.contains(kept, F.lit("  ")), F.regexp_replace(kept, "  +", " ")).otherwise(kept))


def strip_numbers_of_questions(text: Column | str) -> Column:
    """Every ``cau <number>`` of a normal form goes, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), "cau [0-9]+", ""))


def better_question(text: Column | str, strict_marker: bool = False) -> Column:
    """Trimmed, without one leading question marker. By default the marker runs up to the first number, whatever stands
    between; ``strict_marker`` allows only white space there, and any case."""
    bare = F.regexp_replace(_c(text), rf"^[{WHITE}]+|[{WHITE}]+$", "")
    if strict_marker:
        return F.regexp_replace(bare, rf"(?Uiu)^c[{MARKER_A}]u[{MARKER_U}]?\s*\d+\W*", "")
    return F.regexp_replace(bare, rf"(?U)^[Cc][{MARKER_A}][Uu][{MARKER_U}]?\s*\D+\s*\d+\W*", "")


def better_options(options: Column | str) -> Column:
    """Options without leading letters A-G, where every option has one and no letter occurs twice."""
    opts = _c(options)
    letter = r"(?Us)^\s*([A-Ga-g])\W+"
    letters = F.transform(opts, lambda o: F.upper(F.regexp_extract(o, letter, 1)))
    all_marked = F.forall(opts, lambda o: o.rlike(letter + ".+$"))
    return F.when(all_marked & (F.size(letters) == F.size(F.array_distinct(letters))), F.transform(opts, lambda o: F.regexp_replace(o, letter, ""))).otherwise(opts)


def last_char(text: Column | str) -> Column:
    """Last character; null of an empty text."""
    return F.nullif(F.right(_c(text), F.lit(1)), F.lit(""))


def letter_index(letter: Column | str) -> Column:
    """A is 0."""
    return F.ascii(_c(letter)) - 65


def index_letter(index: Column | str) -> Column:
    return F.char((_c(index) + 65).cast("int"))


def split_trimmed(text: Column | str, mark: str = ",") -> Column:
    return F.transform(F.split(_c(text), mark), F.trim)


def strip_fences(text: Column | str) -> Column:
    """Without Markdown code fences, trimmed."""
    return F.trim(F.replace(F.replace(_c(text), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def after_thinking(text: Column | str) -> Column:
    """Words behind the first ``</think>``."""
    return F.split(F.trim(F.split_part(_c(text), F.lit("</think>"), F.lit(2))), r"\s+")


def tagged_answer(text: Column | str) -> Column:
    """The letter of ``<answer>X</answer>``, else null."""
    t = F.trim(_c(text))
    return F.when(t.startswith("<answer>") & t.endswith("</answer>"), F.substring(t, 9, 1))


def clean_html(html: Column | str) -> Column:
    """Text of HTML: no scripts, styles, comments or tags, common entities decoded, white space collapsed."""
    t = F.regexp_replace(_c(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    #: Entities and what they stand for; the ampersand comes last.
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def row_hash(columns: dict[str, str], wanted: list[str] | None = None) -> Column:
    """MD5 of the values of name-sorted columns joined by ``_``; null, missing and infinite values count as empty.

    ``columns``: name and type of each column of the frame.
    """
    parts = []
    for name in sorted(wanted or columns):
        if name not in columns:
            parts.append(F.lit(""))
            continue
        value = F.col(f"`{name}`")
        if columns[name] in ("double", "float"):
            value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
        parts.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.md5(F.concat_ws("_", *parts))


def options_prompt(question: Column | str, options: Column | str, style: str = "colon", guide: str = "") -> Column:
    """Question and options as a prompt: ``colon`` gives ``A: x``, ``dot`` gives ``A. x``, ``keys`` gives ``optionA: x``."""
    mark = {"colon": (F.lit(""), ": "), "dot": (F.lit(""), ". "), "keys": (F.lit("option"), ": ")}[style]
    lines = F.transform(_c(options), lambda o, i: F.concat(mark[0], index_letter(i), F.lit(mark[1]), o))
    return F.concat_ws("\n", _c(question), F.array_join(lines, "\n"), *([F.lit(guide)] if guide else []))


def word_count(text: Column | str) -> Column:
    """Pieces between single spaces, empty ones too."""
    return F.size(F.split(_c(text), " "))


@F.pandas_udf(T.IntegerType())
def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (|a| + |b|) of two columns, rounded half to even; 100 for two empty texts, 0 where one is null. No built-in
    function counts insertions and deletions only."""
    return pd.Series(lcs.ratios(a.tolist(), b.tolist()))


def fuzz_from(a: Column | str, b: Column | str, least: int) -> Column:
    """``fuzz_ratio`` where it is ``least`` or more, else 0; pairs are given up as soon as they cannot get there."""

    @F.pandas_udf(T.IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(lcs.ratios(x.tolist(), y.tolist(), least))

    return run(_c(a), _c(b))


def fuzz_bound(a: Column | str, b: Column | str) -> Column:
    """No ``fuzz_ratio`` exceeds this, so pairs below a threshold need no worker."""
    low, total = F.least(F.char_length(_c(a)), F.char_length(_c(b))), F.char_length(_c(a)) + F.char_length(_c(b))
    return F.when(total == 0, 100.0).otherwise(200.0 * low / total)
