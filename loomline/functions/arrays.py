"""Array, map, JSON, null and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "ABCD"
#: How raw difficulty names are renamed.
LEVELS = {"Hard": "Hard", "Easy": "Easy", "Moderate": "Medium", "Challenging": "Challenging", "Medium": "Medium", "Very Hard": "Challenging"}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def identity_map(size: Column) -> Column:
    """0, 1, ..., size - 1; empty for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def permute(values: Column | str, order: Column | str) -> Column:
    """``values`` in the order of the zero-based positions ``order``."""
    return F.transform(_c(order), lambda i: F.try_element_at(_c(values), i + 1))


def position_in(order: Column | str, index: Column | str) -> Column:
    """Zero-based position of ``index`` in ``order``; null where it is absent."""
    at = F.array_position(_c(order), _c(index)).cast("int")
    return F.when(at > 0, at - 1)


def hashed_order(key: Column, size: Column, seed: int) -> Column:
    """A permutation of 0..size-1 that depends on ``key`` and ``seed`` alone: positions by the MD5 of both."""
    ranked = F.transform(identity_map(size), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))), i.alias("at")))
    return F.transform(F.array_sort(ranked), lambda x: x["at"])


def unshuffle(answer: Column | str, order: Column | str, letters: str = LETTERS) -> Column:
    """The letter that an answer to shuffled options has in the original order; null for other letters."""
    known = F.array(*map(F.lit, letters))
    at = F.array_position(known, _c(answer)).cast("int")
    return F.try_element_at(known, F.try_element_at(_c(order), F.nullif(at, F.lit(0))) + 1)


def same_multiset(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(_c(a)) == F.array_sort(_c(b))


def zip_short(a: Column | str, b: Column | str) -> Column:
    """Pairs up to the end of the shorter array."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    return F.arrays_zip(F.slice(_c(a), F.lit(1), n).alias("left"), F.slice(_c(b), F.lit(1), n).alias("right"))


def remap(value: Column | str, names: dict[str, str] | None = None) -> Column:
    """Renamed value; null for names that the map lacks."""
    pairs = [F.lit(x) for pair in (names or LEVELS).items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), _c(value))


def null_if_not_finite(value: Column | str) -> Column:
    v = _c(value)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def answer_of_envelope(line: Column | str) -> Column:
    """``answer`` of the message content of a response line: content may be JSON text, an object, or tagged text."""
    from loomline.functions.text import strip_fences, tagged_answer

    content = F.get_json_object(_c(line), "$.response.body.choices[0].message.content")
    return F.coalesce(F.get_json_object(strip_fences(content), "$.answer"), tagged_answer(content))


def flat_answer(line: Column | str) -> Column:
    """struct<qid, answer> of a flat line; null fields where it is no such JSON."""
    return F.from_json(_c(line), "qid string, answer string")


def flatten(frame: DataFrame, mark: str = "_") -> DataFrame:
    """Nested fields as columns named by their path."""

    def leaves(kind: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for field in kind.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, here)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in here)).alias(mark.join(here)))
        return out

    return frame.select(*leaves(frame.schema, []))
