"""Filters, orders and pages from structured specifications.

A condition is ``{"field", "operator", "value"}`` with an optional ``alias``; a tree is ``{"logical": "and" | "or",
"conditions": [...]}`` with an optional ``alias`` that its conditions inherit.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.session import reread

#: The comparisons that a condition may name.
OPERATORS = ("IS", "IS NOT", "IN", "NOT IN", "LIKE", "NOT LIKE", "=", "!=", ">", "<", ">=", "<=")


class Sql(str):
    """A value that is SQL text, not a literal; a sub-query stands in parentheses."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def coerced(operator: str, value):
    """The operator and value that a list, a scalar or None calls for."""
    operator = operator.upper()
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    if isinstance(value, (list, tuple, set)):
        if not value:
            raise ValueError("an empty list matches nothing and is not allowed")
        operator = {"=": "IN", "!=": "NOT IN"}.get(operator, operator)
        if operator not in ("IN", "NOT IN"):
            raise ValueError(f"{operator} takes no list")
    elif not isinstance(value, Sql):
        operator = {"IN": "=", "NOT IN": "!="}.get(operator, operator)
    if value is None:
        operator = {"=": "IS", "!=": "IS NOT"}.get(operator, operator)
    return operator, value


def _leaf(condition: dict, alias: str | None) -> Column:
    alias = condition.get("alias", alias)
    name = (quoted(alias) + "." if alias else "") + quoted(condition["field"])
    operator, value = coerced(condition["operator"], condition.get("value"))
    if isinstance(value, Sql):
        return F.expr(f"{name} {operator} {value}")
    column = F.col(name)
    if operator in ("IS", "IS NOT"):
        same = column.isNull() if value is None else column.eqNullSafe(F.lit(value))
        return same if operator == "IS" else ~same
    if operator in ("IN", "NOT IN"):
        return column.isin(list(value)) if operator == "IN" else ~column.isin(list(value))
    if operator in ("LIKE", "NOT LIKE"):
        return column.like(value) if operator == "LIKE" else ~column.like(value)
    compare = {"=": column.__eq__, "!=": column.__ne__, ">": column.__gt__, "<": column.__lt__, ">=": column.__ge__, "<=": column.__le__}
    return compare[operator](F.lit(value))


def where(tree: dict, alias: str | None = None) -> Column:
    """The condition as one Column, which the optimizer splits and pushes down."""
    if "logical" not in tree:
        return _leaf(tree, alias)
    if not tree["conditions"]:
        raise ValueError("a condition tree needs a condition")
    joined = {"and": and_, "or": or_}[tree["logical"].lower()]
    return reduce(joined, [where(x, tree.get("alias", alias)) for x in tree["conditions"]])


def order_by(keys: list) -> list[Column]:
    """Sort keys: names, ``Sql`` or ``{"field", "direction"?, "alias"?}``; nulls are last ascending, first descending."""
    out = []
    for key in keys:
        key = key if isinstance(key, dict) else {"field": key}
        name = key["field"]
        if not isinstance(name, Sql):
            name = (quoted(key["alias"]) + "." if key.get("alias") else "") + quoted(name)
        column = F.expr(name)
        out.append(column.desc_nulls_first() if key.get("direction", "ASC").upper() == "DESC" else column.asc_nulls_last())
    return out


def limit_offset(frame: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    frame = frame.offset(offset) if offset else frame
    return frame if limit is None else frame.limit(limit)


def since(field: str, value, mode: str = ">") -> Column:
    """Rows past a high-water mark, or at it where the mode is ``>=``; without a mark all rows."""
    if value is None:
        return F.lit(True)
    return F.col(quoted(field)) >= F.lit(value) if mode == ">=" else F.col(quoted(field)) > F.lit(value)


def numbered(frame: DataFrame, keys: list[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of ``keys``, without bringing all rows to one task: rows are range-partitioned once
    and written with their place in their partition, behind which the counts of the partitions before are added.

    Rows of equal keys are told apart by a hash of their content and their place in the input, so that no key, however
    frequent, has to fit in one partition; among equal rows any order will do."""
    tie = [F.xxhash64(*[quoted(c) for c in frame.columns]).alias("__tie"), F.monotonically_increasing_id().alias("__from")]
    placed = frame.select("*", *tie).orderBy(*keys, "__tie", "__from").drop("__tie", "__from").withColumn("__place", F.monotonically_increasing_id())
    ordered = reread(frame.sparkSession, placed, "ordered").withColumn("__part", F.shiftright("__place", 33))
    # a row a partition
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__of"), (F.sum("__n").over(W.orderBy("__part")) - F.col("__n") + start).alias("__before"))
    joined = ordered.join(F.broadcast(counts), F.col("__part") == F.col("__of"))
    return joined.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__place", "__part", "__of", "__before")


def pages(frame: DataFrame, keys: list[Column], size: int) -> DataFrame:
    """``page`` of each row: pages of ``size`` rows in the order of ``keys``."""
    return numbered(frame, keys, "__at").withColumn("page", F.floor(F.col("__at") / size)).drop("__at")


def page_of(frame: DataFrame, keys: list[Column], page: int, size: int) -> tuple[DataFrame, int]:
    """Rows of a page, counted from 1, and the total of rows."""
    return limit_offset(frame.orderBy(*keys), size, (page - 1) * size), frame.count()


def head_sample(frame: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows; all of them where ``n`` is -1."""
    return frame if n == -1 else frame.orderBy(*keys).limit(n)


# -- validators: true where a value is acceptable


def is_uuid4(value: Column) -> Column:
    """With hyphens or without."""
    return value.rlike(r"(?i)^[0-9a-f]{8}(-?)[0-9a-f]{4}\1[4][0-9a-f]{3}\1[89ab][0-9a-f]{3}\1[0-9a-f]{12}$")


def is_digits(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def is_one_of(value: Column, allowed: list) -> Column:
    return value.isin(allowed)


def all_of(values: Column, allowed: list) -> Column:
    return F.size(F.array_except(values, F.array(*map(F.lit, allowed)))) == 0


def is_time(value: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    return F.try_to_timestamp(value, F.lit(pattern)).isNotNull()


def is_email(value: Column, longest: int = 64) -> Column:
    return (F.char_length(value) <= longest) & value.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")


def is_password(value: Column, shortest: int = 8) -> Column:
    return (F.char_length(value) >= shortest) & value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def is_name(value: Column, longest: int = 64) -> Column:
    return (F.char_length(F.trim(value)) > 0) & (F.char_length(value) <= longest)
