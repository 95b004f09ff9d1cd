"""Quotation linking and reply-ordered conversations, with DataFrame functions only.

Lines that begin with quote marks (``>``) are quoted, as deep as they have marks. Consecutive lines of one depth are a
passage. A passage is hashed, in lower case and with white space collapsed, as a whole, by paragraph and by line, and so
is what each message says itself. The hashes are joined inside a conversation: of each hash only the earliest message
that says it is kept, so the join is many to one however often a phrase recurs. A passage belongs to the earlier message
that says the longest of its parts; a message answers the message of its shallowest linked passage, the first and longest
of these. A thread is what hangs together by answers, and its root is its earliest message.

Result, one row a message: ``content``, the text without quoted lines and the lines that introduce them, and blank lines
around them trimmed; ``quote_depth``; ``n_quotes``, its passages; ``reply_to``, the turn it answers, null if it quotes no
earlier message; ``thread``, the turn of the root; ``position``, its place, from 0, in the conversation in reply order. That
is the order of a walk through the tree of answers: a message, then each of its answers, the earliest first, with all that
answers these. A message carries the turns from its root to itself, so places cost the sum of the depths; all messages are
sorted and numbered together, so a conversation of any length may span tasks.

Rows: a null text has null content and no quotes; a null conv_id is a conversation of its own; a null turn comes after
all others and is never answered; rows that repeat are linked alike and stand behind one another; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import narrow, reread, row_key
from loomline.operators.predicates import numbered

_MARKS = r"^[ \t]*>(?:[ \t]*>)*"
_INTRODUCTION = r"(?i)^on .{1,300} wrote:[ \t\r]*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _once(value: Column) -> Column:
    """The value as a generator of one row: what refers to it, in a function over an array above all, finds it computed
    and doesn't compute it anew for each element."""
    return F.explode(F.array(value))


def _units(passage: Column) -> Column:
    """Hashes, with their lengths, of the normalised passage, its paragraphs and its lines."""
    parts = F.concat(F.array(passage), F.split(passage, r"\n[ \t\r]*\n"), F.split(passage, "\n"))
    normal = F.array_distinct(F.filter(F.transform(parts, _normal), lambda p: p != ""))
    return F.transform(normal, lambda p: F.struct(F.unhex(F.md5(p.cast("binary"))).alias("hash"), F.length(p).alias("size")))


def parse(messages: DataFrame) -> DataFrame:
    """Messages with their content, quote_depth and passages (array of depth and text), under a key of their row."""
    rows = narrow(messages, conv_id="long", turn="long", role="string", text="string").withColumn("row", row_key("conv_id", "turn", "role", "text"))
    lines = rows.select("*", _once(F.split("text", "\n", -1)).alias("lines"))
    depth = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), r"[^>]", ""))
    deep = lines.select("*", _once(F.transform("lines", depth)).alias("depths"))
    at = F.sequence(F.lit(1), F.size("lines"))
    of = lambda name, k: F.try_element_at(name, k)
    quoted = lambda k: F.coalesce(of("depths", k) > 0, F.lit(False))
    before = lambda k: F.when(k > 1, of("depths", F.greatest(k - 1, F.lit(1)))).otherwise(0)
    after = lambda k: F.coalesce(of("depths", k + 1), F.lit(0))
    introduces = lambda k: quoted(k + 1) & of("lines", k).rlike(_INTRODUCTION)
    cut = deep.select(
        "*",
        F.filter(at, lambda k: quoted(k) & (before(k) != of("depths", k))).alias("starts"),
        F.filter(at, lambda k: quoted(k) & (after(k) != of("depths", k))).alias("ends"),
        F.transform(F.filter(at, lambda k: ~quoted(k) & ~introduces(k)), lambda k: of("lines", k)).alias("own"),
    )
    strip = lambda x: F.regexp_replace(x, rf"{_MARKS}[ \t]?", "")
    passage = lambda s, e: F.struct(of("depths", s).alias("depth"), F.array_join(F.transform(F.slice("lines", s, e - s + 1), strip), "\n").alias("said"))
    trimmed = F.regexp_replace(F.array_join("own", "\n"), r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")
    return cut.select(
        "row", "conv_id", "turn", "role",
        F.when(F.size("starts") > 0, trimmed).otherwise(F.col("text")).alias("content"),
        F.coalesce(F.array_max("depths"), F.lit(0)).alias("quote_depth"),
        F.when(F.col("text").isNotNull(), F.zip_with("starts", "ends", passage)).alias("passages"),
    )


def link(parsed: DataFrame) -> DataFrame:
    """(row, reply_to) of the messages that quote an earlier one."""
    late = F.coalesce("turn", F.lit(2**63 - 1))
    quotes = parsed.select("row", "conv_id", late.alias("turn"), F.posexplode("passages").alias("nth", "passage"))
    sought = quotes.select("row", "conv_id", "turn", "nth", "passage.depth", F.explode(_units(F.col("passage.said"))).alias("unit")).select("row", "conv_id", "turn", "nth", "depth", "unit.*")
    # only what some passage of the same conversation asks for is worth indexing
    asked = sought.select(F.col("conv_id").alias("q_conv"), F.col("hash").alias("q_hash")).distinct()
    said = parsed.filter("turn is not null").select("conv_id", "turn", F.explode(_units(F.col("content"))).alias("unit")).select("conv_id", "turn", "unit.hash")
    wanted = said.join(asked, F.col("conv_id").eqNullSafe(F.col("q_conv")) & (F.col("hash") == F.col("q_hash")), "left_semi")
    first = wanted.groupBy(F.col("conv_id").alias("o_conv"), F.col("hash").alias("o_hash")).agg(F.min("turn").alias("origin"))
    found = sought.join(first, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("hash") == F.col("o_hash"))).filter("origin < turn")
    best = F.min(F.struct("depth", (-F.col("size")).alias("less"), "nth", "origin"))
    return found.groupBy("row").agg(best["origin"].alias("reply_to"))


#: Where a null turn stands.
LAST = 2**63 - 1


def threads(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(conv_id, turn, way) of every turn that answers another: the turns from its root to itself, by pointer jumping, which
    doubles each round what is known of the way. Rows that share a turn follow the earliest turn that any of them answers."""
    up = links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("top")).withColumn("way", F.array("turn"))
    while True:
        up = reread(spark, up, "threads")
        higher = up.select(F.col("conv_id").alias("h_conv"), F.col("turn").alias("h_turn"), F.col("top").alias("higher"), F.col("way").alias("before"))
        step = up.join(higher, F.col("conv_id").eqNullSafe(F.col("h_conv")) & (F.col("top") == F.col("h_turn")), "left")
        if not step.filter("higher is not null").limit(1).count():
            return up.select("conv_id", "turn", F.concat(F.array("top"), F.col("way")).alias("way"))
        up = step.select("conv_id", "turn", F.coalesce("higher", "top").alias("top"), F.concat(F.coalesce("before", F.array().cast("array<long>")), F.col("way")).alias("way"))


def conversations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, quote_depth, n_quotes, reply_to, thread and position of every message."""
    parsed = parse(messages)
    links = reread(spark, link(parsed), "links")
    named = parsed.join(links, "row", "left").select("conv_id", "turn", "role", "content", "quote_depth", F.coalesce(F.size("passages"), F.lit(0)).alias("n_quotes"), "reply_to")
    own = F.array(F.coalesce("turn", F.lit(LAST)))
    if links.limit(1).count():
        answers = parsed.join(links, "row").filter("turn is not null").select("conv_id", "turn", "reply_to")
        ways = threads(spark, answers).select(F.col("conv_id").alias("w_conv"), F.col("turn").alias("w_turn"), F.col("way").alias("above"))
        placed = named.join(ways, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("reply_to") == F.col("w_turn")), "left")
        above = F.coalesce("above", F.when(F.col("reply_to").isNotNull(), F.array("reply_to")).otherwise(F.array().cast("array<long>")))
        named = placed.withColumn("way", F.concat(above, own)).drop("w_conv", "w_turn", "above")
    else:
        named = named.withColumn("way", own)
    numbers = numbered(named, [F.asc_nulls_last("conv_id"), F.asc("way"), F.asc("role"), F.asc("content")], "number")
    first = numbers.groupBy(F.col("conv_id").alias("f_conv")).agg(F.min("number").alias("first"))
    found = numbers.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")))
    thread = F.when(F.col("turn").isNull() & F.col("reply_to").isNull(), None).otherwise(F.col("way")[0])
    return found.select("conv_id", "turn", "role", "content", "quote_depth", "n_quotes", "reply_to", thread.alias("thread"), (F.col("number") - F.col("first")).alias("position"))


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Messages of each conversation behind one another, in reply order."""
    return linked.orderBy(F.asc_nulls_last("conv_id"), "position")
