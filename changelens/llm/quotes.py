"""Quotation linking and reply-ordered conversations, in DataFrame operations only.

Lines of a message that begin with one or more `>` are quoted, and the number of
marks is their level. Neighbouring lines of one level form a passage. Passages are
normalised (lower case, single spaces, no marks) and hashed, and so are the whole
own text, the paragraphs and the lines of every message; a passage belongs to the
message with the same hash: an earlier one of the same conversation if there is
one (the latest of these), else the first one anywhere that came earlier in
(conv_id, turn) order or stands in another conversation. Where a whole passage is
found nowhere, its lines are tried one by one. The message that a first-level
passage belongs to is the one replied to (of several, the latest); without quotes
that is the turn before. Replies form trees; a tree is a conversation, its root and
each message's depth come from pointer jumping, and (root, depth, conv_id, turn) is
the reply order.

A text that very many messages contain is pre-aggregated to its first place before
it is joined; turns before are found in blocks of turns, so a conversation with a
third of all rows is not one task's work.

Cases: null and empty texts have no passages; null conv_id or turn gives a message
of its own that nothing links to. Rows that repeat a (conv_id, turn) each give a
row, and share the links of that place: what is quoted in any of them counts.
Ties go to the latest earlier turn, then to the smallest place. Very long texts
are parsed whole. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Turns that one task orders at once.
TURN_BLOCK = 256
_MARK = r"^[ \t]*((?:>[ \t]?)+)"
#: A line that only introduces a quotation.
_INTRO = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), r"[^>]", ""))


def _body(line: Column) -> Column:
    return F.regexp_replace(line, _MARK, "")


def parsed(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with lines, an array of (line level, body)."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), r"\r?\n"),
        lambda x: F.struct(_level(x).alias("level"), _body(x).alias("body")),
    )
    return messages.withColumn("lines", lines)


def own_text(lines: Column) -> Column:
    """The message without quoted lines, and without a line that introduces them."""
    n = F.size(lines)
    kept = F.filter(
        F.transform(
            lines,
            lambda x, i: F.when(
                (x["level"] == 0)
                & ~(
                    x["body"].rlike(_INTRO)
                    & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
                    & (i < n - 1)
                ),
                x["body"],
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, first, level, body) of each quoted passage: neighbouring
    lines of one level; first is the number of its first line."""
    quoted = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    line = parsed(quoted).select(
        "conv_id", "turn", F.xxhash64("text").alias("_m"), F.posexplode("lines").alias("no", "line")
    ).distinct()
    line = line.select("conv_id", "turn", "_m", "no", "line.level", "line.body")
    at = Window.partitionBy("conv_id", "turn", "_m").orderBy("no")  # lines of one message
    line = line.withColumn("new", (F.lag("level").over(at).isNull() | (F.lag("level").over(at) != F.col("level"))).cast("int"))
    line = line.withColumn("island", F.sum("new").over(at))
    line = line.where("level > 0")
    island = line.groupBy("conv_id", "turn", "_m", "island", "level").agg(
        F.min("no").alias("first"), F.sort_array(F.collect_list(F.struct("no", "body"))).alias("l")
    )
    body = F.array_join(F.transform("l", lambda x: x["body"]), "\n")
    return island.select("conv_id", "turn", "first", "level", body.alias("body"))


def _places(messages: DataFrame) -> DataFrame:
    """(h, conv_id, turn) for the hashes of all own texts, their paragraphs and lines."""
    own = parsed(messages).select("conv_id", "turn", own_text(F.col("lines")).alias("own"))
    units = F.array_union(F.array("own"), F.array_union(F.split("own", r"\n\s*\n"), F.split("own", r"\n")))
    each = own.select("conv_id", "turn", F.explode(units).alias("unit"))
    return each.select("conv_id", "turn", F.md5(normalised(F.col("unit"))).alias("h"), (F.trim("unit") != "").alias("ok")).where("ok")


def quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, first, level, to_conv, to_turn): quoted passages, or lines of
    passages that are found nowhere as wholes, and where they come from."""
    spark = messages.sparkSession
    found = passages(messages)
    whole = found.select("conv_id", "turn", "first", "level", F.md5(normalised(F.col("body"))).alias("h"), F.lit(0).alias("part"))
    lines = found.select(
        "conv_id", "turn", "first", "level", F.posexplode(F.split("body", r"\n")).alias("part", "line")
    ).where(F.trim("line") != "")
    lines = lines.select(
        "conv_id", "turn", "first", "level", F.md5(normalised(F.col("line"))).alias("h"), (F.col("part") + 1).alias("part")
    )
    asked = written(spark, whole.union(lines), "quotes-asked")
    wanted = asked.select("h").distinct()
    place = _places(messages).join(wanted.hint("merge"), "h", "left_semi")
    place = written(spark, place.groupBy("h", "conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).drop("n"), "quotes-places")
    # the last place before in each conversation, and the first place anywhere
    near = asked.join(latest_before(asked, place).hint("merge"), ["h", "conv_id", "turn"])
    near = near.select("conv_id", "turn", "first", "level", "part", "near_turn")
    first = place.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("p"))
    keys = ["conv_id", "turn", "first", "level", "part"]
    both = asked.join(near.hint("merge"), keys, "left").join(first.hint("merge"), "h", "left")
    far = F.when(
        (F.col("p.conv_id") != F.col("conv_id")) | (F.col("p.turn") < F.col("turn")), F.col("p")
    )
    to = F.coalesce(
        F.when(F.col("near_turn").isNotNull(), F.struct(F.col("conv_id"), F.col("near_turn").alias("turn"))), far
    )
    hit = both.select(*keys, to.alias("to")).where("to is not null")
    # a passage found as a whole needs no lines
    done = hit.where("part = 0").select("conv_id", "turn", "first").distinct()
    parts = hit.where("part > 0").join(done.hint("merge"), ["conv_id", "turn", "first"], "left_anti")
    out = hit.where("part = 0").union(parts.select(*hit.columns))
    return out.select("conv_id", "turn", "first", "level", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"))


def latest_before(asked: DataFrame, place: DataFrame) -> DataFrame:
    """(h, conv_id, turn, near_turn): for each (h, conv_id, turn) of asked the largest turn of
    place(h, conv_id, turn) below it, by blocks of turns: rows are those of both tables."""
    keys = ["h", "conv_id", "turn"]
    both = asked.where("conv_id is not null and turn is not null").select(*keys, F.lit(0).alias("is_place")).distinct()
    both = both.union(place.where("conv_id is not null and turn is not null").select(*keys, F.lit(1)))
    both = both.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    at = F.when(F.col("is_place") == 1, F.col("turn"))
    # of equal turns the asking row comes first, and so does not see the place
    over = Window.partitionBy("h", "conv_id", "block").orderBy("turn", "is_place").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("lag", F.max(at).over(over)).where("is_place = 0")
    ends = both.groupBy("h", "conv_id", "block").agg(F.max(at).alias("end"))
    blocks = Window.partitionBy("h", "conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("h", "conv_id", "block", F.max("end").over(blocks).alias("prior"))
    out = inside.join(ends.hint("merge"), ["h", "conv_id", "block"])
    return out.select(*keys, F.coalesce("lag", "prior").alias("near_turn")).where("near_turn is not null")


def turns_before(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, before): the turn before each, by blocks of turns."""
    own = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    own = own.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    inside = own.withColumn("lag", F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn")))
    ends = own.groupBy("conv_id", "block").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "block", F.lag("end").over(Window.partitionBy("conv_id").orderBy("block")).alias("prior"))
    both = inside.join(ends.hint("merge"), ["conv_id", "block"])
    return both.select("conv_id", "turn", F.coalesce("lag", "prior").alias("before"))


def roots(parent: DataFrame) -> DataFrame:
    """parent(c, t, pc, pt), pc null at roots: (c, t, rc, rt, depth), by pointer
    jumping: each round doubles how far up every message sees. Messages in a circle
    of quotations get the smallest one of it as root."""
    spark = parent.sparkSession
    own = F.struct(F.col("c"), F.col("t"))
    up = F.when(F.col("pc").isNotNull(), F.struct(F.col("pc").alias("c"), F.col("pt").alias("t")))
    state = parent.select(
        own.alias("m"),
        F.coalesce(up, own).alias("up"),
        F.when(up.isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
        F.least(own, F.coalesce(up, own)).alias("low"),
    )
    state = written(spark, state, "quotes-roots")
    rows, rounds = state.count(), 0
    done = [state.where("depth = 0")]
    going = state.where("depth > 0")
    while True:
        over = going
        for d in done:
            over = over.union(d)
        over = over.select(
            F.col("m").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("low").alias("low2")
        )
        step = going.join(over.hint("merge"), "up").select(
            "m",
            F.col("up2").alias("up"),
            (F.col("depth") + F.col("more")).alias("depth"),
            F.least("low", "low2").alias("low"),
            (F.col("more") > 0).alias("on"),
        )
        step = written(spark, step, "quotes-roots")
        done.append(step.where("not on").drop("on"))  # these see their root; they stay as they are
        going = step.where("on").drop("on")
        rounds += 1
        if 2**rounds > rows or going.isEmpty():
            break
    state = going
    for d in done:
        state = state.union(d)
    # only a circle still goes on after that many steps
    circle = F.col("depth") >= rows
    return state.select(
        "m.c",
        "m.t",
        F.when(circle & (F.lit(rows) > 0), F.col("low")).otherwise(F.col("up")).alias("r"),
        F.when(circle & (F.lit(rows) > 0), F.lit(0)).otherwise(F.col("depth")).alias("depth"),
    ).select("c", "t", F.col("r.c").alias("rc"), F.col("r.t").alias("rt"), "depth")


def link_conversations(messages: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, role, own_text (no quotes), n_quotes
    (passages), n_linked (passages or lines with a known source), reply_conv and
    reply_turn, by_quote, root_conv, root_turn, depth."""
    spark = messages.sparkSession
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    linked = written(spark, quotations(base), "quotes-links")
    direct = linked.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_linked"),
        F.max(
            F.when(
                (F.col("level") == 1) & ((F.col("to_conv") != F.col("conv_id")) | (F.col("to_turn") != F.col("turn"))),
                F.struct((F.col("to_conv") == F.col("conv_id")).alias("same"), "to_turn", "to_conv"),
            )
        ).alias("q"),
    )
    quotes = passages(base).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"))
    keys = ["conv_id", "turn"]
    tree = turns_before(base).join(direct.hint("merge"), keys, "left").join(quotes.hint("merge"), keys, "left")
    tree = tree.select(
        *keys,
        F.coalesce("q.to_conv", F.when(F.col("before").isNotNull(), F.col("conv_id"))).alias("reply_conv"),
        F.coalesce("q.to_turn", "before").alias("reply_turn"),
        F.col("q").isNotNull().alias("by_quote"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    tree = written(spark, tree, "quotes-tree")
    top = roots(tree.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("reply_conv").alias("pc"), F.col("reply_turn").alias("pt")))
    top = top.select(
        F.col("c").alias("conv_id"), F.col("t").alias("turn"), F.col("rc").alias("root_conv"), F.col("rt").alias("root_turn"), "depth"
    )
    place = tree.join(top.hint("merge"), keys)
    own = parsed(base).select("conv_id", "turn", "role", own_text(F.col("lines")).alias("own_text"))
    out = own.join(place.hint("merge"), keys, "left")
    return out.select(
        *keys,
        "role",
        "own_text",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_conv",
        "reply_turn",
        F.coalesce("by_quote", F.lit(False)).alias("by_quote"),
        F.coalesce("root_conv", "conv_id").alias("root_conv"),
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
