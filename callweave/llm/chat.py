"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (leading `>` marks, with at
most one space between). Lines of level 0 are the message's own words. Every
line's normalised text (lower case, white space collapsed) is hashed, and so
are an own text, its paragraphs and all that is quoted of a level, with lines
joined, so a passage that was wrapped anew is found where it is a paragraph or
a text as a whole. A message replies to the earlier turn that holds most of its
outermost quoted text, every turn that holds a part of it being weighed; one
that holds all of a level in one piece goes first. Deeper levels are linked in
the same way. Following the replies gives each message its thread and depth,
and conversations are numbered thread by thread, each in the order of its turns,
so an answer stands behind what it answers. Quotes, and a line `... wrote:`
before one, are left out of the text.

Only DataFrame operations. A piece that few turns of a conversation hold is
joined to each of them; turns that hold the same set of common pieces weigh the
same, so these sets are weighed and the latest turn of each is looked up. The
rows are a message's times the different sets that share a piece with it. The
numbering is by ranges, so a conversation of any length is many tasks' work.

Null text counts as empty. Messages without a conversation or turn link to
nothing and keep a position of null. Quotes that match nothing are dropped like
others. Ties go to the later turn. Repeated rows are each returned, one behind
the other. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_cut, drop_since, shuffle_width, written

#: Turns of a conversation that hold a piece, from which on it is common; turns
#: of a slice.
COMMON, SLICE = 16, 4096
MARKS = r"^((?: ?>)+) ?"
WROTE = r"\bwrote:\s*$"


def _level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), " ", ""))


def _normal(line):
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, message (key), lines (array of level, normal form),
    own (the text without quotes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))
    out = out.withColumn("message", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("raw", F.split("text", "\n"))
    lines = F.transform("raw", lambda x: F.struct(_level(x).alias("level"), _normal(x).alias("normal")))
    own = F.filter("raw", lambda x, i: (_level(x) == 0) & ~(x.rlike(WROTE) & F.coalesce(_level(F.get("raw", i + 1)) > 0, F.lit(False))))
    return out.select("conv_id", "turn", "role", "message", lines.alias("lines"), F.trim(F.array_join(own, "\n")).alias("own"))


def _flat(text):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def pieces(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """held: conv_id, turn, hash of what a turn says itself - lines, paragraphs
    and the whole. asked: conv_id, turn, message, level, hash, size of what a
    message quotes - lines, and all of a level joined."""
    known = parsed.filter("conv_id is not null and turn is not null")
    lines = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["normal"])
    paragraphs = F.transform(F.split("own", r"\n\s*\n"), _flat)
    held = known.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(lines, paragraphs, F.array(_flat(F.col("own")))))).alias("normal")).filter("normal <> ''")
    held = held.select("conv_id", "turn", F.xxhash64("normal").alias("hash")).distinct()

    levels = F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"]))
    asked = known.select("conv_id", "turn", "message", "lines", F.explode(levels).alias("level"))
    quoted = F.transform(F.filter("lines", lambda x: (x["level"] == F.col("level")) & (x["normal"] != "")), lambda x: x["normal"])
    asked = asked.withColumn("quoted", quoted).withColumn("normal", F.explode(F.array_distinct(F.concat("quoted", F.array(F.array_join("quoted", " ")))))).filter("normal <> ''")
    return held, asked.select("conv_id", "turn", "message", "level", F.xxhash64("normal").alias("hash"), F.length("normal").alias("size")).distinct()


def latest_before(asks: DataFrame, holds: DataFrame) -> DataFrame:
    """asks (conv_id, own_set, turn) with the latest turn of holds (the same
    columns) before each: within slices of turns, then over the slices."""
    both = asks.withColumn("origin", F.lit(None).cast("long")).unionByName(holds.withColumn("origin", F.col("turn"))).withColumn("slice", F.floor(F.col("turn") / SLICE))
    key = ["conv_id", "own_set", "slice"]
    # An ask comes before a hold of the same turn, as nulls come first.
    own = F.max("origin").over(W.partitionBy(*key).orderBy("turn", "origin").rowsBetween(W.unboundedPreceding, W.currentRow))
    earlier = F.max("last").over(W.partitionBy("conv_id", "own_set").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    slices = both.groupBy(*key).agg(F.max("origin").alias("last")).select(*key, earlier.alias("earlier"))
    found = both.withColumn("within", own).filter("origin is null").join(slices, key)
    return found.select("conv_id", "own_set", "turn", F.coalesce("within", "earlier").alias("origin")).filter("origin is not null")


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, message, quotes (array of level, turn): where its quotes come
    from. A message is told apart within its conversation only."""
    held, asked = pieces(parsed)
    asked = cut(asked, "asked")
    held = cut(held.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi"), "held")
    counts = held.groupBy("conv_id", "hash").agg((F.count("*") > COMMON).alias("often"))
    asked = cut(asked.join(counts, ["conv_id", "hash"]), "counted")
    common = counts.filter("often").select("conv_id", "hash")

    # Rare pieces: every earlier turn that holds them.
    rare = asked.filter("not often").join(held.join(common, ["conv_id", "hash"], "left_anti").withColumnRenamed("turn", "origin"), ["conv_id", "hash"]).filter("origin < turn")
    rare = rare.groupBy("conv_id", "message", "level", "origin").agg(F.sum("size").alias("size"))

    # Common ones: turns that hold the same set of them are weighed once.
    own = held.join(common, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set("hash")).alias("set"))
    own = cut(own.withColumn("own_set", F.xxhash64("set")), "own")
    wanted = asked.filter("often").groupBy("conv_id", "turn", "message", "level").agg(F.sort_array(F.collect_set(F.struct("hash", "size"))).alias("set"))
    wanted = cut(wanted.withColumn("want_set", F.xxhash64("set")), "wanted")
    sets = own.groupBy("conv_id", "own_set").agg(F.first("set").alias("set")).select("conv_id", "own_set", F.explode("set").alias("hash"))
    wants = wanted.groupBy("conv_id", "want_set").agg(F.first("set").alias("set")).select("conv_id", "want_set", F.inline("set"))
    shared = cut(wants.join(sets, ["conv_id", "hash"]).groupBy("conv_id", "want_set", "own_set").agg(F.sum("size").alias("more")), "shared")

    rare = rare.join(wanted.select("conv_id", "message", "level", "want_set"), ["conv_id", "message", "level"], "left").join(own.select("conv_id", F.col("turn").alias("origin"), "own_set"), ["conv_id", "origin"], "left")
    rare = rare.join(shared, ["conv_id", "want_set", "own_set"], "left").select("conv_id", "message", "level", "origin", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
    often = wanted.join(shared, ["conv_id", "want_set"]).select("conv_id", "own_set", "turn", "message", "level", F.col("more").alias("size"))
    latest = latest_before(often.select("conv_id", "own_set", "turn").distinct(), own.select("conv_id", "own_set", "turn"))
    often = often.join(latest, ["conv_id", "own_set", "turn"]).select("conv_id", "message", "level", "origin", "size")

    best = rare.unionByName(often).groupBy("conv_id", "message", "level").agg(F.max_by("origin", F.struct("size", "origin")).alias("origin"))
    return best.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("level", F.col("origin").alias("turn")))).alias("quotes"))


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of every (conv_id, turn, parent), by doubling
    the stride of the parent pointers; a turn's parent comes before it. A turn
    whose pointer has met its thread's first turn is joined no more, so the
    first turn of a long thread is a join's key once."""
    own = F.col("parent").isNull()
    now = cut(replies.select("conv_id", "turn", F.coalesce("parent", "turn").alias("root"), F.when(own, 0).otherwise(1).cast("long").alias("depth"), own.alias("top")), "threads")
    while now.filter("not top").head(1):
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"), F.col("top").alias("ends"))
        moved = now.filter("not top").join(up, ["conv_id", "root"], "left")
        # A parent that is no turn of the table is a first turn itself.
        step = moved.select("conv_id", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("ends", F.lit(True)).alias("top"))
        before, now = now, cut(now.filter("top").unionByName(step), "threads")
        drop_cut(before)
    return now.drop("top")


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Rows of each group numbered from 0 in the given order, without bringing
    a group into one task: rows are dealt by ranges; a row's number is its place
    in its range's share of the group, and the sizes of the shares before."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_width(spark), group, *order).sortWithinPartitions(group, *order)
    row = F.monotonically_increasing_id()
    dealt = cut(dealt.withColumn("__range", F.shiftright(row, 33)).withColumn("__row", row.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    shares = dealt.groupBy("__range", group).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    # A row a range and group: few for a group, as ranges are few.
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select("__range", group, "__first", before.alias("__before"))
    return dealt.join(shares, ["__range", group]).withColumn(name, F.col("__before") + F.col("__row") - F.col("__first")).drop("__range", "__row", "__before", "__first")


def format_chats(messages: DataFrame, **columns: str) -> DataFrame:
    """Per message: conv_id, position (from 0), turn, role, parent (the turn it
    replies to), root (the thread's first turn), depth, quotes (array of level,
    turn), text (without quotes)."""
    before = written()
    parsed = cut(parse(messages, **columns), "parsed")
    linked = parsed.join(links(parsed), ["conv_id", "message"], "left").withColumn("parent", F.try_element_at("quotes", F.lit(1))["turn"])
    linked = cut(linked.select("conv_id", "turn", "role", "message", "own", "quotes", "parent"), "linked")
    known = linked.filter("conv_id is not null and turn is not null")
    # Repeated turns: their thread is that of the earliest parent among them.
    tree = threads(known.groupBy("conv_id", "turn").agg(F.min("parent").alias("parent")))
    placed = known.join(tree, ["conv_id", "turn"])
    placed = numbered(placed, "conv_id", ["root", "turn", "message"], "position")
    drop_since(before, "linked", "ranges")
    rest = linked.filter("conv_id is null or turn is null").withColumns({"root": F.col("turn"), "depth": F.lit(0).cast("long"), "position": F.lit(None).cast("long")})
    none = F.array().cast("array<struct<level:int,turn:bigint>>")
    return placed.unionByName(rest).select("conv_id", "position", "turn", "role", "parent", "root", "depth", F.coalesce("quotes", none).alias("quotes"), F.col("own").alias("text"))
