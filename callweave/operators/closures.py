"""Sizes of closures without their pairs.

Units are numbered densely, those of a file and of a folder one after the other,
and numbers are cut into buckets of 32,768. Of a set, a bucket of more than DENSE
members is a bitmap of 4 KB, of fewer a row a member, so that a set never takes more
than a bounded number of bytes a member, however many buckets there are. Unions are
distinct rows and Spark's bitmap aggregates, partial on the side that sends. A
target whose callers at two steps can be many - which the degrees tell - costs bits
for these, not rows; all others cost at most HUB rows each.

For all transitive callers, strongly connected components come first: what has no
way in or out is one of its own, layer by layer; of what is left, the largest number
that reaches a unit colours it, and what reaches the unit of that number within its
colour is a component. Then the components' sets are united along the graph
without cycles, a round a layer. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import graph
from .areas import head
from .graph import numbered

#: Callers of callers from which on a target's sets are bitmaps, and members of a
#: bucket from which on it is one.
HUB, DENSE = 1 << 16, 256


def _bits(number: Column) -> list[Column]:
    return [F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit")]


def as_bitmaps(rows: DataFrame, key: str = "a") -> DataFrame:
    """key, bucket, bits of key, number."""
    return rows.select(key, *_bits(F.col("number"))).groupBy(key, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def united(*sets: DataFrame, key: str = "a") -> DataFrame:
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy(key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, name: str, key: str = "a") -> DataFrame:
    return sets.groupBy(key).agg(F.sum(F.bitmap_count("bits")).alias(name))


def as_rows(rows: DataFrame, key: str = "a") -> DataFrame:
    """key, bucket, bit, bits (none) of key, number: a set by its members."""
    return rows.select(key, *_bits(F.col("number")), F.lit(None).cast("binary").alias("bits"))


def packed(sets: DataFrame, key: str = "a", dense: int = DENSE) -> DataFrame:
    """key, bucket, bit, bits: each member once, buckets of more than dense of
    them as a bitmap, in bits; sets may hold both, and members repeatedly."""
    sets = cut(sets.select(key, "bucket", "bit", "bits"))
    n = sets.groupBy(key, "bucket").agg(F.count("bit").alias("n"), F.count("bits").alias("maps"))
    full = cut(n.filter((F.col("n") > dense) | (F.col("maps") > 0)).select(key, "bucket"))
    rows = sets.filter("bit is not null")
    few = rows.join(full, [key, "bucket"], "left_anti").select(key, "bucket", "bit").distinct()
    many = bitmaps(sets.join(full, [key, "bucket"], "left_semi"), key)
    return cut(few.withColumn("bits", F.lit(None).cast("binary")).unionByName(many.withColumn("bit", F.lit(None).cast("long")).select(key, "bucket", "bit", "bits")))


def bitmaps(sets: DataFrame, key: str = "a") -> DataFrame:
    """key, bucket, bits of key, bucket, bit, bits."""
    rows = sets.filter("bit is not null").groupBy(key, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return united(rows, sets.filter("bits is not null").select(key, "bucket", "bits"), key=key)


def over(links: DataFrame, sets: DataFrame) -> DataFrame:
    """a, bucket, bit, bits: for links (a, b) what each a's b have (sets by b)."""
    return links.join(sets, "b").select("a", "bucket", "bit", "bits")


def union_over(links: DataFrame, members: DataFrame, dense: int = DENSE) -> DataFrame:
    """a, bucket, bits: for links (a, b) the union of the members (b, number) of
    each a's b. What a b has in a bucket is one bitmap for all its links, if it is much."""
    return bitmaps(over(links, packed(as_rows(members, "b"), "b", dense)))


def _bounds(back: DataFrame) -> DataFrame:
    """a, n: at most so many callers at one and two steps."""
    n = back.groupBy("a").agg(F.count("*").alias("n"))
    return back.join(n.select(F.col("a").alias("b"), F.col("n").alias("m")), "b", "left").groupBy("a").agg((F.count("*") + F.coalesce(F.sum("m"), F.lit(0))).alias("n"))


class Closures:
    """Callers of targets at one and two steps: those of hubs as sets, others as
    pairs. What both need is written once."""

    def __init__(self, units: DataFrame, edges: DataFrame, targets: DataFrame | None = None, hub: int = HUB):
        self.units, self.edges = units, edges
        back = cut(graph.called_by(units, edges))
        self.back = back.select(F.col("target").alias("a"), F.col("caller").alias("b"))
        hubs = _bounds(self.back).filter(F.col("n") > hub).select(F.col("a").alias("id"))
        asked = units.select("id") if targets is None else targets.select("id").distinct()
        self.hubs = cut(asked.join(hubs, "id", "left_semi"))
        self.any = not self.hubs.isEmpty()
        self.rest = asked.join(self.hubs, "id", "left_anti") if self.any else asked
        # Of all units, also of names that are no units.
        self.few = cut(graph.callers(units, edges, 2, None if targets is None and not self.any else self.rest, back))
        if self.any:
            self.number = cut(numbered(units.select("id", "file"), "file"))
            self.links = cut(self.back.join(self.hubs.select(F.col("id").alias("a")), "a", "left_semi"))

    def _numbers(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.join(self.number.withColumnRenamed("id", column), column).drop(column)

    def counts(self) -> DataFrame:
        """target, direct, indirect, callers; no row for targets without any."""
        few = self.few.groupBy("target").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("callers"))
        if not self.any:
            return few.select("target", "direct", (F.col("callers") - F.col("direct")).alias("indirect"), "callers")
        one = as_bitmaps(self._numbers(self.links.select("a", F.col("b").alias("c")), "c"))
        of_middle = self._numbers(self.back.join(self.links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("m"), "b"), "b").withColumnRenamed("m", "b")
        both = united(one, union_over(self.links, of_middle))
        # A target that calls one of its callers is in their sets, but not its own caller.
        own = self.links.join(self.back.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi").select("a").distinct()
        own = self._numbers(own.select("a", F.col("a").alias("c")), "c").select("a", F.lit(1).alias("own"))
        many = sizes(both, "all").join(sizes(one, "direct"), "a", "left").join(own, "a", "left").select(F.col("a").alias("target"), F.coalesce("direct", F.lit(0)).alias("direct"), (F.col("all") - F.coalesce("own", F.lit(0))).alias("callers"))
        return few.unionByName(many.filter("callers > 0")).select("target", "direct", (F.col("callers") - F.col("direct")).alias("indirect"), "callers")

    def _areas(self) -> DataFrame:
        return self.units.select("id", head("file").alias("area"))

    def spread(self) -> DataFrame:
        """target, spread: areas of each target and its callers. For hubs the
        areas of a middle unit's callers are found once."""
        few = graph.area_spread(self.units, self.few, self.rest)
        if not self.any:
            return few
        place = self._areas()
        one = self.back.join(place.withColumnRenamed("id", "b"), "b").select("a", "area").distinct()
        own = self.hubs.join(place, "id").select(F.col("id").alias("a"), "area")
        through = self.links.join(one.select(F.col("a").alias("b"), "area"), "b").select("a", "area")
        direct = one.join(self.hubs.select(F.col("id").alias("a")), "a", "left_semi")
        # A target in its callers' sets is in its own area, which counts anyway.
        many = own.union(direct).union(through).distinct().groupBy(F.col("a").alias("target")).agg(F.count("*").alias("spread"))
        return few.unionByName(many)

    def tests(self) -> DataFrame:
        """target, tests: those with an edge into a target or one of its callers."""
        few = graph.covering_tests(self.units, self.edges, self.few, self.rest).groupBy("target").agg(F.count("*").alias("tests"))
        if not self.any:
            return few
        into = cut(self._numbers(graph.test_edges(self.units, self.edges), "test"))  # id, number
        known = self.units.select(F.col("id").alias("b"))
        links = self.links.join(known, "b", "left_semi")
        own = into.join(self.hubs, "id", "left_semi").select(F.col("id").alias("a"), "number")
        direct = union_over(links, into.withColumnRenamed("id", "b"))
        middle = self.back.join(self.links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(known, "b", "left_semi")
        second = packed(over(middle, packed(as_rows(into.withColumnRenamed("id", "b"), "b"), "b")))  # by middle unit, its callers' tests
        through = bitmaps(over(self.links, second.withColumnRenamed("a", "b")))
        many = sizes(united(as_bitmaps(own), direct, through), "tests").withColumnRenamed("a", "target")
        return few.unionByName(many)


def closure_total(units: DataFrame, adj: DataFrame) -> DataFrame:
    """One row, pairs: callers at one and two steps over all units; a unit on a
    cycle of one or two counts itself. adj: the adjacency, written."""
    found = Closures(units, adj.withColumn("rel_type", F.lit("call"))).counts().agg(F.coalesce(F.sum("callers"), F.lit(0)).alias("n"))
    turned = adj.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    own = adj.join(turned, ["src_id", "dst_id"], "left_semi").select("src_id").distinct().agg(F.count("*").alias("own"))
    return found.crossJoin(own).select((F.col("n") + F.col("own")).alias("pairs"))  # one row each


# --------------------------------------------------- all transitive callers


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges of which both ends have a way in and a way out: those on or between
    cycles. A round for each layer that goes."""
    while True:
        n = edges.count()
        ends = edges.select(F.col("src_id").alias("id")).intersect(edges.select(F.col("dst_id").alias("id")))
        edges = cut(edges.join(ends.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ends.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id"))
        if edges.count() == n:
            return edges


def cycles(adjacency: DataFrame) -> DataFrame:
    """id, root: the units on cycles, by component; root is one of its units."""
    left, found = _trimmed(cut(adjacency.filter("src_id <> dst_id").select("src_id", "dst_id"))), None
    while not left.isEmpty():
        nodes = left.select(F.col("src_id").alias("id")).union(left.select("dst_id")).distinct()
        # The largest id that reaches a unit is its colour.
        colour = cut(nodes.withColumn("colour", F.col("id")))
        while True:
            met = left.join(colour.withColumnRenamed("id", "src_id"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.max("colour").alias("met"))
            after = cut(colour.join(met, "id", "left").select("id", F.greatest("colour", F.coalesce("met", "colour")).alias("colour"), (F.col("met") > F.col("colour")).alias("moved")))
            colour = after.select("id", "colour")
            if after.filter("moved").isEmpty():
                break
        inner = cut(left.join(colour.select(F.col("id").alias("src_id"), F.col("colour").alias("a")), "src_id").join(colour.select(F.col("id").alias("dst_id"), F.col("colour").alias("b")), "dst_id").filter("a = b").select("src_id", "dst_id"))
        # Within a colour, what reaches the unit that gave it is on a cycle with it.
        start = cut(colour.filter("id = colour").select("id"))
        own = graph.spread_over(start, inner.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
        own = cut(own.join(colour, "id").select("id", F.col("colour").alias("root")))
        found = own if found is None else found.unionByName(own)
        rest = left.join(own.select(F.col("id").alias("src_id")), "src_id", "left_anti").join(own.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
        left = _trimmed(cut(rest.select("src_id", "dst_id")))
    if found is None:
        return adjacency.select(F.col("src_id").alias("id"), F.col("dst_id").alias("root")).limit(0)
    # A component of one is no cycle.
    size = found.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(size.select("root"), "root", "left_semi").select("id", "root")


def all_transitive_callers(units: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n: of every unit, how many other units reach it along calls."""
    adj = cut(graph.adjacency(units, edges))
    on = cut(cycles(adj))
    root = cut(units.select("id", "file").join(on, "id", "left").select("id", "file", F.coalesce("root", "id").alias("root")))
    size = cut(root.groupBy("root").agg(F.count("*").alias("size")))
    named = adj.join(root.select(F.col("id").alias("src_id"), F.col("root").alias("b")), "src_id").join(root.select(F.col("id").alias("dst_id"), F.col("root").alias("a")), "dst_id")
    links = cut(named.filter("a <> b").select("a", "b").distinct())
    number = numbered(root, "file")
    own = packed(as_rows(number.join(root.select("id", F.col("root").alias("a")), "id").select("a", "number")))
    layer = cut(graph.layers(size.select(F.col("root").alias("id")), links.select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"))))
    reached, k = None, 1
    last = layer.agg(F.max("layer")).first()[0] or 0
    # What a component hands on: its own units, and what reaches them.
    handed = own
    while k <= last:
        now = layer.filter(F.col("layer") == k).select(F.col("id").alias("a"))
        to = links.join(now, "a", "left_semi")
        step = packed(over(to, handed.withColumnRenamed("a", "b")))
        reached = step if reached is None else reached.unionByName(step)
        if k < last:
            handed = handed.unionByName(step)
        k += 1
    n = size.select(F.col("root").alias("a"), (F.col("size") - 1).alias("n"))
    if reached is not None:
        more = reached.groupBy("a").agg(F.sum(F.coalesce(F.bitmap_count("bits"), F.lit(1))).alias("more"))
        n = n.join(more, "a", "left").select("a", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return root.join(n.withColumnRenamed("a", "root"), "root").select("id", "n")
