"""The graph kernel: adjacency, callers, closures and reachability.

Everything is answered for all targets in one plan; a step is one join on the
node, and depths are reduced with a partial aggregation, so hubs are collapsed
before they are shuffled on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import in_tests
from ..lineage import cut
from ..schema import BOUNDARY, EXTERNAL_PREFIX, IMPORT
from .areas import head


def calls(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("rel_type") != BOUNDARY)


def valid_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges but boundaries of which both ends are units."""
    ids = units.select("id")
    return calls(edges).join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def adjacency(units: DataFrame, edges: DataFrame) -> DataFrame:
    return valid_edges(units, edges).select("src_id", "dst_id").distinct()


def degrees(units: DataFrame, edges: DataFrame) -> DataFrame:
    """id, n_out, n_in: neighbours, of every unit."""
    return degrees_of(units, adjacency(units, edges))


def degrees_of(units: DataFrame, adj: DataFrame) -> DataFrame:
    ends = adj.select(F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(adj.select("dst_id", F.lit(0), F.lit(1)))
    n = ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return units.select("id").join(n, "id", "left").na.fill(0, ["n_out", "n_in"])


def multi_degrees(edges: DataFrame) -> DataFrame:
    """id, calls_out, calls_in: edges but boundaries, each counted."""
    e = calls(edges)
    ends = e.select(F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("calls_out"), F.sum("i").alias("calls_in"))


def called_by(units: DataFrame, edges: DataFrame) -> DataFrame:
    """target, caller, known: distinct calls of other units, and whether the
    caller is a unit."""
    back = calls(edges).select(F.col("dst_id").alias("target"), F.col("src_id").alias("caller")).filter("target <> caller").distinct()
    ids = units.select(F.col("id").alias("caller"), F.lit(True).alias("known")).distinct()
    return back.join(ids, "caller", "left").select("target", "caller", F.coalesce("known", F.lit(False)).alias("known"))


def callers(units: DataFrame, edges: DataFrame, depth: int = 2, targets: DataFrame | None = None, back: DataFrame | None = None) -> DataFrame:
    """target, caller, depth (the first at which it is met), for all targets or
    those of a frame with a column id. Callers that are no units are passed
    through but not returned; a target is never its own caller. back: called_by,
    if it is there already."""
    back = called_by(units, edges) if back is None else back
    step = back.select(F.col("target").alias("caller"), F.col("caller").alias("next"), F.col("known").alias("known_next"))
    level = back if targets is None else back.join(targets.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    found = level.withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        level = level.select("target", "caller").join(step, "caller").select("target", F.col("next").alias("caller"), F.col("known_next").alias("known")).filter("target <> caller")
        # The last step's rows are grouped below.
        level = level.distinct() if k < depth else level
        found = found.unionByName(level.withColumn("depth", F.lit(k)))
    return found.filter("known").groupBy("target", "caller").agg(F.min("depth").alias("depth"))


def boundary_callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, caller of boundary edges."""
    return edges.filter(F.col("rel_type") == BOUNDARY).select(F.col("dst_id").alias("target"), F.col("src_id").alias("caller")).distinct().join(targets.select(F.col("id").alias("target")), "target", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """Calls in either direction, written once: each hop reads them."""
    e = calls(edges).select("src_id", "dst_id")
    return cut(e.union(e.select("dst_id", "src_id")).distinct())


def two_hops(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False, few: bool = False) -> DataFrame:
    """id of what is at most two steps from the seeds, in either direction.
    few: the seeds are known to be few (a search's top k), so that nothing need
    be written between the steps."""
    if few:
        e = calls(edges)
        both = e.select("src_id", "dst_id").union(e.select("dst_id", "src_id"))
        start = seeds.select("id")
        one = both.join(F.broadcast(start.withColumnRenamed("id", "src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("id"))
        # The neighbours of a few units can be many: no broadcast.
        two = both.join(one.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("id"))
        found = one.union(two)
        return (found.union(start) if include_seeds else found.join(F.broadcast(start), "id", "left_anti")).distinct()
    both = both_ways(edges)
    start = cut(seeds.select("id").distinct())

    def step(ids: DataFrame) -> DataFrame:
        return both.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct()

    one = cut(step(start))
    found = one.union(step(one)).distinct()
    return found.union(start).distinct() if include_seeds else found.join(start, "id", "left_anti")


def boundary_warnings(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Boundary edges that touch the seeds or what is one step away."""
    both = both_ways(edges)
    start = cut(seeds.select("id").distinct())
    one = both.join(start.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("id"))
    near = start.union(one).distinct()
    b = edges.filter(F.col("rel_type") == BOUNDARY).select("src_id", "dst_id")
    out = b.join(near.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select("src_id", "dst_id")
    into = b.join(near.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id")
    return out.union(into).distinct()


def update_scope(units: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files that a change of the given files can touch: those two steps away."""
    seeds = units.join(files.select("file"), "file", "left_semi").select("id")
    near = two_hops(edges, seeds, include_seeds=True)
    return units.join(near, "id", "left_semi").select("file").union(files.select("file")).distinct()


def reach(units: DataFrame, edges: DataFrame, seeds: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """id of the units that the seeds reach along calls. With `through` only
    its units are entered, and only they are returned; without it any unit is,
    and the seeds aren't returned. Rounds go on until nothing new is met, which
    every graph comes to; each is written, so lineage stays short, and what has
    been seen is written anew every few rounds, so it is few files."""
    adj = cut(adjacency(units, edges) if through is None else adjacency(units, edges).join(through.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id"))
    start = cut(seeds.select("id").distinct())
    seen = _rounds(start, ["id"], lambda frontier: adj.join(frontier.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct())
    return seen.join(start, "id", "left_anti")


def spread_over(start: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the start ones and of all that they reach along edges (src_id,
    dst_id), which are written."""
    return _rounds(start, ["id"], lambda frontier: edges.join(frontier.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct())


#: Rounds after which what has been seen is written as one.
MERGE = 16


def _rounds(seen: DataFrame, key: list[str], step) -> DataFrame:
    """All that step leads to from the rows seen, round by round."""
    frontier, parts = seen, 1
    while True:
        frontier = cut(step(frontier).join(seen, key, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen, parts = seen.union(frontier), parts + 1
        if parts == MERGE:
            seen, parts = cut(seen), 1


def layers(nodes: DataFrame, successors: DataFrame) -> DataFrame:
    """id, layer: 0 for nodes (id) without a successor (src_id, dst_id), else
    one more than the highest layer of the successors; nodes on a cycle, and
    those that lead to one, share a layer behind all others. A round a layer."""
    left, edges, done, k = cut(nodes.select("id").distinct()), cut(successors.filter("src_id <> dst_id").select("src_id", "dst_id").distinct()), None, 0
    while True:
        free = cut(left.join(edges.select(F.col("src_id").alias("id")), "id", "left_anti").select("id", F.lit(k).cast("long").alias("layer")))
        rest = left.join(free, "id", "left_anti")
        if free.isEmpty():
            held = rest.select("id", F.lit(k).cast("long").alias("layer"))
            return held if done is None else done.union(held)
        done = free if done is None else done.union(free)
        left, edges, k = cut(rest), cut(edges.join(free.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")), k + 1


def transitive_callers(units: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, n: how many units reach each root along calls. The pairs of root
    and caller are written, so the roots are an area or a report's top, not all
    units."""
    back = cut(adjacency(units, edges).select(F.col("dst_id").alias("id"), F.col("src_id").alias("caller")))
    start = cut(roots.select(F.col("id").alias("root"), F.col("id")).distinct())
    seen = _rounds(start, ["root", "id"], lambda frontier: frontier.join(back, "id").select("root", F.col("caller").alias("id")).distinct())
    return seen.groupBy("root").agg((F.count("*") - 1).alias("n"))


def with_target(closure: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id: each target itself and its callers."""
    return closure.select("target", F.col("caller").alias("id")).union(targets.select(F.col("id").alias("target"), "id"))


def test_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    """id, test: edges of any kind out of units under tests/."""
    tests = units.filter(in_tests("file")).select(F.col("id").alias("src_id"))
    return edges.join(tests, "src_id", "left_semi").select(F.col("dst_id").alias("id"), F.col("src_id").alias("test")).distinct()


def covering_tests(units: DataFrame, edges: DataFrame, closure: DataFrame, targets: DataFrame) -> DataFrame:
    """target, test: tests with an edge into a target or one of its callers."""
    return with_target(closure, targets).join(test_edges(units, edges), "id").select("target", "test").distinct()


def uncovered(units: DataFrame, edges: DataFrame, closure: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id: a target and its callers that no test has an edge into."""
    return with_target(closure, targets).join(test_edges(units, edges), "id", "left_anti").filter(~F.col("id").startswith(EXTERNAL_PREFIX)).select("target", "id").distinct()


def trust_boundaries(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Units that nothing calls; imports and boundaries are no calls."""
    called = edges.filter(~F.col("rel_type").isin(BOUNDARY, IMPORT)).select(F.col("dst_id").alias("id"))
    return units.join(called, "id", "left_anti")


def numbered(ids: DataFrame, *order: str) -> DataFrame:
    """id, number: dense from 1, in this order: counted within ranges, as many as a
    shuffle has, whose offsets are a row each."""
    width = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "id"]
    dealt = cut(ids.repartitionByRange(width, *by).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy(*by))
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("own")).alias("number"))  # a row a range


def note_ancestry(note_edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """start, id, depth: notes that lead to the start ones, first visit first.
    Starts go along the edges 64 at a time, as the bits of a long: a note hands on
    those that it has met last."""
    back = cut(note_edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("next")).distinct())
    k = F.col("number") - 1
    starts = cut(numbered(start.select("id").distinct()).select("id", F.floor(k / 64).alias("word"), (k % 64).cast("int").alias("bit")))
    seen = level = cut(starts.select("id", "word", F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("depth")))
    for step in range(1, depth + 1):
        met = level.join(back, "id").groupBy(F.col("next").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        both = met.withColumn("old", F.lit(None).cast("long")).unionByName(seen.select("id", "word", F.lit(None).cast("long").alias("bits"), F.col("bits").alias("old")))
        new = both.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old")).filter("bits is not null")
        level = cut(new.select("id", "word", F.expr("bits & ~coalesce(old, 0L)").alias("bits")).filter("bits <> 0").withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    names = starts.groupBy("word").agg(F.collect_list(F.struct("bit", F.col("id").alias("start"))).alias("names"))  # 64 at most
    own = F.filter("names", lambda x: F.getbit("bits", x["bit"]) == 1)
    return seen.join(names, "word").select("id", "depth", F.explode(own).alias("x")).select("x.start", "id", "depth")


def area_spread(units: DataFrame, closure: DataFrame, targets: DataFrame) -> DataFrame:
    """target, spread: areas of a target and its callers."""
    place = units.select("id", head("file").alias("area"))
    return with_target(closure, targets).join(place, "id").groupBy("target").agg(F.count_distinct("area").alias("spread"))
