"""Health metrics of the graph; each is a frame of one row unless it lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import trend
from ..functions.text import is_test_name
from ..lineage import cut
from . import closures, graph
from .areas import first_prefix

METRICS = ("coupling", "avg_blast", "dead_code_pct", "cohesion", "test_surface", "drift_velocity", "hub_concentration")


def _share(part, whole, times: float = 1.0) -> Column:
    """part / whole, 0 if there is no whole."""
    return F.coalesce(F.try_divide(part * F.lit(times), whole), F.lit(0.0)).cast("double")


def placed_edges(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """Valid edges with the areas of both ends."""
    return placed(units, graph.valid_edges(units, edges), areas)


def placed(units: DataFrame, valid: DataFrame, areas) -> DataFrame:
    area = units.select("id", first_prefix("file", areas).alias("area"))
    e = valid.select("src_id", "dst_id", "rel_type")
    e = e.join(area.select(F.col("id").alias("src_id"), F.col("area").alias("src_area")), "src_id")
    return e.join(area.select(F.col("id").alias("dst_id"), F.col("area").alias("dst_area")), "dst_id")


def coupling(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """Valid edges between areas, of all edges but boundaries."""
    cross = placed_edges(units, edges, areas).agg(F.count_if(F.col("src_area") != F.col("dst_area")).alias("cross"))
    return cross.crossJoin(graph.calls(edges).agg(F.count("*").alias("n"))).select(_share(F.col("cross"), F.col("n")).alias("coupling"))  # one row each


def cohesion(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """Mean over source areas of the share of edges that stay inside."""
    by = placed_edges(units, edges, areas).groupBy("src_area").agg((F.count_if(F.col("src_area") == F.col("dst_area")) / F.count("*")).alias("share"))
    # Summed in the order of the areas, so that the last digit is stable.
    return by.agg(F.array_sort(F.collect_list(F.struct("src_area", "share"))).alias("s")).select(_share(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["share"]), F.size("s")).alias("cohesion"))


def average_closure(units: DataFrame, edges: DataFrame, adj: DataFrame | None = None) -> DataFrame:
    """Mean number of callers at one or two steps, over all units; on a cycle a
    unit counts itself. adj: the adjacency, if it is written already."""
    adj = cut(graph.adjacency(units, edges)) if adj is None else adj
    return closures.closure_total(units, adj).crossJoin(units.agg(F.count("*").alias("n"))).select(_share(F.col("pairs"), F.col("n")).alias("avg_blast"))  # one row each


def dead_share(units: DataFrame, edges: DataFrame) -> DataFrame:
    return dead_of(graph.degrees(units, edges))


def dead_of(degrees: DataFrame) -> DataFrame:
    return degrees.agg(_share(F.count_if((F.col("n_in") == 0) & (F.col("n_out") == 0)), F.count("*"), 100.0).alias("dead_code_pct"))


def tested(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Units that tests reach without passing through tests."""
    test = is_test_name("file")
    return graph.reach(units, edges, units.filter(test), through=units.filter(~test))


def test_surface(units: DataFrame, edges: DataFrame) -> DataFrame:
    n = units.agg(F.count_if(~is_test_name("file")).alias("n"))
    return tested(units, edges).agg(F.count("*").alias("reached")).crossJoin(n).select(_share(F.col("reached"), F.col("n"), 100.0).alias("test_surface"))  # one row each


def hub_concentration(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of edges at the best-linked twentieth of units, ties included."""
    return hub_edges(graph.valid_edges(units, edges), cut(graph.degrees(units, edges))).crossJoin(graph.calls(edges).agg(F.count("*").alias("n"))).select(_share(F.col("hub"), F.col("n"), 100.0).alias("hub_concentration"))  # one row each


def hub_edges(valid: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row, hub: valid edges at the best-linked twentieth of units."""
    degree = degrees.select("id", (F.col("n_in") + F.col("n_out")).alias("degree"))
    # The threshold row from counts by degree, not from ranking all units.
    by = degree.groupBy("degree").agg(F.count("*").alias("n"))
    total = by.agg(F.greatest(F.lit(1), F.floor(F.sum("n") * 0.05)).alias("cutoff"))
    above = by.crossJoin(total).withColumn("upto", F.sum("n").over(W.orderBy(F.desc("degree")))).filter("upto >= cutoff").agg(F.max("degree").alias("least"))  # a row a degree
    hubs = degree.crossJoin(above).filter("degree >= least and degree > 0").select("id")  # one row
    e = valid.select("src_id", "dst_id")
    e = e.join(hubs.select(F.col("id").alias("src_id"), F.lit(True).alias("a")), "src_id", "left").join(hubs.select(F.col("id").alias("dst_id"), F.lit(True).alias("b")), "dst_id", "left")
    return e.agg(F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("hub"))


def caller_counts(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """id, callers, spread (areas of the callers), score, of every unit."""
    place = units.select(F.col("id").alias("src_id"), first_prefix("file", areas).alias("area"))
    n = graph.adjacency(units, edges).join(place, "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("callers"), F.count_distinct("area").alias("spread"))
    out = units.join(n, "id", "left").na.fill(0, ["callers", "spread"])
    return out.withColumn("score", F.col("callers") * F.greatest(F.col("spread"), F.lit(1)))


def hotspots(units: DataFrame, edges: DataFrame, areas, top: int = 10) -> DataFrame:
    return caller_counts(units, edges, areas).select("id", "name", "file", "callers", "spread", "score").orderBy(F.desc("score"), "id").limit(top)


def drift_velocity(snapshots: DataFrame, current: int, now: int) -> DataFrame:
    """Changes of the number of units over the last 7 days, by day. snapshots:
    build_ts (seconds), unit_count: a short history, a row a build."""
    recent = snapshots.filter(F.col("build_ts") >= now - 7 * 86400)
    order = W.orderBy("build_ts", "unit_count")
    step = recent.select("build_ts", "unit_count", F.abs(F.col("unit_count") - F.lag("unit_count").over(order)).alias("step"))
    n = step.agg(F.coalesce(F.sum("step"), F.lit(0)).alias("moved"), F.min("build_ts").alias("first"), F.max_by("unit_count", F.struct("build_ts", "unit_count")).alias("last"))
    days = F.greatest((F.lit(now) - F.col("first")) / 86400.0, F.lit(0.01))
    return n.select(F.coalesce((F.col("moved") + F.abs(F.lit(current) - F.col("last"))) / days, F.lit(0.0)).alias("drift_velocity"))


def deltas(snapshots: DataFrame, metric: str, steps: int = 1) -> DataFrame:
    """Each snapshot against the one `steps` before it."""
    before = F.lag(metric, steps).over(W.orderBy("build_ts"))
    return snapshots.select("build_ts", F.col(metric).alias("value"), (F.col(metric) - before).alias("delta"), trend(F.col(metric) - before).alias("trend"))


# The steps of a sparkline.
BARS = "▁▂▃▄▅▆▇█"


def sparkline(snapshots: DataFrame, metric: str) -> DataFrame:
    """Each snapshot's bar, by its place between least and most."""
    bound = snapshots.agg(F.min(metric).alias("low"), F.max(metric).alias("high"))
    share = F.coalesce(F.try_divide((F.col(metric) - F.col("low")).cast("double"), (F.col("high") - F.col("low")).cast("double")), F.lit(0.0))
    bar = F.least(F.floor(share * 8), F.lit(7))
    return snapshots.crossJoin(bound).select("build_ts", bar.cast("long").alias("bar"), F.substring(F.lit(BARS), (bar + 1).cast("int"), F.lit(1)).alias("sign"))  # one row


def metrics(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """All metrics of the graph itself in one row. Valid edges and degrees
    are found once and written; what divides by all edges but boundaries gets their number."""
    valid = cut(graph.valid_edges(units, edges).select("src_id", "dst_id", "rel_type"))
    adj = cut(valid.select("src_id", "dst_id").distinct())
    degrees = cut(graph.degrees_of(units, adj))
    n = graph.calls(edges).agg(F.count("*").alias("edge_count"))
    own = units.agg(F.count("*").alias("unit_count"))
    cross = placed(units, valid, areas).agg(F.count_if(F.col("src_area") != F.col("dst_area")).alias("cross"))
    out = cross.crossJoin(n).crossJoin(own)  # one row each
    for one in (average_closure(units, valid, adj), dead_of(degrees), cohesion(units, valid, areas), test_surface(units, valid), hub_edges(valid, degrees)):
        out = out.crossJoin(one)
    coupling_ = _share(F.col("cross"), F.col("edge_count")).alias("coupling")
    hub = _share(F.col("hub"), F.col("edge_count"), 100.0).alias("hub_concentration")
    return out.select(coupling_, "avg_blast", "dead_code_pct", "cohesion", "test_surface", hub, "unit_count", "edge_count")
