"""Onboarding: where to start reading, hot spots, sections and safe areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_name
from ..schema import UNKNOWN
from . import graph, health
from .areas import configured, first_prefix


def entry_points(units: DataFrame, edges: DataFrame, areas, top: int = 10) -> DataFrame:
    """Units that call but aren't called, no tests, in a known area."""
    rows = units.filter(~is_test_name("file")).withColumn("area", first_prefix("file", areas)).filter(F.col("area") != UNKNOWN)
    return rows.join(graph.degrees(units, edges), "id").filter("n_in = 0 and n_out > 0").select("id", "name", "file", "area", "n_out").orderBy(F.desc("n_out"), "id").limit(top)


def hotspots(units: DataFrame, edges: DataFrame, areas, top: int = 10) -> DataFrame:
    """The 5 * top units of the highest score, then the top ones of these by
    the size of their whole closure; the first choice shows in the result."""
    ranked = health.caller_counts(units, edges, areas).filter(~is_test_name("file")).select("id", "name", "file", "callers", "spread", "score")
    first = ranked.orderBy(F.desc("score"), F.desc("id")).limit(5 * top)
    closure = graph.transitive_callers(units, edges, first).withColumnRenamed("root", "id")
    return first.join(closure, "id").select("id", "name", "file", "callers", "spread", F.col("n").alias("closure")).orderBy(F.desc("closure"), F.desc("id")).limit(top)


def area_frame(spark, areas) -> DataFrame:
    return spark.createDataFrame([(n, p, k) for k, (n, p) in enumerate(configured(areas))], "area string, path string, ord int")


def sections(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """Of each configured area: units, entries, and the shares of calls that
    leave it and stay in it."""
    place = units.select("id", first_prefix("file", areas).alias("area"))
    n = place.join(graph.degrees(units, edges), "id").groupBy("area").agg(F.count("*").alias("units"), F.count_if(F.expr("n_in = 0 and n_out > 0")).alias("entries"))
    adj = graph.adjacency(units, edges).join(place.select(F.col("id").alias("src_id"), F.col("area").alias("area")), "src_id").join(place.select(F.col("id").alias("dst_id"), F.col("area").alias("to")), "dst_id")
    shares = adj.groupBy("area").agg((F.count_if(F.col("area") != F.col("to")) / F.count("*")).alias("coupling"), (F.count_if(F.col("area") == F.col("to")) / F.count("*")).alias("cohesion"))
    return area_frame(units.sparkSession, areas).join(n, "area", "left").join(shares, "area", "left").na.fill(0).select("area", "path", "units", "entries", "coupling", "cohesion")


def safe_areas(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """Of each area with units: dead share, and the share that tests reach,
    also through other tests; safest first."""
    test = is_test_name("file")
    reached = graph.reach(units, edges, units.filter(test)).join(units.filter(~test).select("id"), "id", "left_semi").withColumn("reached", F.lit(True))
    rows = units.select("id", first_prefix("file", areas).alias("area")).filter(F.col("area") != UNKNOWN)
    rows = rows.join(graph.degrees(units, edges), "id").join(reached, "id", "left")
    out = rows.groupBy("area").agg((F.count_if(F.expr("n_in = 0 and n_out = 0")) * 100.0 / F.count("*")).alias("dead_pct"), (F.count_if(F.col("reached").isNotNull()) * 100.0 / F.count("*")).alias("surface"))
    return out.orderBy("dead_pct", F.desc("surface"), "area")


def area_dependencies(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """src_area, dst_area: known areas of which one calls the other."""
    e = health.placed_edges(units, edges, areas)
    return e.filter((F.col("src_area") != F.col("dst_area")) & (F.col("src_area") != UNKNOWN) & (F.col("dst_area") != UNKNOWN)).select("src_area", "dst_area").distinct()


def neighbours(dependencies: DataFrame, area: str) -> DataFrame:
    d = dependencies.filter((F.col("src_area") == area) | (F.col("dst_area") == area))
    return d.select(F.when(F.col("src_area") == area, F.col("dst_area")).otherwise(F.col("src_area")).alias("area")).distinct()


def reading_order(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """ord, area: what an area needs comes before it. Cycles are broken at the
    area with the fewest unread needs, ties by name. Areas are a configuration
    of some dozens, ordered on the driver."""
    needs = {name: set() for name, _ in configured(areas)}
    for r in area_dependencies(units, edges, areas).collect():  # at most areas squared
        needs[r["src_area"]].add(r["dst_area"])
    order: list[str] = []
    while len(order) < len(needs):
        left = [n for n in needs if n not in order]
        order.append(min(left, key=lambda n: (len(needs[n] - set(order)), n)))
    return units.sparkSession.createDataFrame([(k, n) for k, n in enumerate(order)], "ord long, area string")


def things_to_know(notes: DataFrame) -> DataFrame:
    """Titles of warnings, then decisions; stale ones are left out."""
    rank = F.when(F.col("type") == "warning", 0).when(F.col("type") == "decision", 1)
    return notes.filter("status <> 'stale'").withColumn("rank", rank).filter("rank is not null").select("rank", "id", "title").orderBy("rank", "id")


def plan(units: DataFrame, edges: DataFrame, areas, top: int = 10, notes: DataFrame | None = None, intent: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of a plan; things to know and the intent where there are any."""
    more = {}
    if notes is not None:
        more["things_to_know"] = things_to_know(notes)
    if intent is not None:
        more["intent"] = intent
    return more | {
        "entry_points": entry_points(units, edges, areas, top),
        "hotspots": hotspots(units, edges, areas, top),
        "sections": sections(units, edges, areas),
        "safe_areas": safe_areas(units, edges, areas),
        "reading_order": reading_order(units, edges, areas),
    }
