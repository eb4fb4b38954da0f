"""The graph for drawing: known units, edges among them, degrees, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph
from .areas import longest_prefix


def viz_nodes(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    """id, area, region, n_in, n_out, is_entry. Regions count areas by their
    first unit in the order of file, name and id, unknown included."""
    rows = units.select("id", "name", "file", longest_prefix("file", areas).alias("area"))
    first = rows.groupBy("area").agg(F.min(F.struct("file", "name", "id")).alias("first"))  # a row an area
    region = first.select("area", F.pmod(F.row_number().over(W.orderBy("first")) - 1, F.lit(5)).cast("long").alias("region"))
    known = rows.filter("area <> 'unknown'")
    n = graph.multi_degrees(viz_edges(units, edges, areas))
    out = known.join(region, "area").join(n, "id", "left").na.fill(0, ["calls_in", "calls_out"])
    return out.select("id", "area", "region", F.col("calls_in").alias("n_in"), F.col("calls_out").alias("n_out"), ((F.col("calls_in") == 0) & (F.col("calls_out") > 0)).alias("is_entry"))


def viz_edges(units: DataFrame, edges: DataFrame, areas) -> DataFrame:
    known = units.filter(longest_prefix("file", areas) != "unknown").select("id")
    e = graph.calls(edges).join(known.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
    return e.join(known.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id", "rel_type")


def export_json(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(*nodes.columns)).alias("json"))


def flow_colour(n_in, n_out):
    """source, sink, both or none, by what goes in and out."""
    i, o = F.col(n_in) > 0, F.col(n_out) > 0
    return F.when(i & o, "both").when(o, "source").when(i, "sink").otherwise("none")
