"""What a team means to do, laid over results: an intent document is one row
with arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "sprint string, goal string, priority array<string>, deprioritised array<string>, incidents array<struct<id:string,description:string,severity:string,status:string,areas:array<string>>>, avoid array<string>, principles array<string>, concerns array<string>"


def relevance(areas: Column, priority: Column, low: Column) -> Column:
    return F.when(F.arrays_overlap(areas, priority), "HIGH").when(F.arrays_overlap(areas, low), "LOW").when(F.size(areas) > 0, "MEDIUM").otherwise("UNKNOWN")


def enrich(results: DataFrame, intent: DataFrame) -> DataFrame:
    """results (with an array column areas) and the one row of the intent."""
    rows = results.crossJoin(F.broadcast(intent.limit(1)))  # one row
    touched = F.filter("incidents", lambda i: ~i["status"].isin("closed", "patched") & F.arrays_overlap(i["areas"], F.col("areas")))
    advice = F.concat(F.transform("avoid", lambda x: F.concat(F.lit("AVOID: "), x)), F.transform("principles", lambda x: F.concat(F.lit("PRINCIPLE: "), x)))
    concern = F.get(F.filter("concerns", lambda c: F.exists("areas", lambda a: F.contains(c, a))), F.lit(0))
    return rows.select(*results.columns, relevance(F.col("areas"), F.col("priority"), F.col("deprioritised")).alias("relevance"), touched.alias("open_incidents"), advice.alias("guidance"), concern.alias("concern"))


def unknown_areas(intent: DataFrame, areas: list[str]) -> DataFrame:
    """Names in the document that are no areas."""
    every = intent.select(F.explode(F.array_distinct(F.concat("priority", "deprioritised", F.flatten(F.transform("incidents", lambda i: i["areas"]))))).alias("area"))
    return every.filter(~F.col("area").isin(*areas)).distinct()


def inject(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Each row as JSON with the one row of extra in it."""
    return rows.crossJoin(F.broadcast(extra.limit(1))).select(F.to_json(F.struct(*rows.columns, *extra.columns)).alias("json"))  # one row
