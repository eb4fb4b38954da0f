"""How far answers from an index can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_dynamic, in_tests
from . import graph

# Extensions of languages that may be in a tree.
LANGUAGES = ("ts", "tsx", "js", "jsx", "java", "kt", "go", "rs", "cpp", "c", "cs", "rb", "php", "swift", "scala", "r", "dart", "lua")


def unindexed(files: DataFrame, tracked: list[str], limit: int = 10) -> DataFrame:
    """ext of languages that are there but not tracked, the first by name."""
    ext = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    known = set(LANGUAGES) - {t.lstrip(".").lower() for t in tracked}
    return files.select(ext.alias("ext")).filter(F.col("ext").isin(*sorted(known))).distinct().orderBy("ext").limit(limit)


def dynamic_count(units: DataFrame) -> DataFrame:
    return units.agg(F.count_if(has_dynamic("signature", "docstring")).alias("dynamic"))


def missing_tests(units: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: units outside tests/ that no test reaches but through tests."""
    test = in_tests("file")
    rest = units.filter(~test)
    reached = graph.reach(units, edges, units.filter(test), through=rest)
    return rest.join(reached, "id", "left_anti").agg(F.count("*").alias("missing"))


def age_hours(last_build: Column | str, now: Column) -> Column:
    """Hours since an ISO time; 0 where it is missing or no time."""
    built = F.try_to_timestamp(F.col(last_build) if isinstance(last_build, str) else last_build)
    return F.greatest(F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(built)) / 3600.0, F.lit(0.0)), F.lit(0.0))


def factors(age, changed, total, languages, dynamic) -> Column:
    """Product of the four factors, each a half at least; within 0.5 and 1."""
    half = F.lit(0.5)
    f = F.greatest(half, 1 - F.col(age) / 168.0) * F.greatest(half, 1 - F.col(changed) / F.greatest(F.col(total), F.lit(1)))
    f = f * F.greatest(half, 1 - 0.1 * F.col(languages)) * F.when(F.col(dynamic) > 0, 0.9).otherwise(1.0)
    return F.least(F.greatest(f, half), F.lit(1.0))


def caveats(age, changed, total, languages, dynamic, missing) -> Column:
    """The remarks that apply, in order."""
    h, n = F.floor(F.col(age)).cast("string"), F.col(changed).cast("string")
    some = F.col(changed) > 0
    parts = [
        F.when(F.col(age) > 1, F.concat(F.lit("Graph is "), h, F.lit("h old"), F.when(some, F.concat(F.lit("; "), n, F.lit(" unit(s) changed"))).otherwise(""))),
        F.when(some, F.concat(n, F.lit(" unit(s) changed since the last build"))),
        F.when(F.col(languages) > 0, F.concat(F.col(languages).cast("string"), F.lit(" language(s) not indexed"))),
        F.when(F.col(dynamic) > 0, F.concat(F.col(dynamic).cast("string"), F.lit(" dynamic dispatch pattern(s)"))),
        F.when(F.col(missing) > 0, F.concat(F.col(missing).cast("string"), F.lit(" unit(s) that no test reaches"))),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def recommendation(confidence, age, changed) -> Column:
    low = F.when(F.col(changed) > 0, "update").otherwise("build")
    return F.when(F.col(confidence) < 0.7, low).when(F.col(age) > 24, "consider update").otherwise("fresh")


def state(units: DataFrame, edges: DataFrame, files: DataFrame, changed_files: DataFrame, tracked: list[str], age: float) -> DataFrame:
    """One row: the measures, confidence, caveats and recommendation."""
    changed = units.join(changed_files.select("file"), "file", "left_semi").agg(F.count("*").alias("changed"))
    row = units.agg(F.count("*").alias("total")).crossJoin(changed).crossJoin(unindexed(files, tracked).agg(F.count("*").alias("languages")))
    row = row.crossJoin(dynamic_count(units)).crossJoin(missing_tests(units, edges)).withColumn("age", F.lit(float(age)))  # one row each
    row = row.withColumn("confidence", factors("age", "changed", "total", "languages", "dynamic"))
    return row.withColumn("caveats", caveats("age", "changed", "total", "languages", "dynamic", "missing")).withColumn("recommendation", recommendation("confidence", "age", "changed"))
