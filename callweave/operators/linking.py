"""Captures and units -> edges. A line that has captures meets the units over it
in bins of lines, once, and a capture the first of its line; names meet in an
equi-join on the callee with the first unit of each name, so no capture meets all
units of its name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import callee_name, import_name
from ..lineage import cut
from ..schema import BOUNDARY, EXTERNAL, EXTERNAL_PREFIX, IMPORT, LOCAL
from .spans import within


def keyed(captures: DataFrame) -> DataFrame:
    return captures.select("capture_name", "text", "file", "line", F.xxhash64("capture_name", "text", "file", "line").alias("cap"))


def _held(captures: DataFrame, units: DataFrame, mode: str) -> DataFrame:
    spans = units.select(F.col("id").alias("uid"), "file", "line_start", "line_end")
    key = F.struct("line_start", "uid")
    pick = F.min_by("uid", key) if mode == "first" else F.max_by("uid", key)
    held = within(captures.select("file", "line").distinct(), spans).groupBy("file", "line").agg(pick.alias("src_id"))
    return captures.join(held, ["file", "line"])


def containing(captures: DataFrame, units: DataFrame, mode: str = "first") -> DataFrame:
    """captures with src_id: the first unit by line and id that holds the line,
    or with mode="innermost" the one that starts last. Equal captures are one."""
    return _held(captures, units, mode).select("cap", "capture_name", "text", "file", "line", "src_id").distinct()


def _calls(captures: DataFrame, units: DataFrame, mode: str) -> DataFrame:
    """src_id, file, callee of each call."""
    calls = captures.filter(F.col("capture_name").contains("call")).select("file", "line", callee_name("text").alias("callee"))
    return _held(calls, units, mode).select("src_id", "file", "callee")


def _named(units: DataFrame) -> DataFrame:
    return units.select(F.col("name").alias("callee"), F.col("file").alias("to_file"), "line_start", F.col("id").alias("to"))


def local_edges(calls: DataFrame, units: DataFrame) -> DataFrame:
    first = _named(units).groupBy(F.col("to_file").alias("file"), "callee").agg(F.min_by("to", F.struct("line_start", "to")).alias("dst_id"))
    found = calls.join(first, ["file", "callee"])
    return found.select("src_id", "dst_id", F.lit(LOCAL).alias("rel_type"), "file", "callee")


def registry(units: DataFrame) -> DataFrame:
    """callee, one, two: of each name the first unit by file, line and id, and
    the first of another file, so that a common name costs two rows."""
    first = F.struct("to_file", "line_start", "to")
    by_file = _named(units).groupBy("callee", "to_file").agg(F.min(first).alias("best"))
    lead = by_file.groupBy("callee").agg(F.min("best").alias("one"))
    next_ = by_file.join(lead, "callee").filter("to_file <> one.to_file").groupBy("callee").agg(F.min("best").alias("two"))
    return lead.join(next_, "callee", "left")


def external_edges(calls: DataFrame, units: DataFrame) -> DataFrame:
    """The first of other files by file, line and id."""
    to = F.when(F.col("one.to_file") != F.col("file"), F.col("one.to")).otherwise(F.col("two.to"))
    found = calls.join(registry(units), "callee").withColumn("dst_id", to).filter("dst_id is not null")
    return found.select("src_id", "dst_id", F.lit(EXTERNAL).alias("rel_type"), "file", "callee")


def boundary_edges(calls: DataFrame, units: DataFrame) -> DataFrame:
    """Calls of names that no unit has."""
    found = calls.join(units.select(F.col("name").alias("callee")).distinct(), "callee", "left_anti")
    return found.select("src_id", F.concat(F.lit(EXTERNAL_PREFIX), F.col("callee")).alias("dst_id"), F.lit(BOUNDARY).alias("rel_type"), "file", "callee")


def import_edges(captures: DataFrame, units: DataFrame) -> DataFrame:
    """From a file's module unit to the imported name's unit in another file."""
    modules = units.filter("type = 'module'").groupBy("file").agg(F.min_by("id", F.struct("line_start", "id")).alias("src_id"))
    imports = keyed(captures).filter(F.col("capture_name").contains("import")).withColumn("callee", import_name("text")).filter("callee is not null").join(modules, "file")
    return external_edges(imports, units).withColumn("rel_type", F.lit(IMPORT))


def link(captures: DataFrame, units: DataFrame, mode: str = "first") -> DataFrame:
    """All edges; of equal ones (src, dst, kind) that of the first file stays."""
    return link_named(captures, units, mode).drop("callee")


def link_named(captures: DataFrame, units: DataFrame, mode: str = "first") -> DataFrame:
    """link, with the name by which an edge was found."""
    # Three kinds of edges read the calls.
    calls = cut(_calls(captures, units, mode))
    every = local_edges(calls, units).unionByName(external_edges(calls, units)).unionByName(boundary_edges(calls, units)).unionByName(import_edges(captures, units))
    return every.groupBy("src_id", "dst_id", "rel_type").agg(F.min("file").alias("file"), F.min("callee").alias("callee"))


def dedupe_units(units: DataFrame) -> DataFrame:
    """Of a file's units with one id the first by line."""
    rest = [c for c in units.columns if c not in ("file", "id")]
    best = units.groupBy("file", "id").agg(F.min(F.struct("line_start", *[c for c in rest if c != "line_start"])).alias("u"))
    return best.select(*[F.col(c) if c in ("file", "id") else F.col(f"u.{c}").alias(c) for c in units.columns])
