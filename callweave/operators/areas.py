"""File -> area, in the variants that the reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..schema import UNKNOWN


def head(file) -> Column:
    """First path component; a file at the top is its own area."""
    return F.substring_index(col(file), "/", 1)


def head_or(file, other: str) -> Column:
    """First path component; `other` for a file at the top."""
    return F.when(F.instr(col(file), "/") > 0, head(file)).otherwise(other)


def head_or_root(file) -> Column:
    return F.coalesce(F.nullif(head(file), F.lit("")), F.lit("root"))


def total(units: DataFrame) -> DataFrame:
    """One row: the number of heads of all units but modules, 1 at least."""
    return units.filter("type <> 'module'").agg(F.greatest(F.count_distinct(head("file")), F.lit(1)).alias("total_areas"))


def configured(areas) -> list[tuple[str, str]]:
    """(name, path) in order; areas are a bounded configuration."""
    return list(areas.items()) if isinstance(areas, dict) else [tuple(a) for a in areas]


def first_prefix(file, areas, unknown: str | None = UNKNOWN) -> Column:
    """The first configured area that holds the file; `.` never does."""
    out = F
    for name, path in configured(areas):
        p = path.rstrip("/")
        out = out.when((col(file) == p) | col(file).startswith(p + "/"), name)
    return F.lit(unknown) if out is F else out.otherwise(F.lit(unknown))


def relative(file, areas) -> Column:
    """The first area whose folder holds the file, `.` holding all; else null."""
    out = F
    for name, path in configured(areas):
        p = path.rstrip("/")
        out = out.when(F.lit(p in (".", "")) | col(file).startswith(p + "/"), name)
    return F.lit(None).cast("string") if out is F else out


def longest_prefix(file, areas, unknown: str = "unknown") -> Column:
    """The longest plain string prefix; the first of equals."""
    out = F
    for name, path in sorted(configured(areas), key=lambda a: -len(a[1])):
        out = out.when(col(file).startswith(path), name)
    return F.lit(unknown) if out is F else out.otherwise(unknown)


def like_prefix(units: DataFrame, areas: DataFrame) -> DataFrame:
    """units of every area (name, path) whose path they are under, whatever the
    case; `.` holds all. An area table is a configuration, checked as such."""
    small = areas.select(F.col("name").alias("area"), F.lower(F.rtrim(F.col("path"), F.lit("/"))).alias("path"))
    under = (F.col("path") == ".") | F.startswith(F.lower("file"), F.concat("path", F.lit("/")))
    return units.join(small, under)


def contains(file, part: str) -> Column:
    return F.lower(col(file)).contains(part.lower())
