"""Lines within spans of lines of the same file, as an equi-join.

A span belongs to a level by its length, and lies in at most two bins of that
level; a line lies in one bin of each level that has spans: the bins of a level without
any would only gather all lines of a long file. So a file's lines meet the spans
near them, not all spans of the file, however long some spans are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bin, by level; what is longer than the last takes several bins.
WIDTHS = tuple(32 * 16**k for k in range(6))


def _width(length: Column) -> Column:
    out = F
    for w in WIDTHS[:-1]:
        out = out.when(length <= w, w)
    return out.otherwise(WIDTHS[-1])


def within(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """lines (file, line and more) with the spans (file, line_start, line_end
    and more) that hold them, ends included. Nulls are in no span."""
    start, end = F.col("line_start").cast("long"), F.col("line_end").cast("long")
    width = _width(end - start + 1).cast("long")
    bins = F.explode(F.sequence(F.floor(start / F.col("__width")), F.floor(end / F.col("__width"))))
    held = spans.filter("line_start <= line_end").withColumn("__width", width).withColumn("__bin", bins)
    levels = [r[0] for r in held.select("__width").distinct().collect()] or WIDTHS[:1]  # six at most
    every = F.explode(F.array(*(F.struct(F.lit(w).cast("long").alias("__width"), F.floor(F.col("line").cast("long") / w).alias("__bin")) for w in levels)))
    at = lines.withColumn("__at", every).select(*lines.columns, "__at.__width", "__at.__bin")
    return at.join(held, ["file", "__width", "__bin"]).filter("line between line_start and line_end").drop("__width", "__bin")
