"""Linking anew only what a change can touch.

What a capture links to depends on the units of its own file, and on the first
units of its name: in the first file that has one, and in the next file. So an
update links the captures of the changed files, and in all other files those of
names whose first units are others than before. These names come from the changed
files' units alone, and look-ups by name find their units and captures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import callee_name, import_name
from ..lineage import cut
from . import linking

#: Names up to which a look-up is a filter that reaches the scan.
FILTER = 1000


def with_names(captures: DataFrame) -> DataFrame:
    """captures with called and imported: the names that they are linked by."""
    kind = F.col("capture_name")
    return captures.withColumn("called", F.when(kind.contains("call"), callee_name("text"))).withColumn("imported", F.when(kind.contains("import"), import_name("text")))


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file").distinct(), "file", "left_anti").select(rows.columns)


def of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file").distinct(), "file", "left_semi").select(rows.columns)


def named(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """rows of which a column is one of the names (name); a few names are a
    filter, which Parquet answers by its statistics."""
    few = [r["name"] for r in names.limit(FILTER + 1).collect()]
    if len(few) <= FILTER:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).isin(few), F.lit(False))
        return rows.filter(found)
    keys = F.array_compact(F.array(*columns)) if len(columns) > 1 else F.array(*columns)
    hit = rows.withColumn("__name", F.explode(F.array_distinct(keys))).join(names.select(F.col("name").alias("__name")), "__name", "left_semi")
    return hit.select(rows.columns).distinct()


def touched_names(units: DataFrame, new_units: DataFrame, files: DataFrame) -> DataFrame:
    """name: those whose first units the change moves. units: the old ones."""
    old = of_files(units, files)
    names = cut(old.select("name").union(new_units.select("name")).filter("name is not null").distinct())
    known = cut(named(units, names, "name").select("id", "name", "file", "line_start"))
    after = without_files(known, files).unionByName(new_units.select("id", "name", "file", "line_start"))
    a = linking.registry(known).select("callee", F.struct("one", "two").alias("was"))
    b = linking.registry(after).select("callee", F.struct("one", "two").alias("now"))
    both = a.join(b, "callee", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    return cut(both.select(F.col("callee").alias("name")))


@dataclass(frozen=True)
class Change:
    """files: file, status; names: those touched; captures: those of unchanged
    files that are linked anew; edges: the new ones, with callee."""

    files: DataFrame
    names: DataFrame
    captures: DataFrame
    edges: DataFrame

    def removed(self, edges: DataFrame) -> DataFrame:
        """Those of the edges that stay."""
        kept = without_files(edges, self.files)
        return kept.join(self.names.select(F.col("name").alias("callee")), "callee", "left_anti").select(edges.columns)


def change(units: DataFrame, captures: DataFrame, changes: DataFrame, new_units: DataFrame, new_captures: DataFrame) -> Change:
    """What an update does to the edges: units and captures (with their names)
    as they were, the changed files, and what these hold now."""
    names = touched_names(units, new_units, changes)
    users = cut(without_files(named(captures, names, "called", "imported"), changes))
    todo = users.unionByName(with_names(new_captures))
    wanted = cut(todo.select(F.explode(F.array_compact(F.array("called", "imported"))).alias("name")).distinct())
    # Units of the captures' files hold them; units of their names are what they link to.
    own, stay = users.select("file").distinct(), without_files(units, changes)
    some = of_files(stay, own).unionByName(named(stay, wanted, "name")).distinct().unionByName(new_units)
    return Change(changes, names, users, cut(linking.link_named(todo, cut(some))))


def update(units: DataFrame, captures: DataFrame, edges: DataFrame, changes: DataFrame, new_units: DataFrame, new_captures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units, captures (with names) and edges (with callee) after the changes."""
    done = change(units, captures, changes, new_units, new_captures)
    return (
        without_files(units, changes).unionByName(new_units),
        without_files(captures, changes).unionByName(with_names(new_captures)),
        done.removed(edges).unionByName(done.edges),
    )
