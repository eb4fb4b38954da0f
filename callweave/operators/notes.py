"""Notes on units and areas: listing, recall, decay and ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import decay, decay_status
from ..schema import HALF_LIFE
from . import vectors
from .graph import note_ancestry

__all__ = ["list_notes", "recall", "recompute_decay", "stale_count", "attach", "anchor", "note_ancestry", "from_report", "from_package", "upsert_edges", "without"]


def list_notes(notes: DataFrame, unit: str | None = None, area: str | None = None, type_: str | None = None, include_stale: bool = False, limit: int | None = None) -> DataFrame:
    out = notes
    for name, value in (("unit_id", unit), ("area", area), ("type", type_)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    out = out if include_stale else out.filter("status <> 'stale'")
    out = out.orderBy(F.desc("created_ts"), "id")
    return out.limit(limit) if limit else out


def recall(notes: DataFrame, note_vectors: DataFrame, query: list[float], limit: int = 10, area: str | None = None, include_stale: bool = False) -> DataFrame:
    """The nearest notes of those that pass the filters; filters come first,
    so the result is full whenever enough notes pass."""
    kept = notes if include_stale else notes.filter("status <> 'stale'")
    kept = kept if area is None else kept.filter(F.col("area") == area)
    own = note_vectors.join(kept.select("id"), "id", "left_semi")
    return vectors.knn(own, query, limit, metric="cosine").join(kept, "id").orderBy("distance", "id")


def recompute_decay(notes: DataFrame, now: int, changed: DataFrame | None = None, half_life: float = HALF_LIFE, penalty: float = 0.3, stale: float = 0.1, possibly: float = 0.3) -> DataFrame:
    """notes with new decay_score and status. changed: id of changed units."""
    mark = notes.withColumn("__changed", F.lit(False))
    if changed is not None:
        mark = notes.join(changed.select(F.col("id").alias("unit_id"), F.lit(True).alias("__changed")).distinct(), "unit_id", "left")
    score = decay((F.lit(now) - F.col("created_ts")) / 86400.0, F.coalesce("__changed", F.lit(False)), half_life, penalty)
    return mark.withColumn("decay_score", score).withColumn("status", decay_status("decay_score", stale, possibly)).select(notes.columns)


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many notes a recomputation has changed."""
    a = after.select("id", F.col("decay_score").alias("score"), F.col("status").alias("now"))
    return before.join(a, "id").agg(F.count_if(~F.col("decay_score").eqNullSafe(F.col("score")) | ~F.col("status").eqNullSafe(F.col("now"))).alias("changed"))


def stale_count(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count_if(F.col("status") == "stale").alias("stale"))


def attach(units: DataFrame, notes: DataFrame) -> DataFrame:
    """units with their notes, newest first; a unit's notes are few."""
    own = notes.filter("unit_id is not null").groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("created_ts", "id", "type", "title")), asc=False).alias("notes"))
    return units.join(own.withColumnRenamed("unit_id", "id"), "id", "left")


def anchor(units: DataFrame, name: str) -> DataFrame:
    """The first unit of that name or id ending, with the number of such."""
    found = units.filter((F.col("name") == name) | F.col("id").endswith("::" + name))
    return found.orderBy("file", "line_start", "id").limit(1).crossJoin(found.agg(F.count("*").alias("matches")))  # one row each


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Notes, their vectors or edges without those of the given notes (id)."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(rows.columns)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Note edges with new ones in place of those of the same ends and kind."""
    key = ["from_id", "to_id", "rel_type"]
    latest = new.groupBy(key).agg(F.max(F.struct("created_ts", "author")).alias("e")).select(*key, "e.created_ts", "e.author")
    return edges.join(latest.select(key), key, "left_anti").select(edges.columns).unionByName(latest.select(edges.columns))


def dangling(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Edges of which an end is no note."""
    ends = edges.select("from_id", "to_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.join(notes.select("id"), "id", "left_anti").select("from_id", "to_id").distinct()


def from_package(direct: DataFrame, exposed: DataFrame, package: str, now: int) -> DataFrame:
    """A warning for each direct caller of a package (id, dst; and what exposure
    tells of it: id, entry, level)."""
    rows = direct.join(exposed.select("id", "entry", "level"), "id")
    open_ = F.when(F.col("entry") == F.col("id"), "An entry: input from outside reaches this call.").otherwise("Called from inside; follow its callers to the entries.")
    body = F.concat(F.format_string(f"Calls %s of {package}. ", F.col("dst")), open_)
    key = F.sha2(F.concat_ws("|", F.lit("vuln"), F.lit(package), F.col("id"), F.lit(now).cast("string")), 256)
    return rows.select(key.alias("id"), F.col("id").alias("unit_id"), F.substring_index(F.substring_index("id", "::", 1), "/", 1).alias("area"), F.lit("warning").alias("type"), F.lit(f"Calls {package}: look for advisories before a change").alias("title"), body.alias("body"), F.lit("agent:vuln").alias("author"), F.lit(now).cast("long").alias("created_ts"), F.array(F.lit("security"), F.lit("vuln"), F.lit(package)).alias("tags"), F.lit(1.0).alias("decay_score"), F.lit("active").alias("status"))


def from_report(report: DataFrame, kind: str, score: str, now: int) -> DataFrame:
    """Notes for the high and critical rows of a report."""
    rows = report.filter(F.col("label").isin("HIGH", "CRITICAL"))
    title = F.format_string(f"{kind}: %s", F.col("id"))
    body = F.format_string(f"{kind} score %s, %s", F.col(score).cast("string"), F.col("label"))
    key = F.sha2(F.concat_ws("|", F.lit(kind), F.col("id"), F.lit(now).cast("string")), 256)
    return rows.select(key.alias("id"), F.col("id").alias("unit_id"), "area", F.lit("warning").alias("type"), title.alias("title"), body.alias("body"), F.lit(None).cast("string").alias("author"), F.lit(now).cast("long").alias("created_ts"), F.array(F.lit(kind)).alias("tags"), F.lit(1.0).alias("decay_score"), F.lit("active").alias("status"))


def to_markdown(notes: DataFrame) -> DataFrame:
    """A block of text for each note."""
    return notes.select("id", F.format_string("### %s\n\n%s\n\n- type: %s\n- tags: %s\n", F.col("title"), F.col("body"), F.col("type"), F.array_join("tags", ", ")).alias("text"))
