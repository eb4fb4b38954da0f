"""Change detection, drift between index and tree, and incremental updates."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_signature
from . import linking


def hash_diff(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """file, status (A, M, D) of two frames of file, hash."""
    both = indexed.select("file", F.col("hash").alias("old")).join(current.select("file", F.col("hash").alias("new")), "file", "full_outer")
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return both.select("file", status.alias("status")).filter("status is not null")


def last_status(changes: DataFrame) -> DataFrame:
    """Of several changes of a file (file, status, ord) the last."""
    return changes.groupBy("file").agg(F.max_by("status", "ord").alias("status"))


def state_hash(hashes: DataFrame) -> DataFrame:
    """One row: the hash of all file hashes in order. The hash is defined over
    the whole list, so one task digests it, as it sorts it: spilled, not held."""
    # A null stands in for an empty list, of which there would be no task.
    mark = hashes.sparkSession.range(1).select(F.lit(None).cast("string").alias("hash"))
    hashes = hashes.select("hash").filter("hash is not null").union(mark).repartition(1).sortWithinPartitions("hash")

    def digest(batches):
        state, first = hashlib.sha256(), True
        for batch in batches:
            for value in batch.column("hash").drop_null():
                state.update((b"" if first else b"\n") + value.as_py().encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["state_hash"])

    return hashes.mapInArrow(digest, "state_hash string")


def unit_drift(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """file, name, drift (added, removed, signature) of units by name."""
    a = indexed.select("file", "name", normal_signature("signature").alias("old"), F.lit(True).alias("was"))
    b = current.select("file", "name", normal_signature("signature").alias("new"), F.lit(True).alias("is"))
    both = a.join(b, ["file", "name"], "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "signature")
    return both.select("file", "name", kind.alias("drift")).filter("drift is not null")


def classify(changes: DataFrame, drift: DataFrame) -> DataFrame:
    """file, status, drift class: structural if a unit has come, gone or
    changed its signature or the file is gone, else minor."""
    n = drift.groupBy("file").agg(F.count("*").alias("n"))
    kind = F.when((F.col("status") == "D") | (F.coalesce("n", F.lit(0)) > 0), "structural").otherwise("minor")
    return changes.join(n, "file", "left").select("file", "status", kind.alias("drift"))


def verdict(classes: DataFrame) -> DataFrame:
    """One row: none, minor or structural."""
    s = F.count_if(F.col("drift") == "structural")
    return classes.agg(F.when(s > 0, "structural").when(F.count("*") > 0, "minor").otherwise("none").alias("drift"))


def name_status(lines: DataFrame) -> DataFrame:
    """file, status, ord of `git diff --name-status` lines (line, ord); a rename
    is a deletion and an addition, a bare path an addition."""
    p = F.split("line", "\t")
    s = F.substring(p[0], 1, 1)
    old, new = F.get(p, F.lit(1)), F.get(p, F.lit(2))

    def change(file, status):
        return F.struct(file.alias("file"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"))

    many = F.when(F.size(p) == 1, F.array(change(p[0], "A"))).when(s.isin("R", "C"), F.array(change(old, "D"), change(new, "A"))).otherwise(F.array(change(old, s)))
    return lines.filter("trim(line) <> ''").select("ord", F.posexplode(many).alias("sub", "c")).select("c.file", "c.status", (F.col("ord") * 2 + F.col("sub")).alias("ord"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with their keys."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def delete_files(units: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """units and edges without those of the files and edges into them."""
    gone = units.join(files.select("file"), "file", "left_semi").select("id")
    kept = units.join(files.select("file"), "file", "left_anti")
    e = edges.join(files.select("file"), "file", "left_anti")
    for end in ("src_id", "dst_id"):
        e = e.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return kept, e.select(edges.columns)


def update(units: DataFrame, captures: DataFrame, changes: DataFrame, new_units: DataFrame, new_captures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units, captures and edges after the changes (file, status): rows of the
    files are replaced and all captures linked again, so that callers in
    unchanged files keep their edges and an update equals a rebuild."""
    files = changes.select("file")
    u = units.join(files, "file", "left_anti").select(units.columns).unionByName(new_units)
    c = captures.join(files, "file", "left_anti").select(captures.columns).unionByName(new_captures)
    return u, c, linking.link(c, u)
