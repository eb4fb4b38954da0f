"""Listing and reading of file trees by tasks: neither paths nor contents come to
the driver.

A folder is a row. A task lists its folders and the folders below, STEP at most;
what it hasn't come to are rows of the next round, dealt out anew. So a small tree
is one round, and a large one is spread over all tasks after the first few. A
folder that the ignore rules leave out is not descended into. Links to folders are
not followed, as they can lead upwards; links to files are read."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

#: Folders that a task lists in a round.
STEP = 256
#: Rows and bytes of a batch of contents.
ROWS, BYTES = 256, 8 << 20
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20

ENTRIES = "kind string, path string, size long"


def uri(root: str) -> str:
    """A root with its scheme; without one it is a path of this machine."""
    return root if re.match(r"^[a-z][a-z0-9+.-]*:", root) else f"file://{root}"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root, and the root's path there."""
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", _quoted(uri(root))))
    return fs, path.rstrip("/")


def _quoted(name: str) -> str:
    from urllib.parse import quote

    return quote(name, safe=":/@?=&+,;~!$'()*%") if "%" not in name else name


def descends(patterns) -> list[tuple[bool, re.Pattern]]:
    """The rules of ignore lines as (let in, regex), in order."""
    from .files import ignore_regex

    out = []
    for p in (p.strip() for p in patterns):
        keep = p.startswith("!")
        rx = ignore_regex(p[1:] if keep else p)
        if rx:
            out.append((keep, re.compile(rx)))
    return out


def pruned(folder: str, rules: list[tuple[bool, re.Pattern]]) -> bool:
    """Whether nothing below a folder can stay: a rule leaves all of it out, and
    no later rule lets anything in."""
    for keep, rx in reversed(rules):
        if keep:
            return False
        if rx.search(folder + "/"):
            return True
    return False


def _entries(fs: pafs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, str, int]]:
    local = isinstance(fs, pafs.LocalFileSystem)
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base or "/")):
        name = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == pafs.FileType.Directory:
            if not (local and _linked(info.path)):
                yield "folder", name, 0
        elif info.type == pafs.FileType.File:
            yield "file", name, info.size


def _linked(path: str) -> bool:
    import os

    return os.path.islink(path)


def _walk(root: str, patterns: tuple[str, ...], step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        rules = descends(patterns)
        todo = deque(p for b in batches for p in b.column("path").to_pylist())
        rows: list[tuple] = []
        for _ in range(step):
            if not todo:
                break
            for kind, path, size in _entries(fs, base, todo.popleft()):
                if kind == "file":
                    rows.append((kind, path, size))
                elif not pruned(path, rules):
                    todo.append(path)
            if len(rows) >= 8192:
                yield _batch(rows)
                rows = []
        yield _batch(rows + [("folder", path, 0) for path in todo])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, paths, sizes = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(kinds, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["kind", "path", "size"])


def list_tree(spark: SparkSession, root: str, patterns=(), step: int = STEP) -> DataFrame:
    """file (relative), size of the regular files under root, hidden ones too,
    without the folders that patterns leave out; files that they name are still
    there. A root that isn't there is an error."""
    width = max(2, spark.sparkContext.defaultParallelism)
    found, todo = [], spark.createDataFrame([("",)], "path string").coalesce(1)
    while todo is not None:
        entries = cut(todo.mapInArrow(_walk(root, tuple(patterns), step), ENTRIES))
        found.append(entries.filter("kind = 'file'").select(F.col("path").alias("file"), "size"))
        left = entries.filter("kind = 'folder'").select("path")
        todo = None if left.isEmpty() else left.repartition(width, "path")
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def _contents(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        names, texts, held = [], [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{base}/{file}") as source:
                    content = source.read()
                if names and (held + len(content) > BYTES or len(names) >= ROWS):
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["file", "content"])
                    names, texts, held = [], [], 0
                names.append(file)
                texts.append(content)
                held += len(content)
        if names:
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["file", "content"])

    return run


def read_files(root: str, listed: DataFrame) -> DataFrame:
    """file, content (bytes) of listed files (file, size), in as many tasks as
    their bytes need. A file that is gone since is an error."""
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    tasks = max(1, min(total["n"], max(listed.sparkSession.sparkContext.defaultParallelism, -(-total["b"] // TASK_BYTES))))
    return listed.select("file").repartition(tasks, "file").mapInArrow(_contents(root), "file string, content binary")
