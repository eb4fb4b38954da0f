"""Cobertura coverage files and dependency manifests."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPENDENCIES = "file string, kind int, ord int, name string, spec string"

_SCHEMA = "_filename string, lines struct<line:array<struct<_number:int,_hits:long>>>"


def covered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line of the lines with hits, through Spark's XML reader."""
    rows = spark.read.format("xml").option("rowTag", "class").schema(_SCHEMA).load(path)
    rows = rows.select(F.translate("_filename", "\\", "/").alias("file"), F.explode("lines.line").alias("l"))
    return rows.filter("l._hits > 0").select("file", F.col("l._number").alias("line")).distinct()


def _entries(file: str, content: str):
    """(kind, name, what is asked of it) of a manifest, in order: the project's own
    list (0), Poetry's tables (1), then lines of requirements (2)."""
    if file.rsplit("/", 1)[-1] != "pyproject.toml":
        lines = (x.strip() for x in content.splitlines())
        yield from ((2, *_split(x)) for x in lines if x and not x.startswith(("#", "-")))
        return
    try:
        doc = tomllib.loads(content)
    except (tomllib.TOMLDecodeError, RecursionError):
        return
    table = lambda at, *keys: table(at.get(keys[0], {}) if isinstance(at, dict) else {}, *keys[1:]) if keys else at
    listed, poetry = table(doc, "project", "dependencies"), table(doc, "tool", "poetry", "dependencies")
    yield from ((0, *_split(x)) for x in (listed if isinstance(listed, list) else ()) if isinstance(x, str))
    for name, spec in (poetry if isinstance(poetry, dict) else {}).items():
        yield 1, name, str(spec.get("version", "")) if isinstance(spec, dict) else str(spec)


def _split(entry: str) -> tuple[str, str]:
    name = re.match(r"[\w.\-]*", entry.strip())[0]
    return name, entry.strip()[len(name) :].strip()


def dependencies(manifests: DataFrame) -> DataFrame:
    """file, kind, ord, name, spec of all that manifests (file, content) ask for.
    A file that is no TOML asks for nothing."""

    def run(batches):
        for pdf in batches:
            rows = [(f, kind, k, name, spec) for f, c in zip(pdf["file"], pdf["content"]) for k, (kind, name, spec) in enumerate(_entries(f, c or "")) if name]
            yield pd.DataFrame(rows, columns=["file", "kind", "ord", "name", "spec"])

    return manifests.select("file", "content").mapInPandas(run, DEPENDENCIES)


def pinned(found: DataFrame, package: str) -> DataFrame:
    """name, spec, version: the first of the dependencies that is the package,
    dashes, dots and underscores being one; the project's list before Poetry's
    tables before requirements. version: the first number in spec, or null."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_.]+", "-")
    own = found.filter(plain(F.col("name")) == plain(F.lit(package))).orderBy("kind", "file", "ord").limit(1)
    return own.select("name", "spec", F.nullif(F.regexp_extract("spec", r"(\d[^,;\"'\s\]]*)", 1), F.lit("")).alias("version"))


def pinned_version(manifest: DataFrame, package: str) -> DataFrame:
    """ord, version: the first line of a manifest (line, ord) that names the
    package itself, dashes and underscores being one."""
    name = re.escape(package.lower().replace("_", "-"))
    line = F.lower(F.translate(F.regexp_replace("line", r"""^[\s"'\-]+|["',\s]+$""", ""), "_", "-"))
    rx = rf"^{name}(?:\[[^\]]*\])?\s*(?:[=~><!^]+|\s*=\s*[\"']?[=~><!^]*)\s*([0-9][^,;\"'\s]*)"
    return manifest.filter(line.rlike(rf"^{name}(?:[\s><=!;@~\[]|$)")).select("ord", F.nullif(F.regexp_extract(line, rx, 1), F.lit("")).alias("version")).orderBy("ord").limit(1)
