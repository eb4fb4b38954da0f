"""Exports: Markdown and JSON as frames of text, one row a document or line,
so that they are written by executors; and the steps of a migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import summary
from .operators import areas as area_rules
from .operators import graph


def area_documents(units: DataFrame, edges: DataFrame, areas: DataFrame) -> DataFrame:
    """area, text: a table of each area's units (areas: name, path) with the
    calls into and out of them. A document holds one area's units."""
    n = graph.multi_degrees(edges)
    rows = area_rules.like_prefix(units, areas).join(n, "id", "left").na.fill(0, ["calls_in", "calls_out"])
    cell = F.replace(F.replace(summary("docstring", "signature", 80), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.format_string("| %s | %s | %s | %d | %d | %s |", "name", "type", "file", "calls_in", "calls_out", cell)
    body = F.array_sort(F.collect_list(F.struct("file", "line_start", "name", line.alias("line"))))
    head = F.concat(F.lit("# "), F.col("area"), F.lit("\n\n| unit | type | file | in | out | summary |\n|---|---|---|---|---|---|\n"))
    return rows.groupBy("area").agg(body.alias("rows")).select("area", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


def area_map(units: DataFrame, areas: DataFrame, state_hash: str) -> DataFrame:
    """One row of text: units by area, and the state the map is of."""
    n = area_rules.like_prefix(units, areas).groupBy("area").agg(F.count("*").alias("n"))
    rows = n.agg(F.array_sort(F.collect_list(F.struct("area", "n"))).alias("rows"))  # a row an area
    line = F.transform("rows", lambda r: F.format_string("| %s | %d |", r["area"], r["n"]))
    return rows.select(F.concat(F.lit(f"state: {state_hash}\n\n| area | units |\n|---|---|\n"), F.array_join(line, "\n")).alias("text"))


def map_is_current(text: str, state_hash: str) -> bool:
    """Whether a map that was pulled is of this state."""
    return text.split("\n", 1)[0].removeprefix("state:").strip() == state_hash


def as_json(rows: DataFrame, *extra: str) -> DataFrame:
    """Each row as JSON, with constant fields (name=value) in it."""
    more = [F.lit(v).alias(k) for k, _, v in (x.partition("=") for x in extra)]
    return rows.select(F.to_json(F.struct(*rows.columns, *more)).alias("json"))


def context_markdown(filled: DataFrame) -> DataFrame:
    """A line of Markdown for each unit of a filled context."""
    return filled.filter("tier is not null").select("ord", F.format_string("- `%s` (%s, %d tokens)", "id", "tier", "tokens").alias("line"))


def health_table(snapshots: DataFrame, names: list[str]) -> DataFrame:
    """A line of a table for each snapshot, with the given metrics to four
    places, in the order of the builds."""
    cells = [F.coalesce(F.when(F.col(n).isNotNull(), F.format_string("%.4f", F.col(n).cast("double"))), F.lit("-")) for n in names]
    return snapshots.select("build_ts", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("build_ts").cast("string"), *cells), F.lit(" |")).alias("line")).orderBy("build_ts")


def exit_code(verdict: DataFrame) -> int:
    """Of validate: 1 if the drift (one row) is structural, else 0."""
    return int(verdict.first()["drift"] == "structural")


def risk_comment(report: DataFrame, top: int = 20) -> DataFrame:
    """The lines of a review comment on the riskiest targets."""
    line = F.format_string("| %s | %s | %.2f | %d | %d |", "target", "label", "risk", "direct", "tests")
    return report.orderBy(F.desc("risk"), "target").limit(top).select("target", line.alias("line"))


def find_units(units: DataFrame, name: str | None = None, file: str | None = None, line: int | None = None, limit: int = 5) -> DataFrame:
    """Units of a name, or of files that hold a text, at a line; the first few."""
    if name is not None:
        found = units.filter(F.col("name") == name)
    else:
        found = units.filter(area_rules.contains("file", file or ""))
        found = found if line is None else found.filter(F.lit(line).between(F.col("line_start"), F.col("line_end")))
    return found.orderBy("file", "line_start", "id").limit(limit)


def migration_steps(found: int, wanted: int, known: list[int]) -> list[int]:
    """Versions to pass on the way, each by its own script."""
    if found > wanted:
        raise ValueError(f"version {found} is newer than {wanted}")
    missing = [v for v in range(found, wanted) if v not in known]
    if missing:
        raise ValueError(f"no step from version {missing[0]}")
    return list(range(found, wanted))
