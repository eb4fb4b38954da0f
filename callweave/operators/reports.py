"""Reports on every unit at once: change risk, impact, silos, coverage gaps,
exposure to a package, and their order of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, text
from ..lineage import cut
from ..schema import BOUNDARY, EXTERNAL_PREFIX
from . import areas, graph
from .closures import Closures
from .spans import within


def depth_counts(closure: DataFrame) -> DataFrame:
    """target, direct, indirect, callers."""
    return closure.groupBy("target").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") == 2).alias("indirect"), F.count("*").alias("callers"))


def closure_risk(units: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Of each target (all units, if none are given): callers at one and two
    steps, areas, tests, risk and its label."""
    targets = units if targets is None else targets
    found = Closures(units, edges, targets)
    out = targets.select(F.col("id").alias("target")).join(found.counts(), "target", "left").join(found.spread(), "target", "left").join(found.tests(), "target", "left")
    out = out.na.fill(0, ["direct", "indirect", "callers", "tests"]).crossJoin(areas.total(units))  # one row
    ratio = F.col("tests") / F.greatest(F.col("direct"), F.lit(1))
    out = out.withColumn("risk", scores.risk("direct", "indirect", "spread", "total_areas", ratio))
    return out.select("target", "direct", "indirect", "spread", "tests", "risk", scores.risk_label("risk").alias("label"))


def units_of_files(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units of changed files (file), modules left out: targets of the reports."""
    return units.filter("type <> 'module'").join(files.select("file").distinct(), "file", "left_semi").select(units.columns)


def risk_rollup(units: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: distinct callers of all targets, and the highest label."""
    rank = F.when(F.col("label") == "HIGH", 3).when(F.col("label") == "MEDIUM", 2).otherwise(1)
    label = closure_risk(units, edges, targets).agg(F.max_by("label", rank).alias("label"))
    return graph.callers(units, edges, 2, targets).agg(F.count_distinct("caller").alias("affected")).crossJoin(label)  # one row each


def resolve(units: DataFrame, target: str) -> DataFrame:
    """The unit that `file::name`, `file:line` or a name means, in this order;
    of several, the first by file, line and id."""
    plain = units.filter("type <> 'module'")
    found = plain.filter(F.col("name") == target).withColumn("tag", F.lit(3))
    if "::" in target:
        file, name = target.split("::", 1)
        found = found.union(units.filter((F.col("file") == file) & (F.col("name") == name)).withColumn("tag", F.lit(1)))
    elif target.rpartition(":")[2].isdigit() and ":" in target:
        file, _, line = target.rpartition(":")
        inside = (F.col("file") == file) & (F.col("line_start") <= int(line)) & (F.col("line_end") >= int(line))
        found = found.union(plain.filter(inside).withColumn("tag", F.lit(2)))
    return found.orderBy("tag", "file", "line_start", "id").limit(1).drop("tag")


def impact(units: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """target, caller, depth (all depths), and the caller's file, area, lines."""
    closure = graph.callers(units, edges, depth, targets)
    place = units.select(F.col("id").alias("caller"), "name", "file", areas.head_or_root("file").alias("area"), text.loc("line_start", "line_end").alias("loc"))
    return closure.join(place, "caller").select("target", "caller", "depth", "name", "file", "area", "loc")


def impact_summary(units: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    closure = cut(graph.callers(units, edges, depth, targets))
    rows = targets.select(F.col("id").alias("target"), text.loc("line_start", "line_end").alias("loc"))
    n = closure.groupBy("target").agg(F.count("*").alias("callers"))
    tests = graph.covering_tests(units, edges, closure, targets).groupBy("target").agg(F.count("*").alias("tests"))
    out = rows.join(n, "target", "left").join(graph.area_spread(units, closure, targets), "target", "left").join(tests, "target", "left").na.fill(0, ["callers", "tests"])
    return out.select("target", "loc", "callers", "spread", "tests", scores.complexity("spread", "callers").alias("complexity"))


def ownership(units: DataFrame, line_authors: DataFrame) -> DataFrame:
    """id, authors, primary_author (most lines; of equals the one seen first),
    share. line_authors: file, line, author. Without lines: unknown, 1.0."""
    own = within(line_authors, units.select("id", "file", "line_start", "line_end"))
    by = own.groupBy("id", "author").agg(F.count("*").alias("lines"), F.min("line").alias("first"))
    best = by.groupBy("id").agg(F.count("*").alias("authors"), F.max_by("author", F.struct("lines", -F.col("first"), "author")).alias("primary_author"), (F.max("lines") / F.sum("lines")).alias("share"))
    out = units.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("authors", F.lit(1)).cast("long").alias("authors"), F.coalesce("primary_author", F.lit("unknown")).alias("primary_author"), F.coalesce("share", F.lit(1.0)).alias("share"))


def silos(units: DataFrame, edges: DataFrame, line_authors: DataFrame, min_callers: int = 1) -> DataFrame:
    """Callers per author of every unit, modules and tests too."""
    rows = units.filter("file <> '' and line_start > 0")
    n = Closures(units, edges).counts().select(F.col("target").alias("id"), "callers")
    out = rows.join(n, "id", "left").na.fill(0, ["callers"]).filter(F.col("callers") >= min_callers).join(ownership(units, line_authors), "id")
    score = F.col("callers") / F.greatest(F.col("authors"), F.lit(1))
    return out.select("id", areas.head_or_root("file").alias("area"), "authors", "primary_author", "callers", score.alias("silo_score"), scores.silo_label(score).alias("label"))


def top(report: DataFrame, score: str, n: int, area: str | None = None, author: str | None = None, label: str | None = None) -> DataFrame:
    """Filters of the reports, then the n highest; ties by id."""
    if area:
        report = report.filter(areas.contains("area", area))
    if author:
        report = report.filter(areas.contains("primary_author", author))
    if label:
        report = report.filter(F.col("label") == label.upper())
    return report.orderBy(F.desc(score), "id").limit(n)


def file_velocity(commits: DataFrame, now, days: int = 30) -> DataFrame:
    """file, velocity: commits of the last days. commits: file, ts."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return commits.filter(F.col("ts") >= since).groupBy("file").agg(F.count("*").alias("velocity"))


def covered_by_lines(units: DataFrame, lines: DataFrame) -> DataFrame:
    """id of units over a covered line (file, line)."""
    spans = units.select("id", "file", "line_start", "line_end")
    return within(lines.select("file", "line").distinct(), spans).select("id").distinct()


def covered_by_graph(units: DataFrame, edges: DataFrame) -> DataFrame:
    """id of what a unit under tests/ has an edge to."""
    return graph.test_edges(units, edges).select("id").distinct()


def coverage_gaps(units: DataFrame, edges: DataFrame, covered: DataFrame, velocity: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Uncovered units by risk times the file's commits."""
    rows = units.filter("type <> 'module'").filter(~text.in_tests("file"))
    total = rows.agg(F.greatest(F.count_distinct(areas.head("file")), F.lit(1)).alias("total_areas"))
    open_ = rows.join(covered.select("id"), "id", "left_anti").filter("file <> '' and line_start > 0")
    closure = Closures(units, edges, open_)
    n = closure.counts().withColumnRenamed("target", "id")
    spread = closure.spread().withColumnRenamed("target", "id")
    out = open_.join(n, "id", "left").join(spread, "id", "left").join(velocity, "file", "left").na.fill(0, ["direct", "indirect", "callers", "velocity"])
    out = out.filter(F.col("direct") + 0.4 * F.col("indirect") >= min_weight).crossJoin(total)  # one row
    score = scores.risk("direct", "indirect", "spread", "total_areas", F.lit(0.0)) * F.col("velocity")
    return out.select("id", areas.head("file").alias("area"), "callers", "velocity", score.alias("gap_score"), scores.gap_label(score).alias("label"))


def package_callers(units: DataFrame, edges: DataFrame, package: str) -> DataFrame:
    """id, dst: units with a boundary edge to the package or a name in it."""
    exact = EXTERNAL_PREFIX + package
    b = edges.filter((F.col("rel_type") == BOUNDARY) & ((F.lower("dst_id") == exact.lower()) | F.lower("dst_id").startswith(exact.lower() + ".")))
    return b.groupBy(F.col("src_id").alias("id")).agg(F.min("dst_id").alias("dst")).join(units.select("id"), "id", "left_semi")


def exposure(units: DataFrame, edges: DataFrame, direct: DataFrame, depth: int = 5) -> DataFrame:
    """id, entry, score, level of each direct caller: tests are low; what
    nothing calls is critical itself; else the nearest untested entry is."""
    rows = units.join(direct.select("id"), "id", "left_semi").select("id", "file")
    test = F.substring_index("file", "/", 1) == "tests"
    entry = graph.trust_boundaries(units, edges)
    own = entry.select("id", F.lit(True).alias("open"))
    above = graph.callers(units, edges, depth, rows.filter(~test))
    above = above.join(entry.filter(~test).select(F.col("id").alias("caller")), "caller", "left_semi").groupBy(F.col("target").alias("id")).agg(F.min_by("caller", F.struct("depth", "caller")).alias("ancestor"))
    out = rows.join(own, "id", "left").join(above, "id", "left")
    score = F.when(test, 0.1).when(F.col("open"), 1.0).when(F.col("ancestor").isNotNull(), 0.6).otherwise(0.1)
    who = F.when(test, None).when(F.col("open"), F.col("id")).otherwise(F.col("ancestor"))
    return out.select("id", who.alias("entry"), score.alias("score"), F.when(score > 0.1, "critical").otherwise("low").alias("level"))


def remediation(exposed: DataFrame, package: str, pinned: str | None = None) -> DataFrame:
    """step, action, id, score: critical ones by score, low ones, then the pin.
    A list for one package's callers."""
    pin = exposed.sparkSession.createDataFrame([(3, None, 0.0)], "kind int, id string, score double")
    rows = exposed.select(F.when(F.col("level") == "critical", 1).otherwise(2).alias("kind"), F.coalesce("entry", "id").alias("id"), "score").union(pin)
    step = F.row_number().over(W.orderBy("kind", F.desc("score"), "id"))
    hint = f"pin {package} " + (">= <safe_version>" if pinned is None else f"> {pinned}")
    return rows.select(step.cast("long").alias("step"), F.when(F.col("kind") == 1, "patch").when(F.col("kind") == 2, "review").otherwise(hint).alias("action"), "id", "score")


def upstream_count(units: DataFrame, edges: DataFrame, direct: DataFrame, depth: int = 5) -> DataFrame:
    """One row: distinct units above the callers that are neither tests nor entries."""
    test = F.substring_index("file", "/", 1) == "tests"
    inner = units.filter(~test).join(direct.select("id"), "id", "left_semi").join(graph.trust_boundaries(units, edges).select("id"), "id", "left_anti")
    return graph.callers(units, edges, depth, inner).agg(F.count_distinct("caller").alias("upstream"))


def refactor_sequence(units: DataFrame, edges: DataFrame, target: DataFrame, depth: int = 2) -> DataFrame:
    """step, file, ids: the files of one target's callers in the order of work,
    then the target's own. What calls nothing else among the callers comes
    first, then what only calls that, by graph.layers; callers on a cycle and
    above it come last. A file is worked on where its first caller stands; ties
    by name. No target gives no step."""
    goal = cut(target.select("id").distinct())
    ids = cut(graph.with_target(graph.callers(units, edges, depth, goal), goal).select("id").distinct())
    own = units.join(ids, "id", "left_semi").select("id", "file")
    inner = graph.adjacency(units, edges)
    inner = inner.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    inner = inner.join(goal.withColumnRenamed("id", "src_id"), "src_id", "left_anti")  # the target's own calls don't count
    callers = own.join(goal, "id", "left_anti").join(graph.layers(ids, inner), "id")
    by_file = callers.groupBy("file").agg(F.min("layer").alias("layer"), F.array_sort(F.collect_set("id")).alias("ids"))
    last = own.join(goal, "id", "left_semi").groupBy("file").agg(F.lit(None).cast("long").alias("layer"), F.array_sort(F.collect_set("id")).alias("ids"))
    every = by_file.withColumn("last", F.lit(0)).unionByName(last.withColumn("last", F.lit(1)))
    # A row a file of one target's callers.
    step = F.row_number().over(W.orderBy("last", "layer", "file"))
    return every.select(step.cast("long").alias("step"), "file", "ids")
