"""The registered queries of the code-graph operators, each with the SQL that
DuckDB answers in the same way, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import areas, confidence, context, drift, graph, health, intent, linking, notes, onboarding, reports, vectors, viz
from ..sources import files as file_source
from ..streaming import velocity
from .fixtures import AREAS, SQL, edges, table, units

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"
NOW_S = 1706659200
G = SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def graph_of(spark, sf):
    return units(spark, sf), edges(spark, sf)


# ------------------------------------------------------------ graph kernel


@query(G + "SELECT id, CAST(n_out AS BIGINT) AS n_out, CAST(n_in AS BIGINT) AS n_in FROM deg")
def adjacency_degree(spark, sf):
    return graph.degrees(*graph_of(spark, sf))


@query(G + "SELECT id, CAST(sum(o) AS BIGINT) AS calls_out, CAST(sum(i) AS BIGINT) AS calls_in FROM (SELECT src_id AS id, 1 AS o, 0 AS i FROM calls UNION ALL SELECT dst_id, 0, 1 FROM calls) GROUP BY id")
def call_counts(spark, sf):
    return graph.multi_degrees(edges(spark, sf))


@query(G + "SELECT * FROM closure")
def callers_d2(spark, sf):
    return graph.callers(*graph_of(spark, sf))


_TWO = """, both_ways AS (SELECT src_id, dst_id FROM calls UNION SELECT dst_id, src_id FROM calls),
seeds AS (SELECT id FROM g_units WHERE {seeds}),
one AS (SELECT DISTINCT dst_id AS id FROM both_ways WHERE src_id IN (SELECT id FROM seeds)),
two AS (SELECT id FROM one UNION SELECT dst_id FROM both_ways WHERE src_id IN (SELECT id FROM one))"""


@query(G + _TWO.format(seeds="file = 'geo/region.py'") + " SELECT id FROM two WHERE id NOT IN (SELECT id FROM seeds)")
def two_hop_undirected(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.two_hops(e, u.filter("file = 'geo/region.py'"))


@query(G + _TWO.format(seeds="file = 'supply/n3.py'") + ", near AS (SELECT id FROM seeds UNION SELECT id FROM one) SELECT DISTINCT src_id, dst_id FROM g_edges WHERE rel_type = 'RUNTIME_BOUNDARY' AND (src_id IN (SELECT id FROM near) OR dst_id IN (SELECT id FROM near))")
def boundary_warnings(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.boundary_warnings(e, u.filter("file = 'supply/n3.py'"))


@query(G + _TWO.format(seeds="file IN ('supply/n3.py', 'tests/test_Brand11.py')") + " SELECT file FROM g_units WHERE id IN (SELECT id FROM two UNION SELECT id FROM seeds) UNION SELECT file FROM g_units WHERE file IN ('supply/n3.py', 'tests/test_Brand11.py')")
def update_scope_files(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.update_scope(u, e, u.filter(F.col("file").isin("supply/n3.py", "tests/test_Brand11.py")).select("file").distinct())


_REACH = """, reach(id) AS (
  SELECT DISTINCT dst_id FROM adj WHERE src_id IN (SELECT id FROM g_units WHERE {seed}) AND {through}
  UNION SELECT a.dst_id FROM adj a JOIN reach r ON a.src_id = r.id WHERE {through_a})"""
_NONTEST = "dst_id IN (SELECT id FROM g_units WHERE file NOT LIKE 'tests/%')"


@query(G + _REACH.format(seed="file LIKE 'tests/%'", through=_NONTEST, through_a="a." + _NONTEST) + " SELECT id FROM reach")
def test_reach_strict(spark, sf):
    return health.tested(*graph_of(spark, sf))


@query(G + _REACH.format(seed="file LIKE 'tests/%'", through="true", through_a="true") + " SELECT id FROM reach WHERE id NOT IN (SELECT id FROM g_units WHERE file LIKE 'tests/%')")
def test_reach_through(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.reach(u, e, u.filter(text.is_test_name("file")))


@query(G + ", up(root, id) AS (SELECT id, id FROM g_units WHERE file LIKE 'geo/%' UNION SELECT u.root, a.src_id FROM up u JOIN adj a ON a.dst_id = u.id) SELECT root, count(*) - 1 AS n FROM up GROUP BY root")
def transitive_callers(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.transitive_callers(u, e, u.filter("file like 'geo/%'"))


# ------------------------------------------------------- risk, impact, tests

_RISK = """, n AS (SELECT target, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth = 2) AS indirect, count(*) AS callers FROM closure GROUP BY 1),
tests AS (SELECT target, count(DISTINCT test) AS tests FROM with_target JOIN test_edges USING (id) GROUP BY 1),
total AS (SELECT greatest(count(DISTINCT head), 1) AS total FROM placed WHERE type <> 'module'),
risk AS (SELECT u.id AS target, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect, spread, coalesce(tests, 0) AS tests,
  (coalesce(direct, 0) + 0.4::DOUBLE * coalesce(indirect, 0)) * (spread / total) / greatest(coalesce(tests, 0) / greatest(coalesce(direct, 0), 1), 0.05::DOUBLE) AS risk
  FROM g_units u LEFT JOIN n ON n.target = u.id LEFT JOIN spread s ON s.target = u.id LEFT JOIN tests t ON t.target = u.id CROSS JOIN total)"""
_LABEL = "CASE WHEN risk >= 10 THEN 'HIGH' WHEN risk >= 3 THEN 'MEDIUM' ELSE 'LOW' END"


@query(G + _RISK + f" SELECT *, {_LABEL} AS label FROM risk")
def closure_risk(spark, sf):
    return reports.closure_risk(*graph_of(spark, sf))


@query(G + _RISK + f" SELECT (SELECT count(DISTINCT caller) FROM closure WHERE target LIKE 's:%') AS affected, max_by(label, CASE label WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS label FROM (SELECT {_LABEL} AS label FROM risk WHERE target LIKE 's:%')")
def risk_rollup(spark, sf):
    u, e = graph_of(spark, sf)
    return reports.risk_rollup(u, e, u.filter("id like 's:%'"))


@query(G + "SELECT target, caller, depth, name, file, head AS area, greatest(0, line_end - line_start + 1) AS loc FROM closure JOIN placed ON id = caller WHERE target IN ('s:5', 'n:3')")
def impact_report(spark, sf):
    u, e = graph_of(spark, sf)
    return reports.impact(u, e, u.filter(F.col("id").isin("s:5", "n:3")), 2)


@query(G + _RISK + " SELECT r.target, greatest(0, line_end - line_start + 1) AS loc, direct + indirect AS callers, spread, tests, CASE WHEN spread >= 3 OR direct + indirect >= 10 THEN 'HIGH' WHEN spread >= 2 OR direct + indirect >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS complexity FROM risk r JOIN g_units ON id = r.target")
def impact_summary(spark, sf):
    u, e = graph_of(spark, sf)
    return reports.impact_summary(u, e, u, 2)


@query(G + "SELECT DISTINCT target, test FROM with_target JOIN test_edges USING (id)")
def covering_tests(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.covering_tests(u, e, graph.callers(u, e), u)


@query(G + "SELECT DISTINCT target, id FROM with_target WHERE id NOT IN (SELECT id FROM test_edges) AND id NOT LIKE 'external::%'")
def uncovered_callers(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.uncovered(u, e, graph.callers(u, e), u)


_SPOT = ", spot AS (SELECT 'supply/n' || s_nationkey || '.py' AS at_file, s_suppkey + 3 AS at_line FROM supplier ORDER BY s_suppkey DESC LIMIT 1)"


@query(G + _SPOT + " SELECT id, file FROM g_units, spot WHERE file = at_file AND line_start <= at_line AND line_end >= at_line AND type <> 'module' ORDER BY file, line_start, id LIMIT 1")
def resolve_target(spark, sf):
    """A place in the file of the last supplier."""
    s = table(spark, sf, "supplier").orderBy(F.desc("s_suppkey")).first()
    return reports.resolve(units(spark, sf), f"supply/n{s['s_nationkey']}.py:{s['s_suppkey'] + 3}").select("id", "file")


# None of the callers calls another, so that all are of the first layer.
@query(G + ", steps AS (SELECT p.file, 0 AS last, list_sort(list(id)) AS ids FROM closure JOIN placed p ON p.id = caller WHERE target = 's:5' GROUP BY 1 UNION ALL SELECT file, 1, [id] FROM placed WHERE id = 's:5') SELECT row_number() OVER (ORDER BY last, file) AS step, file, ids FROM steps")
def refactor_sequence(spark, sf):
    u, e = graph_of(spark, sf)
    return reports.refactor_sequence(u, e, u.filter("id = 's:5'"))


# -------------------------------------------------------------------- health

_AREAS = ", e AS (SELECT v.*, s.area AS src_area, d.area AS dst_area FROM valid v JOIN placed s ON s.id = v.src_id JOIN placed d ON d.id = v.dst_id)"


@query(G + _AREAS + " SELECT count(*) FILTER (src_area <> dst_area) / (SELECT count(*) FROM calls) AS coupling FROM e")
def health_coupling(spark, sf):
    return health.coupling(*graph_of(spark, sf), AREAS)


_COHESION = " SELECT list_sum(list(share ORDER BY src_area)) / count(*) AS cohesion FROM (SELECT src_area, count(*) FILTER (src_area = dst_area) / count(*) AS share FROM e GROUP BY 1)"


@query(G + _AREAS + _COHESION)
def health_cohesion(spark, sf):
    return health.cohesion(*graph_of(spark, sf), AREAS)


_BLAST = "(SELECT count(*) FROM (SELECT dst_id, src_id FROM adj UNION SELECT a.dst_id, b.src_id FROM adj a JOIN adj b ON a.src_id = b.dst_id)) / (SELECT count(*) FROM g_units)"


@query(G + f"SELECT {_BLAST} AS avg_blast")
def health_avg_blast(spark, sf):
    return health.average_closure(*graph_of(spark, sf))


_DEAD = "(SELECT (count(*) FILTER (n_in = 0 AND n_out = 0)) * 100.0::DOUBLE / count(*) FROM deg)"


@query(G + f"SELECT {_DEAD} AS dead_code_pct")
def health_dead(spark, sf):
    return health.dead_share(*graph_of(spark, sf))


_SURFACE = _REACH.format(seed="file LIKE 'tests/%'", through=_NONTEST, through_a="a." + _NONTEST)
_SURFACE_VALUE = "(SELECT count(*) FROM reach) * 100.0::DOUBLE / (SELECT count(*) FROM g_units WHERE file NOT LIKE 'tests/%')"


@query(G + _SURFACE + f" SELECT {_SURFACE_VALUE} AS test_surface")
def health_test_surface(spark, sf):
    return health.test_surface(*graph_of(spark, sf))


_HUB = ", ranked AS (SELECT id, n_in + n_out AS d, row_number() OVER (ORDER BY n_in + n_out DESC) AS k FROM deg), hubs AS (SELECT id FROM ranked WHERE d > 0 AND d >= (SELECT d FROM ranked WHERE k = greatest(1, floor((SELECT count(*) FROM deg) * 0.05::DOUBLE))))"
_HUB_VALUE = "(SELECT count(*) FROM valid WHERE src_id IN (SELECT id FROM hubs) OR dst_id IN (SELECT id FROM hubs)) * 100.0::DOUBLE / (SELECT count(*) FROM calls)"


@query(G + _HUB + f" SELECT {_HUB_VALUE} AS hub_concentration")
def health_hub(spark, sf):
    return health.hub_concentration(*graph_of(spark, sf))


_CALLERS = ", n AS (SELECT dst_id AS id, count(*) AS callers, count(DISTINCT area) AS spread FROM adj JOIN placed p ON p.id = src_id GROUP BY 1), scored AS (SELECT u.id, u.name, u.file, coalesce(callers, 0) AS callers, coalesce(spread, 0) AS spread, coalesce(callers, 0) * greatest(coalesce(spread, 0), 1) AS score FROM g_units u LEFT JOIN n USING (id))"


@query(G + _CALLERS + " SELECT * FROM scored ORDER BY score DESC, id LIMIT 10")
def health_hotspots(spark, sf):
    return health.hotspots(*graph_of(spark, sf), AREAS)


@query(G + _AREAS + _HUB + _SURFACE + f" SELECT (SELECT count(*) FILTER (src_area <> dst_area) / (SELECT count(*) FROM calls) FROM e) AS coupling, {_BLAST} AS avg_blast, {_DEAD} AS dead_code_pct, ({_COHESION}) AS cohesion, {_SURFACE_VALUE} AS test_surface, {_HUB_VALUE} AS hub_concentration, (SELECT count(*) FROM g_units) AS unit_count, (SELECT count(*) FROM calls) AS edge_count")
def health_metrics(spark, sf):
    return health.metrics(*graph_of(spark, sf), AREAS)


def daily(spark, sf):
    """Events of a day as a snapshot of so many units."""
    day = F.date_trunc("day", "ts")
    return table(spark, sf, "events").groupBy(F.unix_timestamp(day).alias("build_ts")).agg(F.count("*").alias("unit_count"))


_DAILY = "WITH s AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS build_ts, count(*) AS unit_count FROM events GROUP BY 1)"


@query(_DAILY + f", r AS (SELECT *, abs(unit_count - lag(unit_count) OVER (ORDER BY build_ts)) AS step FROM s WHERE build_ts >= {NOW_S - 7 * 86400}) SELECT coalesce(CAST(coalesce(sum(step), 0) + abs(40 - max_by(unit_count, build_ts)) AS BIGINT) / greatest(({NOW_S} - min(build_ts)) / 86400.0::DOUBLE, 0.01::DOUBLE), 0.0::DOUBLE) AS drift_velocity FROM r")
def drift_velocity(spark, sf):
    return health.drift_velocity(daily(spark, sf), 40, NOW_S)


@query(_DAILY + ", d AS (SELECT build_ts, unit_count AS value, unit_count - lag(unit_count) OVER (ORDER BY build_ts) AS delta FROM s) SELECT *, CASE WHEN delta > 0.001 THEN 'up' WHEN delta < -0.001 THEN 'down' ELSE 'stable' END AS trend FROM d")
def health_delta(spark, sf):
    return health.deltas(daily(spark, sf), "unit_count")


@query(_DAILY + ", b AS (SELECT min(unit_count) AS low, max(unit_count) AS high FROM s), n AS (SELECT build_ts, CAST(least(floor(coalesce(CAST(unit_count - low AS DOUBLE) / nullif(CAST(high - low AS DOUBLE), 0), 0) * 8), 7) AS BIGINT) AS bar FROM s, b) SELECT *, substr('▁▂▃▄▅▆▇█', bar + 1, 1) AS sign FROM n")
def sparkline(spark, sf):
    return health.sparkline(daily(spark, sf), "unit_count")


# ---------------------------------------------------------------- onboarding


@query(G + "SELECT id, name, file, area, CAST(n_out AS BIGINT) AS n_out FROM placed JOIN deg USING (id) WHERE n_in = 0 AND n_out > 0 AND area <> '__unknown__' ORDER BY n_out DESC, id LIMIT 10")
def entry_points(spark, sf):
    return onboarding.entry_points(*graph_of(spark, sf), AREAS)


@query(G + _CALLERS + ", chosen AS (SELECT * FROM scored WHERE file NOT LIKE 'tests/%' ORDER BY score DESC, id DESC LIMIT 50), up(root, id) AS (SELECT id, id FROM chosen UNION SELECT u.root, a.src_id FROM up u JOIN adj a ON a.dst_id = u.id) SELECT c.id, name, file, callers, spread, count(*) - 1 AS closure FROM chosen c JOIN up ON up.root = c.id GROUP BY ALL ORDER BY closure DESC, c.id DESC LIMIT 10")
def onboard_hotspots(spark, sf):
    return onboarding.hotspots(*graph_of(spark, sf), AREAS)


_CONFIG = ", config AS (SELECT * FROM (VALUES ('geo', 'geo/'), ('supply', 'supply/'), ('catalog', 'catalog/'), ('crm', 'crm/')) t(area, path))"


@query(G + _CONFIG + ", n AS (SELECT area, count(*) AS units, count(*) FILTER (n_in = 0 AND n_out > 0) AS entries FROM placed JOIN deg USING (id) GROUP BY 1), s AS (SELECT a.area, count(*) FILTER (a.area <> b.area) / count(*) AS coupling, count(*) FILTER (a.area = b.area) / count(*) AS cohesion FROM adj JOIN placed a ON a.id = src_id JOIN placed b ON b.id = dst_id GROUP BY 1) SELECT area, path, coalesce(units, 0) AS units, coalesce(entries, 0) AS entries, coalesce(coupling, 0) AS coupling, coalesce(cohesion, 0) AS cohesion FROM config LEFT JOIN n USING (area) LEFT JOIN s USING (area)")
def module_sections(spark, sf):
    return onboarding.sections(*graph_of(spark, sf), AREAS)


@query(G + _REACH.format(seed="file LIKE 'tests/%'", through="true", through_a="true") + " SELECT area, count(*) FILTER (n_in = 0 AND n_out = 0) * 100.0::DOUBLE / count(*) AS dead_pct, count(*) FILTER (id IN (SELECT id FROM reach)) * 100.0::DOUBLE / count(*) AS surface FROM placed JOIN deg USING (id) WHERE area <> '__unknown__' GROUP BY area")
def safe_zones(spark, sf):
    return onboarding.safe_areas(*graph_of(spark, sf), AREAS)


@query(G + _AREAS + " SELECT DISTINCT src_area, dst_area FROM e WHERE src_area <> dst_area AND src_area <> '__unknown__' AND dst_area <> '__unknown__'")
def module_deps(spark, sf):
    return onboarding.area_dependencies(*graph_of(spark, sf), AREAS)


@query(G + _AREAS + " SELECT DISTINCT dst_area AS area FROM e WHERE src_area = 'crm' AND dst_area NOT IN ('crm', '__unknown__') UNION SELECT src_area FROM e WHERE dst_area = 'crm' AND src_area NOT IN ('crm', '__unknown__')")
def area_neighbours(spark, sf):
    return onboarding.neighbours(onboarding.area_dependencies(*graph_of(spark, sf), AREAS), "crm")


_STEP = "(SELECT c.area FROM config c WHERE NOT list_contains(done, c.area) ORDER BY (SELECT count(*) FROM needs n WHERE n.src_area = c.area AND NOT list_contains(done, n.dst_area)), c.area LIMIT 1)"
_NEEDS = ", config AS (SELECT unnest(['geo', 'supply', 'catalog', 'crm']) AS area), needs AS (SELECT DISTINCT src_area, dst_area FROM e WHERE src_area <> dst_area AND src_area <> '__unknown__' AND dst_area <> '__unknown__')"


def _reading(k: int) -> str:
    """The areas read after k steps, one step inside the other."""
    done = "CAST([] AS VARCHAR[])"
    for _ in range(k):
        done = f"(SELECT list_append(done, {_STEP}) FROM (SELECT {done} AS done))"
    return done


@query(G + _AREAS + _NEEDS + f" SELECT CAST(unnest(range(4)) AS BIGINT) AS ord, unnest({_reading(4)}) AS area")
def reading_order(spark, sf):
    return onboarding.reading_order(*graph_of(spark, sf), AREAS)


# ------------------------------------------------------------------ exposure

_OPEN = ", entry AS (SELECT * FROM placed WHERE id NOT IN (SELECT dst_id FROM g_edges WHERE rel_type NOT IN ('RUNTIME_BOUNDARY', 'IMPORT')))"


@query(G + _OPEN + " SELECT id FROM entry")
def trust_boundaries(spark, sf):
    return graph.trust_boundaries(*graph_of(spark, sf)).select("id")


def external(spark, sf):
    """Edges with boundary ends named like packages, and nations calling one."""
    e = edges(spark, sf)
    b = e.filter("rel_type = 'RUNTIME_BOUNDARY'").withColumn("dst_id", F.concat(F.lit("external::Pkg"), F.when(F.col("dst_id").endswith("3"), ".x").otherwise("_y"), F.col("dst_id")))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")), F.lit("external::pkg"), F.lit("RUNTIME_BOUNDARY"))
    return e.filter("rel_type <> 'RUNTIME_BOUNDARY'").union(b).union(n)


_PKG = ", ext AS (SELECT src_id, 'external::Pkg' || CASE WHEN dst_id LIKE '%3' THEN '.x' ELSE '_y' END || dst_id AS dst_id FROM g_edges WHERE rel_type = 'RUNTIME_BOUNDARY' UNION ALL SELECT 'n:' || n_nationkey, 'external::pkg' FROM nation), pkg AS (SELECT src_id AS id, min(dst_id) AS dst FROM ext WHERE lower(dst_id) = 'external::pkg' OR starts_with(lower(dst_id), 'external::pkg.') GROUP BY 1)"


@query(G + _PKG + " SELECT * FROM pkg")
def package_callers(spark, sf):
    return reports.package_callers(units(spark, sf), external(spark, sf), "pkg")


_EXPOSED = _PKG + _OPEN + """, above AS (SELECT c.target AS id, min_by(caller, (c.depth, caller)) AS ancestor FROM closure c JOIN entry x ON x.id = c.caller AND x.head <> 'tests' GROUP BY 1),
exposed AS (SELECT p.id, CASE WHEN head = 'tests' THEN NULL WHEN p.id IN (SELECT id FROM entry) THEN p.id ELSE ancestor END AS entry,
  CASE WHEN head = 'tests' THEN 0.1::DOUBLE WHEN p.id IN (SELECT id FROM entry) THEN 1.0::DOUBLE WHEN ancestor IS NOT NULL THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS score
  FROM placed p JOIN pkg USING (id) LEFT JOIN above ON above.id = p.id)"""


@query(G + _EXPOSED + " SELECT *, CASE WHEN score > 0.1::DOUBLE THEN 'critical' ELSE 'low' END AS level FROM exposed")
def exposure(spark, sf):
    u, e = units(spark, sf), external(spark, sf)
    return reports.exposure(u, e, reports.package_callers(u, e, "pkg"), depth=2)


@query(G + _EXPOSED + ", steps AS (SELECT CASE WHEN score > 0.1::DOUBLE THEN 1 ELSE 2 END AS kind, coalesce(entry, id) AS id, score FROM exposed UNION ALL SELECT 3, NULL, 0.0::DOUBLE) SELECT row_number() OVER (ORDER BY kind, score DESC, id) AS step, CASE kind WHEN 1 THEN 'patch' WHEN 2 THEN 'review' ELSE 'pin pkg > 1.2' END AS action, id, score FROM steps")
def remediation(spark, sf):
    u, e = units(spark, sf), external(spark, sf)
    return reports.remediation(reports.exposure(u, e, reports.package_callers(u, e, "pkg"), depth=2), "pkg", "1.2")


@query(G + _PKG + _OPEN + " SELECT count(DISTINCT caller) AS upstream FROM closure WHERE target IN (SELECT id FROM pkg JOIN placed USING (id) WHERE head <> 'tests') AND target NOT IN (SELECT id FROM entry)")
def upstream_count(spark, sf):
    u, e = units(spark, sf), external(spark, sf)
    return reports.upstream_count(u, e, reports.package_callers(u, e, "pkg"), depth=2)


# ------------------------------------------------------------ ownership, gaps


def line_authors(spark, sf):
    """An order as a line of a customer's file, written by its clerk class."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.concat(F.lit("crm/"), "c_mktsegment", F.lit(".py")).alias("file"), F.col("o_custkey").alias("line"), F.col("o_orderpriority").alias("author"))


_OWN = ", la AS (SELECT 'crm/' || c_mktsegment || '.py' AS file, o_custkey AS line, o_orderpriority AS author FROM orders JOIN customer ON o_custkey = c_custkey), own AS (SELECT u.id, author, count(*) AS lines, min(line) AS first FROM g_units u JOIN la ON la.file = u.file AND line BETWEEN line_start AND line_end GROUP BY 1, 2), best AS (SELECT id, count(*) AS authors, max_by(author, (lines, -first, author)) AS primary_author, max(lines) / CAST(sum(lines) AS BIGINT) AS share FROM own GROUP BY 1), owned AS (SELECT u.id, coalesce(authors, 1) AS authors, coalesce(primary_author, 'unknown') AS primary_author, coalesce(share, 1.0::DOUBLE) AS share FROM g_units u LEFT JOIN best USING (id))"


@query(G + _OWN + " SELECT * FROM owned")
def ownership(spark, sf):
    return reports.ownership(units(spark, sf), line_authors(spark, sf))


@query(G + _OWN + ", n AS (SELECT target AS id, count(*) AS callers FROM closure GROUP BY 1), s AS (SELECT id, head AS area, authors, primary_author, callers, callers / authors AS silo_score FROM placed JOIN n USING (id) JOIN owned USING (id) WHERE line_start > 0) SELECT *, CASE WHEN silo_score >= 20 THEN 'CRITICAL' WHEN silo_score >= 8 THEN 'HIGH' WHEN silo_score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM s")
def silo_report(spark, sf):
    return reports.silos(*graph_of(spark, sf), line_authors(spark, sf))


def commits(spark, sf):
    p = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return p.select(F.concat(F.lit("catalog/"), F.translate("p_brand", "#", ""), F.lit(".py")).alias("file"), F.col("l_shipdate").alias("ts"))


_COMMITS = "commits AS (SELECT 'catalog/' || replace(p_brand, '#', '') || '.py' AS file, l_shipdate AS ts FROM lineitem JOIN part ON l_partkey = p_partkey), velocity AS (SELECT file, count(*) AS velocity FROM commits WHERE ts >= TIMESTAMP '1998-09-02' - INTERVAL 30 DAY GROUP BY 1)"


@query(f"WITH {_COMMITS} SELECT * FROM velocity")
def file_velocity(spark, sf):
    return reports.file_velocity(commits(spark, sf), "1998-09-02 00:00:00")


_GAP = f", {_COMMITS}, rows_ AS (SELECT * FROM placed WHERE type <> 'module' AND file NOT ILIKE 'tests/%'), n AS (SELECT target AS id, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth = 2) AS indirect, count(*) AS callers FROM closure GROUP BY 1), gap AS (SELECT r.id, head AS area, coalesce(callers, 0) AS callers, coalesce(velocity, 0) AS velocity, (coalesce(direct, 0) + 0.4::DOUBLE * coalesce(indirect, 0)) * (spread / (SELECT greatest(count(DISTINCT head), 1) FROM rows_)) / 0.05::DOUBLE * coalesce(velocity, 0) AS gap_score FROM rows_ r LEFT JOIN n USING (id) LEFT JOIN spread s ON s.target = r.id LEFT JOIN velocity v ON v.file = r.file WHERE r.line_start > 0 AND r.id NOT IN (SELECT id FROM test_edges))"


@query(G + _GAP + " SELECT *, CASE WHEN gap_score >= 100 THEN 'CRITICAL' WHEN gap_score >= 25 THEN 'HIGH' WHEN gap_score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM gap")
def coverage_gap(spark, sf):
    u, e = graph_of(spark, sf)
    return reports.coverage_gaps(u, e, reports.covered_by_graph(u, e), reports.file_velocity(commits(spark, sf), "1998-09-02 00:00:00"))


@query(G + ", lines AS (SELECT DISTINCT 'catalog/' || replace(p_brand, '#', '') || '.py' AS file, l_partkey AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R') SELECT DISTINCT id FROM g_units u JOIN lines l ON l.file = u.file AND l.line BETWEEN u.line_start AND u.line_end")
def coverage_overlap(spark, sf):
    p = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = p.select(F.concat(F.lit("catalog/"), F.translate("p_brand", "#", ""), F.lit(".py")).alias("file"), F.col("l_partkey").alias("line"))
    return reports.covered_by_lines(units(spark, sf), lines)


# ------------------------------------------------------------------- vectors


def unit_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("id"), "embedding")


def first_vector(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


_DIST = "list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_KNN = f"SELECT 'v:' || v.vec_id AS id, round({_DIST}, 9) AS distance, round(greatest(0.0::DOUBLE, {{sim}}), 9) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DIST}, id LIMIT 10"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(_KNN.format(sim=f"1 - {_DIST}"))
def knn_l2(spark, sf):
    return rounded(vectors.knn(unit_vectors(spark, sf), first_vector(spark, sf)), "distance", "similarity")


@query(_KNN.format(sim=f"1 - {_DIST} * {_DIST} / 2"))
def knn_cosine(spark, sf):
    return rounded(vectors.knn(unit_vectors(spark, sf), first_vector(spark, sf), metric="cosine"), "distance", "similarity")


@query(f"SELECT * FROM (SELECT 'v:' || q.vec_id AS query, 'v:' || v.vec_id AS id, round({_DIST}, 9) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, 'v:' || v.vec_id) AS INTEGER) AS rank FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id AND q.label = 1) WHERE rank <= 10")
def knn_batch(spark, sf):
    v = unit_vectors(spark, sf)
    q = v.join(table(spark, sf, "embeddings").filter("label = 1").select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("id")), "id", "left_semi")
    return rounded(vectors.knn_batch(v, q), "distance")


def vector_graph(spark, sf):
    """Vectors as units in a file a label, each calling the next of its label."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    key = F.concat(F.lit("v:"), F.col("vec_id").cast("string"))
    u = e.select(key.alias("id"), F.col("vec_id").cast("string").alias("name"), F.concat(F.lit("l"), F.col("label").cast("string"), F.lit("/a.py")).alias("file"))
    step = e.select(key.alias("src_id"), F.concat(F.lit("v:"), ((F.col("vec_id") + 1) % n).cast("string")).alias("dst_id"), F.lit("LOCAL_CALL").alias("rel_type"))
    return u, step


@query(f"WITH e AS (SELECT 'v:' || vec_id AS src_id, 'v:' || ((vec_id + 1) % (SELECT count(*) FROM embeddings)) AS dst_id FROM embeddings), b AS (SELECT * FROM e UNION SELECT dst_id, src_id FROM e), hits AS (SELECT 'v:' || v.vec_id AS id, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, id LIMIT 10), one AS (SELECT DISTINCT dst_id AS id FROM b WHERE src_id IN (SELECT id FROM hits)), two AS (SELECT id FROM one UNION SELECT dst_id FROM b WHERE src_id IN (SELECT id FROM one)) SELECT id, 'matched' AS source, round(distance, 9) AS distance FROM hits UNION ALL SELECT id, 'neighbour', NULL FROM two WHERE id NOT IN (SELECT id FROM hits)")
def hybrid_search(spark, sf):
    u, e = vector_graph(spark, sf)
    return rounded(vectors.hybrid(unit_vectors(spark, sf), u, e, first_vector(spark, sf)), "distance").select("id", "source", "distance")


# --------------------------------------------------------------------- notes


def event_notes(spark, sf):
    """An event as a note: its type on the user's unit, decaying with age."""
    e = table(spark, sf, "events")
    s = F.when(F.col("value") < 20, "stale").otherwise("active")
    return e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("unit_id"), F.col("event_type").alias("area"), F.lit("context").alias("type"), F.unix_timestamp("ts").alias("created_ts"), F.lit(1.0).alias("decay_score"), s.alias("status"))


_NOTES = "WITH notes AS (SELECT CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS unit_id, event_type AS area, CAST(floor(epoch(ts)) AS BIGINT) AS created_ts, CASE WHEN value < 20 THEN 'stale' ELSE 'active' END AS status FROM events)"
_DECAY = _NOTES + f", d AS (SELECT id, exp(-greatest(({NOW_S} - created_ts) / 86400.0::DOUBLE, 0) * (ln(2::DOUBLE) / 7)) * CASE WHEN unit_id LIKE '%3' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS score FROM notes)"


def decayed(spark, sf):
    n = event_notes(spark, sf)
    return notes.recompute_decay(n, NOW_S, n.filter("unit_id like '%3'").select(F.col("unit_id").alias("id")), half_life=7.0)


@query(_DECAY + " SELECT id, round(score, 9) AS decay_score, CASE WHEN round(score, 9) < 0.1 THEN 'stale' WHEN round(score, 9) < 0.3 THEN 'possibly_stale' ELSE 'active' END AS status FROM d")
def note_decay(spark, sf):
    d = rounded(decayed(spark, sf), "decay_score")
    return d.select("id", "decay_score", scores.decay_status("decay_score").alias("status"))


@query(_DECAY + " SELECT CASE WHEN round(score, 9) < 0.1 THEN 'stale' WHEN round(score, 9) < 0.3 THEN 'possibly_stale' ELSE 'active' END AS status, count(*) AS n FROM d GROUP BY 1")
def note_status_counts(spark, sf):
    return rounded(decayed(spark, sf), "decay_score").groupBy(scores.decay_status("decay_score").alias("status")).agg(F.count("*").alias("n"))


@query(_NOTES + " SELECT id, created_ts FROM notes WHERE area = 'error' AND status <> 'stale'")
def note_list(spark, sf):
    return notes.list_notes(event_notes(spark, sf), area="error").select("id", "created_ts")


@query(f"WITH n AS (SELECT vec_id, embedding FROM embeddings WHERE label <> 3) SELECT CAST(v.vec_id AS VARCHAR) AS id, round({_DIST}, 9) AS distance FROM n v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DIST}, id LIMIT 10")
def note_recall(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("id", F.col("vec_id").cast("string"))
    n = e.select("id", F.when(F.col("label") == 3, "stale").otherwise("active").alias("status"))
    return rounded(notes.recall(n, e.select("id", "embedding"), first_vector(spark, sf)).select("id", "distance"), "distance")


_LINKS = "WITH RECURSIVE links AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS from_id, CAST(o_orderkey % 97 AS VARCHAR) AS to_id FROM orders), walk(start, id, depth) AS (SELECT DISTINCT to_id, to_id, 0 FROM links UNION SELECT w.start, l.from_id, w.depth + 1 FROM walk w JOIN links l ON l.to_id = w.id WHERE w.depth < 5)"


@query(_LINKS + " SELECT start, id, min(depth) AS depth FROM walk GROUP BY 1, 2")
def note_ancestry(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("from_id"), (F.col("o_orderkey") % 97).cast("string").alias("to_id")).distinct()
    return graph.note_ancestry(e, e.select(F.col("to_id").alias("id")))


# --------------------------------------------------------- text, files, drift


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.tokens("text").alias("tokens"))


@query("SELECT vec_id, 0.6::DOUBLE * (vec_id % 11 / 10) + 0.4::DOUBLE * CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS relevance FROM embeddings")
def relevance(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", scores.relevance(F.col("vec_id") % 11 / 10, F.col("label") == 1).alias("relevance"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))


def doc_files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))).alias("file"), F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), "doc_id", "text")


@query("SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS state_hash FROM (SELECT sha256(text) AS h FROM documents)")
def state_hash(spark, sf):
    return drift.state_hash(doc_files(spark, sf))


def later_files(spark, sf):
    """A second version: every 7th file is gone, every 5th changed, every 3rd
    moved to a new name."""
    f = doc_files(spark, sf).filter("doc_id % 7 <> 0")
    file = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("new/"), "file")).otherwise(F.col("file"))
    return f.select(file.alias("file"), F.when(F.col("doc_id") % 5 == 0, F.lit("changed")).otherwise(F.col("hash")).alias("hash"), "doc_id")


_FILES = "WITH a AS (SELECT source || '/' || doc_id || '.' || lang AS file, sha256(text) AS hash, doc_id FROM documents), b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'new/' || file ELSE file END AS file, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE hash END AS hash FROM a WHERE doc_id % 7 <> 0), d AS (SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.hash IS NULL THEN 'A' WHEN b.hash IS NULL THEN 'D' WHEN a.hash <> b.hash THEN 'M' END AS status FROM a FULL JOIN b ON a.file = b.file)"


@query(_FILES + " SELECT * FROM d WHERE status IS NOT NULL")
def hash_diff(spark, sf):
    return drift.hash_diff(doc_files(spark, sf), later_files(spark, sf))


def part_units(spark, sf, later=False):
    p = table(spark, sf, "part").select(F.translate("p_brand", "#", "").alias("file"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws("  ", "p_type", "p_brand").alias("signature"), "p_partkey")
    if later:
        p = p.filter("p_partkey % 11 <> 0").withColumn("signature", F.when(F.col("p_partkey") % 13 == 0, "other").otherwise(F.concat(F.lit(" "), F.regexp_replace("signature", " +", " "))))
    return p


_UNIT_DRIFT = "WITH a AS (SELECT replace(p_brand, '#', '') AS file, p_name || ' ' || p_partkey AS name, p_type || ' ' || p_brand AS sig, p_partkey FROM part), d AS (SELECT file, name, CASE WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 13 = 0 THEN 'signature' END AS drift FROM a)"


@query(_UNIT_DRIFT + " SELECT * FROM d WHERE drift IS NOT NULL")
def unit_drift(spark, sf):
    return drift.unit_drift(part_units(spark, sf), part_units(spark, sf, True))


@query(_UNIT_DRIFT + " SELECT file, 'M' AS status, CASE WHEN count(drift) > 0 THEN 'structural' ELSE 'minor' END AS drift FROM d GROUP BY 1")
def drift_classes(spark, sf):
    d = drift.unit_drift(part_units(spark, sf), part_units(spark, sf, True))
    return drift.classify(part_units(spark, sf).select("file", F.lit("M").alias("status")).distinct(), d)


@query("WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS file, page_id FROM pages) SELECT page_id, CASE WHEN file = 'en' OR file LIKE 'en/%' THEN 'english' WHEN file = 'de' OR file LIKE 'de/%' THEN 'german' ELSE '__unknown__' END AS area FROM p")
def area_first_prefix(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("file"))
    return p.select("page_id", areas.first_prefix("file", {"english": "en/", "german": "de"}).alias("area"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'www' WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http') THEN 'plain' ELSE 'unknown' END AS area FROM pages")
def area_longest_prefix(spark, sf):
    return table(spark, sf, "pages").select("page_id", areas.longest_prefix("url", {"plain": "http", "secure": "https://", "www": "https://www."}).alias("area"))


@query(G + "SELECT area, count(*) AS n FROM g_units u JOIN (VALUES ('all', '.'), ('geo', 'geo'), ('nation', 'Geo')) t(area, path) ON path = '.' OR starts_with(lower(file), lower(path) || '/') GROUP BY 1")
def area_counts(spark, sf):
    a = spark.createDataFrame([("all", "."), ("geo", "geo/"), ("nation", "Geo")], "name string, path string")
    return areas.like_prefix(units(spark, sf).select("file"), a).groupBy("area").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- linking


def captures(spark, sf):
    """A line item as a call at its part's brand file, of its supplier or, for
    returned goods, of a name that no unit has."""
    # Parts come last: equal captures have met by their part.
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    callee = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("lib.f"), (F.col("l_orderkey") % 50).cast("string"))).when(F.col("l_returnflag") == "A", F.col("p_name")).otherwise(F.col("s_name"))
    return li.select(F.lit("call").alias("capture_name"), F.concat(callee, F.lit(" (x, y)")).alias("text"), F.concat(F.lit("catalog/"), F.translate("p_brand", "#", ""), F.lit(".py")).alias("file"), F.col("l_partkey").alias("line")).distinct()


_CAPS = """, caps AS (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'lib.f' || (l_orderkey % 50) WHEN l_returnflag = 'A' THEN p_name ELSE s_name END AS callee, 'catalog/' || replace(p_brand, '#', '') || '.py' AS file, l_partkey AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
held AS (SELECT callee, c.file, line, min_by(id, (line_start, id)) AS first_id, max_by(id, (line_start, id)) AS inner_id FROM caps c JOIN g_units u ON u.file = c.file AND line BETWEEN line_start AND line_end GROUP BY 1, 2, 3)"""


@query(G + _CAPS + " SELECT callee, file, line, first_id AS src_id FROM held")
def containing_unit_first(spark, sf):
    c = linking.containing(linking.keyed(captures(spark, sf)), units(spark, sf))
    return c.select(text.callee_name("text").alias("callee"), "file", "line", "src_id")


@query(G + _CAPS + " SELECT callee, file, line, inner_id AS src_id FROM held")
def containing_unit_innermost(spark, sf):
    c = linking.containing(linking.keyed(captures(spark, sf)), units(spark, sf), "innermost")
    return c.select(text.callee_name("text").alias("callee"), "file", "line", "src_id")


def linked(spark, sf, kind):
    return linking.link(captures(spark, sf), units(spark, sf)).filter(F.col("rel_type") == kind)


@query(G + _CAPS + ", m AS (SELECT first_id AS src_id, h.file, line, callee, min_by(id, (line_start, id)) AS dst_id FROM held h JOIN g_units u ON u.name = callee AND u.file = h.file GROUP BY 1, 2, 3, 4) SELECT src_id, dst_id, 'LOCAL_CALL' AS rel_type, min(file) AS file FROM m GROUP BY 1, 2")
def link_local(spark, sf):
    return linked(spark, sf, "LOCAL_CALL")


@query(G + _CAPS + ", names AS (SELECT DISTINCT callee, file FROM held), pick AS (SELECT n.callee, n.file, min_by(id, (u.file, line_start, id)) AS dst_id FROM names n JOIN g_units u ON u.name = n.callee AND u.file <> n.file GROUP BY 1, 2) SELECT first_id AS src_id, dst_id, 'EXTERNAL_CALL' AS rel_type, min(file) AS file FROM held JOIN pick USING (callee, file) GROUP BY 1, 2")
def link_external(spark, sf):
    return linked(spark, sf, "EXTERNAL_CALL")


@query(G + _CAPS + " SELECT first_id AS src_id, 'external::' || callee AS dst_id, 'RUNTIME_BOUNDARY' AS rel_type, min(file) AS file FROM held WHERE callee NOT IN (SELECT name FROM g_units) GROUP BY 1, 2")
def link_boundary(spark, sf):
    return linked(spark, sf, "RUNTIME_BOUNDARY")


# -------------------------------------------------------- text and confidence


@query("SELECT count(*) FILTER (contains(html, 'getattr') OR contains(html, '__dict__') OR contains(html, 'vars(') OR contains(html, 'locals(') OR contains(html, 'globals(') OR contains(html, 'importlib')) AS dynamic FROM pages")
def dynamic_patterns(spark, sf):
    return confidence.dynamic_count(table(spark, sf, "pages").select(F.col("html").alias("signature"), F.lit(None).cast("string").alias("docstring")))


@query("SELECT DISTINCT ext FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'kt' WHEN 1 THEN 'rs' WHEN 2 THEN 'txt' ELSE 'go' END AS ext FROM documents) WHERE ext IN ('kt', 'rs') ORDER BY ext LIMIT 10")
def unindexed_langs(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("kt", "rs", "txt", "go"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return confidence.unindexed(table(spark, sf, "documents").select(F.concat(F.lit("a/b."), ext).alias("file")), [".go"])


@query(G + _REACH.format(seed="file LIKE 'tests/%'", through=_NONTEST, through_a="a." + _NONTEST) + ", c AS (SELECT count(*) AS total, count(*) FILTER (file = 'supply/n3.py') AS changed FROM g_units), m AS (SELECT count(*) AS missing FROM g_units WHERE file NOT LIKE 'tests/%' AND id NOT IN (SELECT id FROM reach)) SELECT total, changed, missing, greatest(0.5::DOUBLE, 1 - 30::DOUBLE / 168.0::DOUBLE) * greatest(0.5::DOUBLE, 1 - changed / total) * greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * 0) * 1.0::DOUBLE AS confidence FROM c, m")
def confidence_state(spark, sf):
    u, e = graph_of(spark, sf)
    u = u.withColumns({"signature": F.lit(None).cast("string"), "docstring": F.lit(None).cast("string")})
    s = confidence.state(u, e, u.select("file"), u.filter("file = 'supply/n3.py'").select("file").distinct(), [".py"], 30.0)
    return s.select("total", "changed", "missing", "confidence")


@query(r"SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS sig FROM pages")
def signature_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.normal_signature("html").alias("sig"))


@query("SELECT doc_id, trim(split_part(text, '(', 1)) AS callee FROM documents")
def callee_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.callee_name("text").alias("callee"))


@query("SELECT p_partkey, regexp_extract('from x import ' || p_name || ', y', 'import ([^ ]+)', 1) AS imported FROM part")
def import_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.import_name(F.concat(F.lit("from x import "), "p_name", F.lit(", y"))).alias("imported"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ', ,' || p_name, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part")
def tags_array(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.tags_array(F.concat("p_type", F.lit(", ,"), "p_name")), "|").alias("tags"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'HIGH' WHEN c_mktsegment = 'FURNITURE' THEN 'LOW' ELSE 'MEDIUM' END AS relevance FROM customer")
def intent_relevance(spark, sf):
    doc = spark.createDataFrame([("s1", "ship", ["BUILDING", "MACHINERY"], ["FURNITURE"], [], [], [], [])], intent.SCHEMA)
    rows = table(spark, sf, "customer").select("c_custkey", F.array("c_mktsegment").alias("areas"))
    return intent.enrich(rows, doc).select("c_custkey", "relevance")


@query(G + ", known AS (SELECT * FROM placed WHERE area <> '__unknown__'), ve AS (SELECT * FROM calls WHERE src_id IN (SELECT id FROM known) AND dst_id IN (SELECT id FROM known)), firsts AS (SELECT CASE area WHEN '__unknown__' THEN 'unknown' ELSE area END AS area, min((file, name, id)) AS f FROM placed GROUP BY 1), regions AS (SELECT area, (row_number() OVER (ORDER BY f) - 1) % 5 AS region FROM firsts), n AS (SELECT id, area, (SELECT count(*) FROM ve WHERE dst_id = k.id) AS n_in, (SELECT count(*) FROM ve WHERE src_id = k.id) AS n_out FROM known k) SELECT id, n.area, region, n_in, n_out, n_in = 0 AND n_out > 0 AS is_entry FROM n JOIN regions USING (area)")
def viz_graph(spark, sf):
    return viz.viz_nodes(*graph_of(spark, sf), AREAS)


# What the search finds, and a step of the fill for each candidate in order.
_PACK = f"""WITH RECURSIVE e AS (SELECT 'v:' || vec_id AS src_id, 'v:' || ((vec_id + 1) % (SELECT count(*) FROM embeddings)) AS dst_id FROM embeddings),
b AS (SELECT * FROM e UNION SELECT dst_id, src_id FROM e),
hits AS (SELECT 'v:' || v.vec_id AS id, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, id LIMIT 20),
one AS (SELECT DISTINCT dst_id AS id FROM b WHERE src_id IN (SELECT id FROM hits)),
two AS (SELECT id FROM one UNION SELECT dst_id FROM b WHERE src_id IN (SELECT id FROM one)),
found AS (SELECT substr(id, 3) AS id, 0.6::DOUBLE * greatest(0, 1 - distance) + 0.4::DOUBLE AS score FROM hits UNION ALL SELECT substr(id, 3), 0.6::DOUBLE * 0 + 0.4::DOUBLE * 0.5::DOUBLE FROM two WHERE id NOT IN (SELECT id FROM hits)),
texts AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, substr(text, 1, 200) AS head, source || '::' || doc_id AS label FROM documents),
tiers AS (SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS ord, id, length(text) AS size, {", ".join(f"CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, length({c}) // 4) END AS {n}" for c, n in (("text", "n_full"), ("head", "n_head"), ("label", "n_label")))} FROM found JOIN texts USING (id)),
walk(ord, id, tier, tokens, used) AS (
  SELECT CAST(-1 AS BIGINT), '', '', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT t.ord, t.id, t.tier, t.tokens, w.used + t.tokens FROM walk w, LATERAL (
    SELECT x.ord, x.id, CASE WHEN 8000 - w.used <= 12 THEN NULL WHEN size > 0 AND n_full <= 8000 - w.used THEN 'full' WHEN n_head <= 8000 - w.used THEN 'signature' WHEN n_label <= 8000 - w.used THEN 'name' END AS tier,
      CAST(CASE WHEN 8000 - w.used <= 12 THEN 0 WHEN size > 0 AND n_full <= 8000 - w.used THEN n_full WHEN n_head <= 8000 - w.used THEN n_head WHEN n_label <= 8000 - w.used THEN n_label ELSE 0 END AS BIGINT) AS tokens
    FROM tiers x WHERE x.ord = w.ord + 1) t)
SELECT id, ord, tier, tokens FROM walk WHERE ord >= 0"""


@query(_PACK)
def context_pack(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("area"), F.col("text").alias("source"), F.substring("text", 1, 200).alias("signature"), F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("label"))
    u, e = vector_graph(spark, sf)
    found = vectors.hybrid(unit_vectors(spark, sf), u, e, first_vector(spark, sf), 20)
    found = found.select(F.substring("id", 3, 20).alias("id"), "similarity", (F.col("source") == "matched").alias("is_seed"))
    return context.fill(context.candidates(found, d))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority || '/' || o_orderkey || '.min.js', '(^|/)(1-URGENT)/') THEN true ELSE ends_with(o_orderpriority || '/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.min.js' ELSE '.js' END, '.min.js') END AS ignored FROM orders")
def ignore_rules(spark, sf):
    o = table(spark, sf, "orders")
    path = F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".min.js").otherwise(".js"))
    return o.select("o_orderkey", file_source.ignored(path, ("1-URGENT/", "*.min.js")).alias("ignored"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest(range(7)) AS k, date_trunc('day', ts) - INTERVAL 1 DAY * k AS start FROM events) GROUP BY 1, 2")
def stream_velocity(spark, sf):
    """The same plan a stream runs, over the table as a batch."""
    return velocity.event_velocity(table(spark, sf, "events"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf):
    return velocity.user_sessions(table(spark, sf, "events"))
