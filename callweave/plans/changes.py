"""Registered queries of parsing, updates and large closures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import store
from ..lineage import scratch
from ..operators import closures, linking, relink, reports
from ..sources import coverage, parse
from .catalog import _CAPS, G, captures, graph_of
from .fixtures import table, units

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ closures


@query(G + ", up AS (SELECT dst_id AS root, src_id AS id FROM adj UNION SELECT u.root, a.src_id FROM up u JOIN adj a ON a.dst_id = u.id) SELECT g.id, count(up.id) AS n FROM g_units g LEFT JOIN up ON up.root = g.id AND up.id <> g.id GROUP BY 1")
def transitive_all(spark, sf):
    return closures.all_transitive_callers(*graph_of(spark, sf))


@query(G + ", up AS (SELECT dst_id AS root, src_id AS id FROM adj WHERE src_id <> dst_id UNION SELECT u.root, a.src_id FROM up u JOIN adj a ON a.dst_id = u.id) SELECT a.root AS id, max(b.id) AS last, count(DISTINCT b.id) AS n FROM up a JOIN up b ON b.root = a.root AND b.id IN (SELECT x.id FROM up x WHERE x.root = a.root) AND EXISTS (SELECT 1 FROM up y WHERE y.root = b.id AND y.id = a.root) WHERE a.id = a.root GROUP BY 1")
def call_cycles(spark, sf):
    """Of each unit on a cycle the last unit of its component, and its size."""
    u, e = graph_of(spark, sf)
    found = closures.cycles(closures.graph.adjacency(u, e))
    size = found.groupBy("root").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    return found.join(size, "root").select("id", "last", "n")


@query(G + ", n AS (SELECT target, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth = 2) AS indirect FROM closure GROUP BY 1), t AS (SELECT w.target, count(DISTINCT test) AS tests FROM with_target w JOIN test_edges USING (id) GROUP BY 1) SELECT target, direct, indirect, spread, coalesce(tests, 0) AS tests FROM n JOIN spread USING (target) LEFT JOIN t USING (target) WHERE target IN (SELECT id FROM g_units WHERE file LIKE 'geo/%')")
def closure_sets(spark, sf):
    """Callers, areas and tests of the units that most is above, as sets."""
    u, e = graph_of(spark, sf)
    found = closures.Closures(u, e, u.filter(F.col("file").like("geo/%")), hub=16)
    out = found.counts().join(found.spread(), "target").join(found.tests(), "target", "left").na.fill(0, ["tests"])
    return out.select("target", "direct", "indirect", "spread", "tests")


@query(G + ", own AS (SELECT caller AS id FROM closure WHERE target = 'n:3'), walk AS (SELECT 'n:3' AS id, 0 AS d UNION SELECT a.src_id, w.d + 1 FROM walk w JOIN adj a ON a.dst_id = w.id WHERE a.src_id IN (SELECT id FROM own)), ids AS (SELECT id, max(d) AS layer FROM walk WHERE d > 0 GROUP BY 1), steps AS (SELECT p.file, 0 AS last, min(layer) AS layer, list_sort(list(id)) AS ids FROM ids JOIN placed p USING (id) GROUP BY 1 UNION ALL SELECT 'geo/nation.py', 1, NULL, ['n:3']) SELECT row_number() OVER (ORDER BY last, layer, file) AS step, file, ids FROM steps")
def refactor_layers(spark, sf):
    """Callers in three layers: some call what calls the target, some that too."""
    u, e = graph_of(spark, sf)
    return reports.refactor_sequence(u, e, u.filter("id = 'n:3'"))


# ------------------------------------------------------------------- updates

_EDITED = ", units2 AS (SELECT id, CASE WHEN file = 'supply/n4.py' THEN name || ' II' ELSE name END AS name, file, line_start FROM g_units WHERE file <> 'supply/n3.py')"
_LINKED = _EDITED + """, loc AS (SELECT first_id AS src_id, h.file, line, callee, min_by(id, (line_start, id)) AS dst_id FROM held h JOIN units2 u ON u.name = callee AND u.file = h.file GROUP BY 1, 2, 3, 4),
names AS (SELECT DISTINCT callee, file FROM held), pick AS (SELECT n.callee, n.file, min_by(id, (u.file, line_start, id)) AS dst_id FROM names n JOIN units2 u ON u.name = n.callee AND u.file <> n.file GROUP BY 1, 2)
SELECT src_id, dst_id, 'LOCAL_CALL' AS rel_type, min(file) AS file FROM loc GROUP BY 1, 2
UNION ALL SELECT first_id, dst_id, 'EXTERNAL_CALL', min(file) FROM held JOIN pick USING (callee, file) GROUP BY 1, 2
UNION ALL SELECT first_id, 'external::' || callee, 'RUNTIME_BOUNDARY', min(file) FROM held WHERE callee NOT IN (SELECT name FROM units2) GROUP BY 1, 2"""


@query(G + _CAPS + _LINKED)
def update_edges(spark, sf):
    """A file of callees goes, and those of another get new names: edges after an
    update that links anew what these names touch."""
    u, c = units(spark, sf), relink.with_names(captures(spark, sf))
    changes = spark.createDataFrame([("supply/n3.py", "D"), ("supply/n4.py", "M")], "file string, status string")
    new = u.filter("file = 'supply/n4.py'").withColumn("name", F.concat("name", F.lit(" II")))
    e = relink.update(u, c, linking.link_named(c, u), changes, new, c.limit(0).drop("called", "imported"))[2]
    return e.drop("callee")


_BUCKET = "CAST(('0x' || substr(md5(file), 1, 8)) AS BIGINT) % 4"


@query(G + f", b AS (SELECT DISTINCT {_BUCKET} AS b, max(CASE WHEN file = 'geo/nation.py' THEN 1 ELSE 0 END) OVER (PARTITION BY {_BUCKET}) AS own FROM g_units) SELECT t.name AS tbl, count(*) AS parts, count(*) FILTER (own = 0) AS reused FROM b, (VALUES ('units'), ('file_hashes')) t(name) GROUP BY 1")
def update_parts(spark, sf):
    """An index of units and files, one file of which changes: parts of the new
    snapshot, and those of the old one that it names again."""
    s, u = store.Store(spark, scratch(spark)), units(spark, sf)
    text = F.lit(None).cast("string")
    u = u.select("id", "name", "file", "type", F.col("line_start").cast("int"), F.col("line_end").cast("int"), text.alias("signature"), text.alias("docstring"), text.alias("hash"))
    hashes = u.groupBy("file").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("name"))), 256).alias("hash"))
    s.publish({"units": u, "file_hashes": hashes})
    before = s.manifest()["tables"]
    own = s.buckets_of(spark.createDataFrame([("geo/nation.py",)], "file string"))
    kept = s.read("units", own).withColumn("name", F.when(F.col("file") == "geo/nation.py", F.upper("name")).otherwise(F.col("name")))
    s.publish({"units": kept, "file_hashes": s.read("file_hashes", own)}, buckets={"units": own, "file_hashes": own})
    after = s.manifest()["tables"]
    rows = [(t, len(after[t]), len(set(after[t].values()) & set(before[t].values()))) for t in ("units", "file_hashes")]
    return spark.createDataFrame(rows, "tbl string, parts long, reused long")


# ------------------------------------------------------------------- parsing


def supplier_files(spark, sf):
    """A Python file for each supplier; every tenth can't be parsed."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("import os\n\nclass C"), k, F.lit(':\n    """Of '), F.col("s_name"), F.lit('."""\n\ndef f'), k, F.lit('(x, y=1):\n    """Says "'), k, F.lit('".\n    """\n    return os.path.join(g'), (F.col("s_suppkey") + 1).cast("string"), F.lit("(x), y)\n"))
    broken = F.concat(F.lit("def f"), k, F.lit("(x):\n    print 'x'\n    return h(x)\n"))
    content = F.when(F.col("s_suppkey") % 10 == 0, broken).otherwise(body)
    return table(spark, sf, "supplier").select(F.concat(F.lit("pkg/m"), k, F.lit(".py")).alias("file"), content.alias("content"))


_FILES = "WITH s AS (SELECT s_suppkey AS k, 'pkg/m' || s_suppkey || '.py' AS file, s_name, s_suppkey % 10 = 0 AS broken FROM supplier)"


@query(_FILES + """ SELECT file || '::m' || k AS id, 'm' || k AS name, 'module' AS type, 1 AS line_start, CASE WHEN broken THEN 4 ELSE 10 END AS line_end, NULL AS signature, NULL AS docstring FROM s
UNION ALL SELECT file || '::C' || k, 'C' || k, 'class', 3, 4, NULL, 'Of ' || s_name || '.' FROM s WHERE NOT broken
UNION ALL SELECT file || '::f' || k, 'f' || k, 'function', 6, 9, 'def f' || k || '(x, y=1):', 'Says "' || k || '".' || chr(10) || '    ' FROM s WHERE NOT broken
UNION ALL SELECT file || '::f' || k, 'f' || k, 'function', 1, 3, 'def f' || k || '(x):', NULL FROM s WHERE broken""")
def parsed_units(spark, sf):
    u = parse.units_of(parse.parse(supplier_files(spark, sf)))
    return u.select("id", "name", "type", "line_start", "line_end", "signature", "docstring")


@query(_FILES + """ SELECT file, 'import' AS capture_name, 'import os' AS text, 1 AS line FROM s WHERE NOT broken
UNION ALL SELECT file, 'call', 'os.path.join', 9 FROM s WHERE NOT broken
UNION ALL SELECT file, 'call', 'g' || (k + 1), 9 FROM s WHERE NOT broken
UNION ALL SELECT file, 'call', 'h', 3 FROM s WHERE broken
UNION ALL SELECT file, 'warning', '', 0 FROM s WHERE broken""")
def parsed_captures(spark, sf):
    """Captures, and that a file has a warning."""
    parsed = parse.parse(supplier_files(spark, sf))
    found = parse.captures_of(parsed).select("file", "capture_name", "text", "line")
    return found.union(parsed.filter("kind = 'warning'").select("file", "kind", F.lit(""), F.lit(0)))


@query("SELECT 'r' || p_partkey || '/pyproject.toml' AS file, 0 AS kind, 0 AS ord, lower(replace(p_brand, '#', '-')) AS name, '>=' || p_size || ',<99' AS spec FROM part UNION ALL SELECT 'r' || p_partkey || '/pyproject.toml', 1, 1, 'extra.x', '^' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey || '/requirements.txt', 2, 0, 'lib_' || s_nationkey, '== 1.' || s_suppkey FROM supplier")
def manifest_dependencies(spark, sf):
    toml = F.concat(F.lit('[project]\nname = "x"\ndependencies = [\n  "'), F.lower(F.translate("p_brand", "#", "-")), F.lit(">="), F.col("p_size").cast("string"), F.lit(',<99",\n]\n[tool.poetry.dependencies]\n"extra.x" = {version = "^'), F.col("p_partkey").cast("string"), F.lit('"}\n'))
    p = table(spark, sf, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string"), F.lit("/pyproject.toml")).alias("file"), toml.alias("content"))
    lines = F.concat(F.lit("# all\nlib_"), F.col("s_nationkey").cast("string"), F.lit(" == 1."), F.col("s_suppkey").cast("string"), F.lit("\n"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/requirements.txt")).alias("file"), lines.alias("content"))
    return coverage.dependencies(p.union(s))
