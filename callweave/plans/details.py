"""Registered queries of the smaller operators, each with its SQL: names, texts
and hashes of units, lookups, notes, changes, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import text
from ..operators import areas, confidence, context, drift, graph, intent, linking, notes, onboarding, reports, vectors, viz
from ..sources import git
from . import catalog
from .catalog import _CAPS, _DIST, _OWN, _PKG, NOW_S, G, captures, event_notes, external, first_vector, graph_of, line_authors, unit_vectors, vector_graph
from .fixtures import AREAS, edges, table, units

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# -------------------------------------------------------------- scalar columns


@query("SELECT p_partkey, replace(p_brand, '#', '') || '::' || p_name AS id, sha256(p_name || ':' || p_partkey || ':' || (p_partkey + p_size)) AS hash FROM part")
def unit_ids(spark, sf):
    p = table(spark, sf, "part").withColumn("file", F.translate("p_brand", "#", ""))
    return p.select("p_partkey", text.unit_id("file", "p_name").alias("id"), text.unit_hash("p_name", "p_partkey", F.col("p_partkey") + F.col("p_size")).alias("hash"))


@query("SELECT page_id, nullif(trim(split_part(html, chr(10), 1)), '') AS signature, substr(coalesce(nullif(html, ''), url, ''), 1, 200) AS summary FROM pages")
def unit_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.signature("html").alias("signature"), text.summary("html", "url").alias("summary"))


@query("SELECT p_partkey, substr(trim(p_name || ': ' || p_type || ' ' || CASE WHEN p_size > 20 THEN repeat(p_brand || ' ', 60) ELSE '' END), 1, 512) AS text FROM part")
def embedding_texts(spark, sf):
    p = table(spark, sf, "part").withColumn("doc", F.when(F.col("p_size") > 20, F.repeat(F.concat("p_brand", F.lit(" ")), 60)))
    return p.select("p_partkey", text.embedding_text("p_name", "p_type", "doc").alias("text"))


_KINDS = ("function.def", "class.def", "method.def", "import", "call", "name", "struct.def", "other")


@query(f"SELECT event_id, CASE list_extract({list(_KINDS)}, CAST(event_id % 8 + 1 AS INTEGER)) WHEN 'function.def' THEN 'function' WHEN 'method.def' THEN 'function' WHEN 'class.def' THEN 'class' WHEN 'struct.def' THEN 'class' END AS type FROM events")
def capture_types(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.unit_type(name).alias("type"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS span FROM documents")
def source_spans(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.source_span("text", F.lit(2), F.lit(3)).alias("span"))


@query(f"SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE greatest(({NOW_S} - CAST(floor(epoch(ts)) AS BIGINT)) / 3600.0::DOUBLE, 0.0::DOUBLE) END AS age FROM events")
def graph_age(spark, sf):
    iso = F.when(F.col("event_id") % 10 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf, "events").select("event_id", confidence.age_hours(iso, F.timestamp_seconds(F.lit(NOW_S))).alias("age"))


_REMARKS = """SELECT event_id, array_to_string(list_filter([
  CASE WHEN age > 1 THEN 'Graph is ' || age || 'h old' || CASE WHEN changed > 0 THEN '; ' || changed || ' unit(s) changed' ELSE '' END END,
  CASE WHEN changed > 0 THEN changed || ' unit(s) changed since the last build' END, CASE WHEN languages > 0 THEN languages || ' language(s) not indexed' END,
  CASE WHEN dynamic > 0 THEN dynamic || ' dynamic dispatch pattern(s)' END, CASE WHEN missing > 0 THEN missing || ' unit(s) that no test reaches' END], lambda x: x IS NOT NULL), '|') AS caveats,
  CASE WHEN age % 10 / 10 < 0.7::DOUBLE THEN CASE WHEN changed > 0 THEN 'update' ELSE 'build' END WHEN age > 24 THEN 'consider update' ELSE 'fresh' END AS advice
  FROM (SELECT event_id, event_id % 40 AS age, event_id % 3 AS changed, event_id % 5 AS languages, event_id % 2 AS dynamic, event_id % 7 AS missing FROM events)"""


@query(_REMARKS)
def confidence_remarks(spark, sf):
    n = lambda k: F.col("event_id") % k
    e = table(spark, sf, "events").select("event_id", n(40).alias("age"), n(3).alias("changed"), n(5).alias("languages"), n(2).alias("dynamic"), n(7).alias("missing")).withColumn("confidence", F.col("age") % 10 / 10)
    return e.select("event_id", F.array_join(confidence.caveats("age", "changed", "languages", "languages", "dynamic", "missing"), "|").alias("caveats"), confidence.recommendation("confidence", "age", "changed").alias("advice"))


# --------------------------------------------------------------------- lookups


@query(G + "SELECT id FROM g_units WHERE file ILIKE '%SUPPLY/N%' AND 12 BETWEEN line_start AND line_end ORDER BY file, line_start, id LIMIT 5")
def find_units(spark, sf):
    return sinks.find_units(units(spark, sf), file="SUPPLY/N", line=12).select("id")


@query(G + "SELECT id, count(*) OVER () AS matches FROM g_units WHERE name = 'ASIA' OR id LIKE '%::ASIA' ORDER BY file, line_start, id LIMIT 1")
def note_anchor(spark, sf):
    return notes.anchor(units(spark, sf), "ASIA").select("id", "matches")


@query(G + "SELECT id FROM g_units WHERE type <> 'module' AND file IN (SELECT 'catalog/' || replace(p_brand, '#', '') || '.py' FROM part WHERE p_partkey <= 5)")
def changed_units(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey <= 5").select(F.concat(F.lit("catalog/"), F.translate("p_brand", "#", ""), F.lit(".py")).alias("file"))
    return reports.units_of_files(units(spark, sf), p).select("id")


@query(G + _OWN + ", n AS (SELECT target AS id, count(*) AS callers FROM closure GROUP BY 1), s AS (SELECT id, primary_author, callers / authors AS silo_score FROM placed JOIN n USING (id) JOIN owned USING (id) WHERE line_start > 0 AND head = 'supply') SELECT id, silo_score FROM s WHERE silo_score >= 20 AND primary_author ILIKE '%KNOW%' ORDER BY silo_score DESC, id LIMIT 20")
def silo_top(spark, sf):
    s = reports.silos(*graph_of(spark, sf), line_authors(spark, sf))
    return reports.top(s, "silo_score", 20, area="SUPP", author="KNOW", label="critical").select("id", "silo_score")


@query(f"SELECT id, source FROM (WITH e AS (SELECT 'v:' || vec_id AS src_id, 'v:' || ((vec_id + 1) % (SELECT count(*) FROM embeddings)) AS dst_id FROM embeddings), b AS (SELECT * FROM e UNION SELECT dst_id, src_id FROM e), hits AS (SELECT 'v:' || v.vec_id AS id, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, id LIMIT 10), one AS (SELECT DISTINCT dst_id AS id FROM b WHERE src_id IN (SELECT id FROM hits)), two AS (SELECT id FROM one UNION SELECT dst_id FROM b WHERE src_id IN (SELECT id FROM one)) SELECT id, 'matched' AS source FROM hits UNION ALL SELECT id, 'neighbour' FROM two WHERE id NOT IN (SELECT id FROM hits)) JOIN embeddings ON id = 'v:' || vec_id WHERE label IN (1, 2)")
def search_in_area(spark, sf):
    u, e = vector_graph(spark, sf)
    found = vectors.hybrid(unit_vectors(spark, sf), u, e, first_vector(spark, sf), areas={"Low one": "l1", "LOW two": "l2", "other": "."}, area="low")
    return found.select("id", "source")


# ------------------------------------------------------------------- link, units


@query(G + _CAPS.replace("held AS", "imps AS (SELECT DISTINCT 'catalog/' || replace(p_brand, '#', '') || '.py' AS file, s_name AS callee FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), held AS") + ", mods AS (SELECT file, min_by(id, (line_start, id)) AS src_id FROM g_units WHERE type = 'module' GROUP BY 1), pick AS (SELECT i.callee, i.file, min_by(id, (u.file, line_start, id)) AS dst_id FROM imps i JOIN g_units u ON u.name = i.callee AND u.file <> i.file GROUP BY 1, 2) SELECT src_id, dst_id, 'IMPORT' AS rel_type, min(file) AS file FROM pick JOIN mods USING (file) GROUP BY 1, 2")
def link_import(spark, sf):
    """Each line item's supplier as an import in its part's file."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    imports = li.select(F.lit("import").alias("capture_name"), F.concat(F.lit("from x import "), "s_name").alias("text"), F.concat(F.lit("catalog/"), F.translate("p_brand", "#", ""), F.lit(".py")).alias("file"), F.lit(1).cast("long").alias("line")).distinct()
    e = linking.import_edges(imports, units(spark, sf))
    return e.groupBy("src_id", "dst_id", "rel_type").agg(F.min("file").alias("file"))


@query("SELECT l_orderkey AS id, min(l_linenumber) AS line_start, 'f' || (l_orderkey % 3) AS file FROM lineitem GROUP BY 1")
def dedupe_units(spark, sf):
    u = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line_start"), F.concat(F.lit("f"), (F.col("l_orderkey") % 3).cast("string")).alias("file"), "l_quantity")
    return linking.dedupe_units(u).select("id", "line_start", "file")


@query(G + _CAPS + ", m AS (SELECT first_id AS src_id, h.file, line, callee, min_by(id, (line_start, id)) AS dst_id FROM held h JOIN g_units u ON u.name = callee AND u.file = h.file GROUP BY 1, 2, 3, 4) SELECT src_id, dst_id, min(file) AS file FROM m GROUP BY 1, 2")
def update_relinks(spark, sf):
    """An update of some files by what they are already: the edges of a build."""
    u, c = units(spark, sf), captures(spark, sf)
    files = u.filter(F.col("file").like("catalog/%1.py")).select("file", F.lit("M").alias("status")).distinct()
    own = lambda df: df.join(files.select("file"), "file", "left_semi").select(df.columns)
    e = drift.update(u, c, files, own(u), own(c))[2]
    return e.filter("rel_type = 'LOCAL_CALL'").select("src_id", "dst_id", "file")


_GONE = ", gone AS (SELECT id FROM g_units WHERE file = 'geo/nation.py')"


@query(G + _GONE + " SELECT id AS key FROM g_units WHERE file <> 'geo/nation.py' UNION ALL SELECT src_id || '>' || dst_id || rel_type FROM g_edges WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone)")
def delete_files(spark, sf):
    u, e = graph_of(spark, sf)
    kept, rest = drift.delete_files(u, e.withColumn("file", F.lit("any")), u.filter("file = 'geo/nation.py'").select("file").distinct())
    return kept.select(F.col("id").alias("key")).union(rest.select(F.concat("src_id", F.lit(">"), "dst_id", "rel_type")))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN vec_id + 100000 ELSE label END AS label FROM embeddings UNION ALL SELECT -1, 7")
def upsert_rows(spark, sf):
    old = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    new = old.filter("vec_id % 3 = 0").select("vec_id", (F.col("vec_id") + 100000).alias("label")).union(spark.createDataFrame([(-1, 7)], "vec_id long, label long"))
    return drift.upsert(old, new, ["vec_id"])


# --------------------------------------------------------------------- changes

_NAME_STATUS = "WITH c AS (SELECT o_orderkey * 2 AS ord, o_orderpriority AS file, CASE WHEN o_orderkey % 4 = 0 THEN 'D' ELSE list_extract(['M', 'A', 'M'], CAST(o_orderkey % 3 + 1 AS INTEGER)) END AS status FROM orders UNION ALL SELECT o_orderkey * 2 + 1, 'new/' || o_orderpriority, 'A' FROM orders WHERE o_orderkey % 4 = 0)"


def status_lines(spark, sf):
    """An order as a change of its clerk's file: a rename, or one of a kind."""
    kind = F.element_at(F.array(F.lit("M"), F.lit("A"), F.lit("M")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    line = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("R090\t"), "o_orderpriority", F.lit("\tnew/"), "o_orderpriority")).otherwise(F.concat(kind, F.lit("\t"), "o_orderpriority"))
    return table(spark, sf, "orders").select(line.alias("line"), F.col("o_orderkey").cast("long").alias("ord"))


@query(_NAME_STATUS + " SELECT file, status, ord FROM c")
def name_status(spark, sf):
    return drift.name_status(status_lines(spark, sf))


@query(_NAME_STATUS + " SELECT file, max_by(status, ord) AS status FROM c GROUP BY 1")
def last_status(spark, sf):
    return drift.last_status(drift.name_status(status_lines(spark, sf)))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'moved.py' ELSE o_orderpriority END AS file, list_extract(['M', 'A', 'D', 'A', 'M'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS status FROM orders")
def status_files(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ("RM", "A ", " D", "??", " M"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    row = F.concat(code, F.lit(" "), "o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, " -> moved.py").otherwise(""))
    return git.status_files(table(spark, sf, "orders").select(row.alias("text")))


@query("SELECT file, CAST(min(k) AS BIGINT) AS ord FROM (SELECT n_name || '.py' AS file, 1 AS k FROM nation UNION ALL SELECT r_name || '/x', 3 FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def diff_files(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return git.diff_files(n.select(F.concat(F.lit("--- a/x\n+++ b/"), "n_name", F.lit(".py\n+ y\n+++ b/"), "r_name", F.lit("/x\n+++ c/z")).alias("text")))


@query("SELECT c_mktsegment || '.py' AS file, CAST(c_custkey AS INTEGER) AS line, 'n' || c_nationkey || '@x' AS author FROM customer")
def blame_lines(spark, sf):
    """A segment's file, a line a customer; a nation is a commit, which names
    its author at its first line only."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("n"))
    first = c.groupBy("seg", "n").agg(F.min("k").alias("k"), F.lit(True).alias("first"))
    rows = c.join(first, ["seg", "n", "k"], "left")
    mail = F.when(F.col("first"), F.concat(F.lit("\nauthor x\nauthor-mail <n"), "n", F.lit("@x>"))).otherwise("")
    line = F.concat(F.sha1("n"), F.lit(" 1 "), F.col("k").cast("string"), mail, F.lit("\n\tauthor-mail <code>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("row")))), lambda r: r["row"]), "\n")
    return git.blame(rows.groupBy(F.concat("seg", F.lit(".py")).alias("file")).agg(body.alias("text")))


@query("SELECT o_orderpriority || '.py' AS file, CAST(o_orderkey AS BIGINT) AS at FROM orders UNION ALL SELECT 'all.py', o_orderkey FROM orders")
def commit_files(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("\x01"), F.col("o_orderkey").cast("string"), F.lit("\n\n"), "o_orderpriority", F.lit(".py\nall.py\n")).alias("text"))
    return git.log_commits(o).select("file", F.unix_timestamp("ts").alias("at"))


@query("SELECT CASE WHEN count(*) FILTER (p_partkey % 11 = 0 OR p_partkey % 13 = 0) > 0 THEN 'structural' ELSE 'minor' END AS drift FROM part")
def drift_verdict(spark, sf):
    return drift.verdict(catalog.QUERIES["drift_classes"](spark, sf))


# ----------------------------------------------------------------------- notes

_EN = "(SELECT CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS unit_id, event_type AS area, CAST(floor(epoch(ts)) AS BIGINT) AS created_ts, CASE WHEN value < 20 THEN 'stale' ELSE 'active' END AS status FROM events)"


@query(f"SELECT unit_id AS id, array_to_string(list(id ORDER BY created_ts DESC, id DESC), ',') AS ids FROM {_EN} GROUP BY 1")
def notes_of_units(spark, sf):
    n = event_notes(spark, sf).withColumn("title", F.col("id"))
    u = n.select(F.col("unit_id").alias("id")).distinct()
    return notes.attach(u, n).select("id", F.array_join(F.transform("notes", lambda x: x["id"]), ",").alias("ids"))


@query(f"SELECT id FROM {_EN} WHERE CAST(id AS BIGINT) % 3 <> 0")
def notes_without(spark, sf):
    n = event_notes(spark, sf)
    return notes.without(n, n.filter("cast(id as bigint) % 3 = 0").select("id")).select("id")


@query("SELECT o_custkey || '' AS from_id, o_orderkey % 97 || '' AS to_id, max(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END) AS created_ts FROM orders GROUP BY 1, 2")
def note_edge_upsert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("from_id"), (F.col("o_orderkey") % 97).cast("string").alias("to_id"), F.lit("caused").alias("rel_type"), "o_orderkey")
    row = lambda df, at: df.select("from_id", "to_id", "rel_type", F.lit(at).alias("created_ts"), F.lit("me").alias("author"))
    old = row(o.filter("o_orderkey % 2 = 1"), 1).distinct()
    return notes.upsert_edges(old, row(o.filter("o_orderkey % 2 = 0"), 2)).select("from_id", "to_id", "created_ts")


@query(G + _PKG + ", entry AS (SELECT id FROM placed WHERE id NOT IN (SELECT dst_id FROM g_edges WHERE rel_type NOT IN ('RUNTIME_BOUNDARY', 'IMPORT'))) SELECT sha256('vuln|pkg|' || id || '|5') AS id, id AS unit_id, 'Calls ' || dst || ' of pkg. ' || CASE WHEN id IN (SELECT id FROM entry) AND head <> 'tests' THEN 'An entry: input from outside reaches this call.' ELSE 'Called from inside; follow its callers to the entries.' END AS body FROM pkg JOIN placed USING (id)")
def package_notes(spark, sf):
    u, e = units(spark, sf), external(spark, sf)
    direct = reports.package_callers(u, e, "pkg")
    return notes.from_package(direct, reports.exposure(u, e, direct, depth=2), "pkg", 5).select("id", "unit_id", "body")


@query(G + _OWN + ", n AS (SELECT target AS id, count(*) AS callers FROM closure GROUP BY 1), s AS (SELECT id, head, callers / authors AS score FROM placed JOIN n USING (id) JOIN owned USING (id) WHERE line_start > 0) SELECT sha256('silo|' || id || '|7') AS id, id AS unit_id, head AS area, 'silo: ' || id AS title FROM s WHERE score >= 8")
def silo_notes(spark, sf):
    s = reports.silos(*graph_of(spark, sf), line_authors(spark, sf))
    return notes.from_report(s, "silo", "silo_score", 7).select("id", "unit_id", "area", "title")


@query(f"SELECT CAST(CASE area WHEN 'error' THEN 0 ELSE 1 END AS INTEGER) AS rank, id FROM {_EN} WHERE status <> 'stale' AND area IN ('error', 'click')")
def things_to_know(spark, sf):
    n = event_notes(spark, sf).withColumns({"type": F.when(F.col("area") == "error", "warning").when(F.col("area") == "click", "decision").otherwise("context"), "title": F.col("id")})
    return onboarding.things_to_know(n).select("rank", "id")


@query(f"SELECT id, '### ' || unit_id || chr(10) || chr(10) || area || chr(10) || chr(10) || '- type: context' || chr(10) || '- tags: a, ' || area || chr(10) AS text FROM {_EN}")
def notes_markdown(spark, sf):
    n = event_notes(spark, sf).withColumns({"title": F.col("unit_id"), "body": F.col("area"), "tags": F.array(F.lit("a"), F.col("area"))})
    return notes.to_markdown(n)


# ---------------------------------------------------------------------- intent

_INCIDENTS = [("1", "slow", "high", "open", ["BUILDING"]), ("2", "gone", "low", "closed", ["BUILDING", "MACHINERY"]), ("3", "odd", "low", "open", ["MACHINERY", "nowhere"])]


def intents(spark):
    return spark.createDataFrame([("s1", "ship", ["BUILDING"], ["elsewhere"], _INCIDENTS, ["globals"], ["small"], ["MACHINERY is late"])], intent.SCHEMA)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '3' ELSE '' END AS incidents, CASE c_mktsegment WHEN 'MACHINERY' THEN 'MACHINERY is late' END AS concern, 'AVOID: globals|PRINCIPLE: small' AS guidance FROM customer")
def open_incidents(spark, sf):
    rows = intent.enrich(table(spark, sf, "customer").select("c_custkey", F.array("c_mktsegment").alias("areas")), intents(spark))
    return rows.select("c_custkey", F.array_join(F.transform("open_incidents", lambda i: i["id"]), ",").alias("incidents"), "concern", F.array_join("guidance", "|").alias("guidance"))


@query("SELECT area FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'elsewhere', 'nowhere']) AS area) WHERE area NOT IN (SELECT c_mktsegment FROM customer)")
def unknown_areas(spark, sf):
    known = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().collect()]  # segments
    return intent.unknown_areas(intents(spark), known)


# --------------------------------------------------------------------- exports


@query(G + "SELECT list_sort(list(DISTINCT area)) AS areas FROM placed WHERE area <> '__unknown__'")
def affected_areas(spark, sf):
    return vectors.affected_areas(units(spark, sf).select(areas.relative("file", AREAS).alias("area")))


_CALLS = ", n AS (SELECT u.id, (SELECT count(*) FROM calls WHERE dst_id = u.id) AS calls_in, (SELECT count(*) FROM calls WHERE src_id = u.id) AS calls_out FROM g_units u)"


@query(G + _CALLS + " SELECT 'geo' AS area, '# geo' || chr(10) || chr(10) || '| unit | type | file | in | out | summary |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || string_agg('| ' || name || ' | ' || type || ' | ' || file || ' | ' || calls_in || ' | ' || calls_out || ' | ' || substr(name, 1, 80) || ' |', chr(10) ORDER BY file, line_start, name) AS text FROM g_units JOIN n USING (id) WHERE file LIKE 'geo/%'")
def area_documents(spark, sf):
    u = units(spark, sf).withColumns({"signature": F.col("name"), "docstring": F.lit("")})
    return sinks.area_documents(u, edges(spark, sf), spark.createDataFrame([("geo", "geo/")], "name string, path string"))


@query(G + "SELECT 'state: abc' || chr(10) || chr(10) || '| area | units |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || head || ' | ' || n || ' |', chr(10) ORDER BY head) AS text FROM (SELECT head, count(*) AS n FROM placed WHERE head IN ('geo', 'crm') GROUP BY 1)")
def area_map(spark, sf):
    return sinks.area_map(units(spark, sf), spark.createDataFrame([("geo", "geo/"), ("crm", "crm")], "name string, path string"), "abc")


@query("SELECT id, CASE WHEN i > 0 AND o > 0 THEN 'both' WHEN o > 0 THEN 'source' WHEN i > 0 THEN 'sink' ELSE 'none' END AS colour FROM (SELECT event_id AS id, event_id % 2 AS i, event_id % 3 AS o FROM events)")
def flow_colours(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 2).alias("i"), (F.col("event_id") % 3).alias("o"))
    return e.select("id", viz.flow_colour("i", "o").alias("colour"))


@query(G + catalog._RISK + f", r AS (SELECT *, {catalog._LABEL} AS label FROM risk) SELECT target, '| ' || target || ' | ' || label || ' | ' || printf('%.2f', risk) || ' | ' || direct || ' | ' || tests || ' |' AS line FROM r ORDER BY risk DESC, target LIMIT 20")
def risk_comment(spark, sf):
    return sinks.risk_comment(reports.closure_risk(*graph_of(spark, sf)))


@query("SELECT doc_id AS ord, '<unit id=\"' || replace(replace(replace(replace(source || '&\"<' || doc_id, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '\" tier=\"full\" tokens=\"' || n_chars || '\"/>' AS xml, '- `' || source || '&\"<' || doc_id || '` (full, ' || n_chars || ' tokens)' AS line FROM documents")
def context_exports(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("source", F.lit('&"<'), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("ord"), F.lit("full").alias("tier"), F.col("n_chars").alias("tokens"))
    return context.export_xml(d).join(sinks.context_markdown(d), "ord")


@query(catalog._DAILY + " SELECT build_ts, '| ' || build_ts || ' | ' || printf('%.4f', unit_count / 1000) || ' |' AS line FROM s")
def health_table(spark, sf):
    s = catalog.daily(spark, sf).withColumn("coupling", F.col("unit_count") / 1000)
    return sinks.health_table(s, ["coupling"])


@query(G + ", cut AS (SELECT id FROM g_units WHERE file LIKE 'supply/%') SELECT src_id AS caller, dst_id AS target FROM g_edges WHERE rel_type = 'RUNTIME_BOUNDARY' AND dst_id IN (SELECT id FROM cut)")
def boundary_callers(spark, sf):
    u, e = graph_of(spark, sf)
    return graph.boundary_callers(e, u.filter("file like 'supply/%'"))


