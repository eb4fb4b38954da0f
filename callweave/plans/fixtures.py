"""Views that read the star-schema tables as a code graph, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import bounded_tasks, cut
from ..schema import BOUNDARY, EXTERNAL, IMPORT, LOCAL

#: Areas of the fixture graph; files under tests/ are in none.
AREAS = {"geo": "geo/", "supply": "supply/", "catalog": "catalog/", "crm": "crm/"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    bounded_tasks(spark, path)
    return spark.read.parquet(path)


_index: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names and times of what a folder holds."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return tuple(sorted((s.getPath().getName(), s.getModificationTime()) for s in found))


def indexed(make):
    """The view as an index holds it: written once a session, then read, as long
    as the tables are the same."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__, _state(spark, sf_dir))
        if key not in _index:
            _index[key] = cut(make(spark, sf_dir))
        return _index[key]

    return read


@indexed
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name, prefix, key, label, file, kind, start, end):
        k = F.concat(F.lit(prefix), F.col(key).cast("string"))
        t = table(spark, sf_dir, name)
        return t.select(k.alias("id"), F.col(label).alias("name"), file.alias("file"), kind.alias("type"), start.cast("long").alias("line_start"), end.cast("long").alias("line_end"))

    brand = F.translate("p_brand", "#", "")
    out = rows("region", "r:", "r_regionkey", "r_name", F.lit("geo/region.py"), F.lit("class"), F.col("r_regionkey") + 1, F.col("r_regionkey") + 1)
    out = out.union(rows("nation", "n:", "n_nationkey", "n_name", F.lit("geo/nation.py"), F.lit("function"), F.col("n_nationkey") + 1, F.col("n_nationkey") + 1))
    out = out.union(rows("supplier", "s:", "s_suppkey", "s_name", F.concat(F.lit("supply/n"), F.col("s_nationkey").cast("string"), F.lit(".py")), F.lit("function"), F.col("s_suppkey"), F.col("s_suppkey") + 9))
    part_file = F.concat(F.when(F.col("p_size") <= 5, "tests/test_").otherwise("catalog/"), brand, F.lit(".py"))
    out = out.union(rows("part", "p:", "p_partkey", "p_name", part_file, F.lit("function"), F.col("p_partkey"), F.col("p_partkey") + F.col("p_size")))
    out = out.union(rows("customer", "c:", "c_custkey", "c_name", F.concat(F.lit("crm/"), F.col("c_mktsegment"), F.lit(".py")), F.lit("function"), F.col("c_custkey"), F.col("c_custkey") + 4))
    brands = table(spark, sf_dir, "part").select(brand.alias("b")).distinct()
    return out.union(brands.select(F.concat(F.lit("m:"), "b"), F.col("b"), F.concat(F.lit("catalog/"), "b", F.lit(".py")), F.lit("module"), F.lit(1).cast("long"), F.lit(100000).cast("long")))


@indexed
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def key(prefix, c):
        return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))

    kind = F.when(F.col("l_returnflag") == "A", LOCAL).when(F.col("l_returnflag") == "N", EXTERNAL).otherwise(BOUNDARY)
    out = table(spark, sf_dir, "lineitem").select(key("p:", "l_partkey").alias("src_id"), key("s:", "l_suppkey").alias("dst_id"), kind.alias("rel_type")).distinct()
    out = out.union(table(spark, sf_dir, "supplier").select(key("s:", "s_suppkey"), key("n:", "s_nationkey"), F.lit(EXTERNAL)))
    out = out.union(table(spark, sf_dir, "customer").select(key("c:", "c_custkey"), key("n:", "c_nationkey"), F.lit(EXTERNAL)))
    n = table(spark, sf_dir, "nation")
    out = out.union(n.select(key("n:", "n_nationkey"), key("r:", "n_regionkey"), F.lit(IMPORT)))
    return out.union(n.select(key("n:", "n_nationkey"), key("n:", (F.col("n_nationkey") + 5) % 25), F.lit(LOCAL)))


SQL = """WITH RECURSIVE g_units AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS name, 'geo/region.py' AS file, 'class' AS type, CAST(r_regionkey + 1 AS BIGINT) AS line_start, CAST(r_regionkey + 1 AS BIGINT) AS line_end FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'geo/nation.py', 'function', CAST(n_nationkey + 1 AS BIGINT), CAST(n_nationkey + 1 AS BIGINT) FROM nation
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'supply/n' || s_nationkey || '.py', 'function', CAST(s_suppkey AS BIGINT), CAST(s_suppkey + 9 AS BIGINT) FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, p_name, CASE WHEN p_size <= 5 THEN 'tests/test_' ELSE 'catalog/' END || replace(p_brand, '#', '') || '.py', 'function', CAST(p_partkey AS BIGINT), CAST(p_partkey + p_size AS BIGINT) FROM part
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'crm/' || c_mktsegment || '.py', 'function', CAST(c_custkey AS BIGINT), CAST(c_custkey + 4 AS BIGINT) FROM customer
  UNION ALL SELECT DISTINCT 'm:' || replace(p_brand, '#', ''), replace(p_brand, '#', ''), 'catalog/' || replace(p_brand, '#', '') || '.py', 'module', CAST(1 AS BIGINT), CAST(100000 AS BIGINT) FROM part
), g_edges AS (
  SELECT DISTINCT 'p:' || l_partkey AS src_id, 's:' || l_suppkey AS dst_id, CASE l_returnflag WHEN 'A' THEN 'LOCAL_CALL' WHEN 'N' THEN 'EXTERNAL_CALL' ELSE 'RUNTIME_BOUNDARY' END AS rel_type FROM lineitem
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'EXTERNAL_CALL' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'EXTERNAL_CALL' FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'IMPORT' FROM nation
  UNION ALL SELECT 'n:' || n_nationkey, 'n:' || ((n_nationkey + 5) % 25), 'LOCAL_CALL' FROM nation
), valid AS (
  SELECT * FROM g_edges WHERE rel_type <> 'RUNTIME_BOUNDARY' AND src_id IN (SELECT id FROM g_units) AND dst_id IN (SELECT id FROM g_units)
), calls AS (SELECT * FROM g_edges WHERE rel_type <> 'RUNTIME_BOUNDARY'),
adj AS (SELECT DISTINCT src_id, dst_id FROM valid),
placed AS (SELECT *, CASE WHEN file LIKE 'geo/%' THEN 'geo' WHEN file LIKE 'supply/%' THEN 'supply' WHEN file LIKE 'catalog/%' THEN 'catalog' WHEN file LIKE 'crm/%' THEN 'crm' ELSE '__unknown__' END AS area,
  CASE WHEN instr(file, '/') > 0 THEN substr(file, 1, instr(file, '/') - 1) ELSE file END AS head FROM g_units),
deg AS (SELECT u.id, count(DISTINCT o.dst_id) AS n_out, (SELECT count(*) FROM adj i WHERE i.dst_id = u.id) AS n_in FROM g_units u LEFT JOIN adj o ON o.src_id = u.id GROUP BY u.id),
d1 AS (SELECT DISTINCT dst_id AS target, src_id AS caller FROM calls),
closure AS (
  SELECT target, caller, CAST(min(depth) AS INTEGER) AS depth FROM (
    SELECT target, caller, 1 AS depth FROM d1 UNION ALL
    SELECT a.target, b.caller, 2 FROM d1 a JOIN d1 b ON b.target = a.caller WHERE a.target <> a.caller
  ) WHERE target <> caller AND caller IN (SELECT id FROM g_units) GROUP BY 1, 2
), with_target AS (SELECT target, caller AS id FROM closure UNION ALL SELECT id, id FROM g_units),
test_edges AS (SELECT DISTINCT dst_id AS id, src_id AS test FROM g_edges WHERE src_id IN (SELECT id FROM g_units WHERE file ILIKE 'tests/%')),
spread AS (SELECT target, count(DISTINCT head) AS spread FROM with_target JOIN placed USING (id) GROUP BY 1)
"""
