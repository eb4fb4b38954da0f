"""Registered queries of trees that tasks list and of the learned embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import scratch
from ..operators import semantic, vectors
from ..sources import files, trees
from .fixtures import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT 's_nationkey=' || s_nationkey AS folder, count(*) AS lines, CAST(sum(length(s_name) + 1) AS BIGINT) AS bytes FROM supplier WHERE s_nationkey <> 7 GROUP BY 1")
def listed_tree(spark, sf):
    """A tree of a folder a nation, one of them ignored, listed and read by tasks."""
    root = scratch(spark)
    table(spark, sf, "supplier").select("s_nationkey", "s_name").repartition(4, "s_nationkey").write.partitionBy("s_nationkey").text(root)
    listed = trees.list_tree(spark, root, ("s_nationkey=7/",), step=2)
    wanted = listed.filter(files.extension(F.col("file")).isin(".txt"))
    text = trees.read_files(root, wanted).select(F.substring_index("file", "/", 1).alias("folder"), F.decode("content", "UTF-8").alias("text"))
    return text.groupBy("folder").agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')) AS w FROM documents)
SELECT CAST(CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {semantic.FEATURES} AS INTEGER) AS feature, count(DISTINCT doc_id) AS df FROM w GROUP BY 1""")
def feature_frequency(spark, sf):
    """What the weights of the learned embedding come from, over all documents."""
    return semantic.document_frequency(table(spark, sf, "documents"))


def part_texts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


@query()
def learned_near(spark, sf, width: int = semantic.WIDTH):
    """The five parts nearest to each type of part, by a model of all parts' texts."""
    parts = part_texts(spark, sf)
    model = semantic.fit(parts, width=width)
    types = table(spark, sf, "part").select(F.col("p_type").alias("id")).distinct()
    own = lambda df, text: df.select(F.col("id").cast("string").alias("id"), model(text).alias("embedding"))
    return vectors.knn_batch(own(parts, "text"), own(types, "id"), 5)
