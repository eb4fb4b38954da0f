"""Token-budgeted context: scored candidates, their tiers, and the fill."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import relevance
from ..functions.text import tokens

# Fixed value: with so few tokens left a name no longer fits.
NAME_ONLY = 12


def candidates(found: DataFrame, texts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """id, score, tiers of search results. found: id, similarity, is_seed;
    texts: id, area, source, signature, label. Tiers are tried in order."""
    rows = found.join(texts, "id")
    if summaries is not None:
        rows = rows.join(summaries.select("area", "summary"), "area", "left")
    else:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    score = relevance(F.when(F.col("is_seed"), F.col("similarity")).otherwise(0.0), "is_seed")
    tier = lambda name, text: F.struct(F.lit(name).alias("tier"), F.coalesce(tokens(text), F.lit(0)).cast("long").alias("tokens"), F.length(F.coalesce(text, F.lit(""))).alias("size"))
    tiers = F.array(tier("full", "source"), tier("signature", "signature"), tier("area", "summary"), tier("name", "label"))
    return rows.select("id", "area", score.alias("score"), tiers.alias("tiers"))


def fill(ranked: DataFrame, budget: int = 8000) -> DataFrame:
    """id, ord, tier, tokens of what fits, best first; null tier for what
    doesn't. The fill depends on the order, so one task does it: candidates
    are sorted, which may spill, and pass through row by row; it holds the areas
    that it has told of, which are at most as many as the budget has tokens."""
    schema = pa.schema([("id", pa.string()), ("ord", pa.int64()), ("tier", pa.string()), ("tokens", pa.int64())])

    def run(batches):
        used, seen, k = 0, set(), 0
        for batch in batches:
            out = []
            for id_, area, tiers in zip(*(batch.column(c).to_pylist() for c in ("id", "area", "tiers"))):
                left, chosen = budget - used, (None, 0)
                for t in tiers if left > NAME_ONLY else ():
                    name, size = t["tier"], t["size"]
                    if name in ("full", "area") and not size or name == "area" and (not area or area in seen):
                        continue
                    if t["tokens"] <= left:
                        chosen = (name, t["tokens"])
                        if name == "area":
                            seen.add(area)
                        break
                used += chosen[1]
                out.append((id_, k, *chosen))
                k += 1
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    return ranked.repartition(1).sortWithinPartitions(F.desc("score"), "id").mapInArrow(run, "id string, ord long, tier string, tokens long")


def export_xml(filled: DataFrame) -> DataFrame:
    from ..functions.text import xml_escape

    return filled.filter("tier is not null").select("ord", F.format_string('<unit id="%s" tier="%s" tokens="%d"/>', xml_escape("id"), F.col("tier"), F.col("tokens")).alias("xml"))
