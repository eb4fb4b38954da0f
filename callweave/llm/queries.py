"""The opN_ queries: each runs its operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, blocks, bpe, chat, jaccard, lexical, lm, mixing, packing, quality, spelling, suffix
from . import license as license_scan
from .common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), packing.vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(read(spark, sf_dir, "documents"), packing.vocabulary("word_bpe_49k.json"))
    n = F.octet_length("ids") / 4
    return coded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(read(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "position", "turn", "role", "parent", "root", "depth", F.size("quotes").cast("long").alias("n_quotes"), "text")


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents"))
    base = F.array_distinct("places.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("spans.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.cover"), F.lit(0.0))).alias("score"),
    )


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(read(spark, sf_dir, "documents"))


def op10_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = blocks.dedup(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_jaccard": op2_jaccard,
    "op3_suffix": op3_suffix,
    "op4_bpe": op4_bpe,
    "op5_chat": op5_chat,
    "op6_license": op6_license,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_lm": op9_lm,
    "op10_blocks": op10_blocks,
    "op11_mixing": op11_mixing,
    "op12_spelling": op12_spelling,
    "op13_lexical": op13_lexical,
}

_LEXICAL = """
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark
), size AS (SELECT doc_id, CAST(count(*) AS HUGEINT) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT CAST(count(*) AS HUGEINT) AS nn, CAST(sum(n) AS HUGEINT) AS ll FROM size),
posting AS (SELECT doc_id, term, CAST(count(*) AS HUGEINT) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(nn AS DOUBLE) + 2) / (2 * df + 1))) AS HUGEINT) AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), corpus),
impact AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) AS v
    FROM posting JOIN size USING (doc_id) JOIN weight USING (term), corpus
), scored AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op13_lexical": _LEXICAL}
