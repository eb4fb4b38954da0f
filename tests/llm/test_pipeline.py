import corpus_pipeline
import __spark_entry__
from callweave.llm import jaccard, quality, suffix


def test_stages_keep_the_columns(spark, docs, none):
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == table.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, "")
        assert "doc_id" in pieces.columns
        if table is none:
            assert pieces.count() == 0


def test_decisions_take_effect(spark, docs):
    first = quality.filter_documents(docs)
    second = corpus_pipeline.keep_one_of_each(spark, first, "")
    assert jaccard.join(second).agg({"n_links": "max"}).first()[0] in (None, 0)
    third = corpus_pipeline.drop_repeats(spark, second, "")
    ids = [r.doc_id for r in second.collect()]
    once = {i for i in ids if ids.count(i) == 1}
    removed = {r.doc_id: r.n_removed for r in suffix.dedup(second).collect()}
    size = {r.doc_id: len((r.text or "").encode()) for r in second.collect()}
    for r in third.filter(third.doc_id.isin(*once - {None})).collect():
        assert size[r.doc_id] - removed[r.doc_id] - 8 <= len((r.text or "").encode()) <= size[r.doc_id] - removed[r.doc_id]


def test_registered():
    q = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_is_its_stages(spark, tmp_path):
    """run() itself: written and read between the stages, and cleared away."""
    import random

    from callweave.llm.common import written

    r = random.Random(3)
    text = lambda n: " ".join(r.choice([f"word{k}" for k in range(400)]) for _ in range(n))
    passage = text(30)
    rows = [(i, f"{text(80)} {passage if i % 4 == 0 else ''}", "s") for i in range(24)]
    rows += [(100, rows[1][1], "s"), (101, rows[2][1] + " more", "s"), (102, "too short", "s"), (103, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = written()
    got = corpus_pipeline.run(spark, str(tmp_path))
    pieces = got.select("doc_id", "start", "length", "ids").collect()
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    key = lambda rows: sorted((x.doc_id, x.start, x.length, bytes(x.ids)) for x in rows)
    whole = lambda rows: {i: b"".join(b for j, _, _, b in key(rows) if j == i) for i, *_ in key(rows)}
    assert whole(pieces) == whole(now.select("doc_id", "start", "length", "ids").collect())
    assert {x.doc_id for x in pieces} == set(range(24))  # neither the copies nor the rejected
    assert len(written() - before) >= 1
