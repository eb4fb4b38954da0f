"""The learned embedding against a whole decomposition, and what it finds."""

import os

import numpy as np
import pytest

from callweave.engine import Engine
from callweave.operators import semantic, vectors
from callweave.plans import learned
from pyspark.sql import functions as F

#: Of each pair of words units have one only, beside words that both go with.
TOPICS = [("fetch", "retrieve", "http url socket timeout"), ("remove", "erase", "disk path folder inode"), ("paint", "draw", "canvas brush pixel colour")]


def corpus():
    rng = np.random.default_rng(5)
    out = []
    for k in range(240):
        one, other, beside = TOPICS[k % 3]
        near = rng.choice(beside.split(), 3, replace=False)
        out.append((f"u{k}", f"{(one, other)[k // 3 % 2]}{near[0].title()} {near[1]}_{near[2]}"))
    return out + [("null", None), ("empty", ""), ("signs", "+-*/"), ("long", "socket " * 5000)]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(corpus(), "id string, text string").withColumn("feature", F.lit("x"))
    return df, semantic.fit(df.repartition(5), width=8)


def test_words(spark):
    got = spark.createDataFrame([("readURLs_of2Files, x",), ("",), (None,)], "t string").select(semantic.words("t"), F.size(semantic.features("t"))).collect()
    assert [tuple(r) for r in got] == [(["read", "urls", "of2", "files", "x"], 5), ([], 0), (None, 0)]


def test_same_axes_as_the_whole_decomposition(spark, fitted):
    df, model = fitted
    lists = [r[0] for r in df.select(semantic.features("text")).collect()]
    a = np.zeros((len(lists), semantic.FEATURES))
    for k, own in enumerate(lists):
        for f in own:
            a[k, f] += 1
    idf = np.log((1 + len(lists)) / (1 + (a > 0).sum(0))) + 1
    assert np.allclose(idf, model.idf)
    a = np.log1p(a) * idf
    norm = np.sqrt((a * a).sum(1, keepdims=True))
    a = a / np.where(norm > 0, norm, 1)
    used = a.any(0)
    _, s, vt = np.linalg.svd(a[:, used], full_matrices=False)
    own = model.basis[used].astype(float)
    # Axes are as long as their singular values, and hold as much of the matrix as can be.
    assert np.allclose(np.linalg.norm(own, axis=0), s[:8] / s[0], atol=1e-3)
    held = np.linalg.norm(a[:, used] @ (own / np.linalg.norm(own, axis=0)))
    assert abs(held / np.linalg.norm(s[:8]) - 1) < 1e-3
    assert not model.basis[~used].any()


def test_partitions_and_reruns_agree(spark, fitted):
    df, model = fitted
    again = semantic.fit(df.repartition(2, "id"), width=8)
    assert np.array_equal(model.basis, again.basis) and np.array_equal(model.idf, again.idf)
    back = semantic.Model.of_rows(model.rows(spark))
    assert np.array_equal(model.basis, back.basis) and np.array_equal(model.idf, back.idf)


def test_paraphrases_and_odd_texts(spark, fitted):
    df, model = fitted
    learned = {r[0]: r[1] for r in df.select("id", model("text")).collect()}
    hashed = {r[0]: r[1] for r in df.select("id", vectors.hashed_embedding("text")).collect()}
    for odd in ("null", "empty", "signs"):
        assert not np.any(learned[odd])
    assert abs(np.linalg.norm(learned["long"]) - 1) < 1e-5
    text = dict(corpus())
    for one, other, _ in TOPICS:
        q = spark.range(1).select(model(F.lit(one)), vectors.hashed_embedding(F.lit(one))).first()
        said = [i for i in text if (text[i] or "").startswith(other)]
        rest = [i for i in text if i.startswith("u") and not (text[i] or "").startswith((one, other))]
        score = lambda v, ids, x: np.array([np.dot(v, x[i]) for i in ids])
        assert score(q[0], said, learned).min() > score(q[0], rest, learned).max() + 0.3
        assert score(q[1], said, hashed).min() <= score(q[1], rest, hashed).max() + 0.3
    none = semantic.fit(df.limit(0), width=8)
    assert not np.any(spark.range(1).select(none(F.lit("fetch"))).first()[0])


def test_an_index_holds_its_model(spark, tmp_path):
    text = lambda rows: "\n".join(f"def {(t or 'x').split()[0].lower()}_{i}(x):\n    \"\"\"{t}\"\"\"\n" for i, t in rows)
    rows = [r for r in corpus() if r[0].startswith("u")]
    files = lambda n: spark.createDataFrame([("a.py", text(rows[:n]), f"h{n}")], "file string, content string, hash string")
    e = Engine(spark, str(tmp_path / "index"), embed="learned")
    with pytest.raises(ValueError):
        e.search("fetch")
    e.build(files(60), "2024-01-01T00:00:00Z", now=1)
    assert e.store.read("vectors").count() == e.units.count() == 61
    held = e.store.parts("model")
    e.update(files(70), "2024-01-02T00:00:00Z", now=2)
    # The update embeds with the model of the build, which it keeps.
    assert e.store.parts("model") == held and e.store.read("vectors").count() == 71
    other = Engine(spark, str(tmp_path / "index"), embed="learned")
    found = other.search("fetch", 20).filter("source = 'matched'").select("id").collect()
    assert len(found) == 20 and all("::fetch" in r.id or "::retrieve" in r.id for r in found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_nearest_parts_are_those_of_a_search_of_all(spark):
    sf = "/root/testdata/sf0.001"
    parts = learned.part_texts(spark, sf)
    model = semantic.fit(parts)
    own = parts.select(F.col("id").cast("string").alias("id"), model("text").alias("v")).toPandas()
    types = spark.read.parquet(f"{sf}/part.parquet").select("p_type").distinct().select("p_type", model("p_type").alias("v")).toPandas()
    far = np.linalg.norm(np.stack(types.v).astype(float)[:, None] - np.stack(own.v).astype(float)[None], axis=2)
    got = learned.learned_near(spark, sf).toPandas()
    assert len(got) == 5 * len(types)
    for k, name in enumerate(types.p_type):
        want = sorted(zip(far[k], own.id))[:5]
        mine = got[got["query"] == name].sort_values("rank")
        assert np.allclose(mine.distance, [d for d, _ in want], atol=1e-9)
