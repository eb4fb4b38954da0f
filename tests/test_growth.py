"""Work that grows with the input, not with its square; tasks that stay small."""

from pyspark.sql import functions as F

from callweave import lineage
from callweave.operators import closures, graph, linking, spans, vectors


def test_partitions_by_bytes(spark, monkeypatch):
    """large inputs get more tasks, not larger ones."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.sources.fileCompressionFactor")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[1], "128m")
        spark.conf.set(names[3], "1.0")
        monkeypatch.setattr(lineage, "SHARE", 10_000)
        out = lineage.cut(spark.range(100_000).repartition(3))
        assert out.count() == 100_000
        assert int(spark.conf.get(names[0])) > 20 and int(spark.conf.get(names[1])) == lineage.READ == int(spark.conf.get(names[2]))
        # A table's rows are taken for larger than its Parquet, which decides on broadcasts.
        assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 100_000 * 16
        spark.conf.set(names[0], "5000")
        lineage.cut(spark.range(10))
        assert spark.conf.get(names[0]) == "5000"
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_no_call_meets_all_units_of_its_name(spark, most_rows):
    """Rows of any step grow with calls and units."""
    n = 300
    u = spark.createDataFrame([(f"u{k:03d}", "same", "f", "function", k, k) for k in range(n)], "id string, name string, file string, type string, line_start int, line_end int")
    c = spark.createDataFrame([("call", f"same({k})", "f", 7) for k in range(n)], "capture_name string, text string, file string, line int")
    found = linking.local_edges(linking._calls(linking.keyed(c), u, "first"), u)
    assert most_rows(found) <= 6 * n
    assert {tuple(r)[:2] for r in found.collect()} == {("u007", "u000")}
    # Captures of one line are looked for once.
    held = linking.containing(linking.keyed(c), u)
    assert most_rows(held) <= 2 * n and held.count() == n


def test_scattered_members_are_rows(spark, monkeypatch):
    """A set of members far apart takes no bitmap for each."""
    made = []
    cut = closures.cut
    monkeypatch.setattr(closures, "cut", lambda df: made.append(cut(df)) or made[-1])
    far = spark.range(1, 401).select(F.lit("b").alias("b"), (F.col("id") * 40_000).alias("number"))
    near = spark.range(1, 401).select(F.lit("c").alias("b"), F.col("id").alias("number"))
    links = spark.createDataFrame([("x", "b"), ("x", "c"), ("y", "b")], "a string, b string")
    got = closures.sizes(closures.union_over(links, far.union(near).union(near)), "n")
    assert sorted(map(tuple, got.collect())) == [("x", 800), ("y", 400)]
    assert max(d.filter("bits is not null").count() for d in made if "bits" in d.columns) == 1


def test_starts_go_together(spark, most_rows):
    """97 notes that all lead to each other, and 50 more into each of them:
    a pair is made once, not in each step for each way to it."""
    rows = [(f"h{a}", f"h{b}") for a in range(97) for b in range(97)] + [(f"x{k}", f"h{b}") for k in range(50) for b in range(97)]
    e = spark.createDataFrame(rows, "from_id string, to_id string")
    found = graph.note_ancestry(e, e.select(F.col("to_id").alias("id")))
    assert most_rows(found) <= 97 * 147
    assert found.count() == 97 * 147
    assert {tuple(r) for r in found.groupBy("depth").count().collect()} == {(0, 97), (1, 97 * 96 + 97 * 50)}


def test_a_block_hands_on_its_nearest_only(spark):
    """k rows a query and block leave the tasks, not all that may be near."""
    v = spark.createDataFrame([(f"v{k:03d}", [float(k % 7), 1.0]) for k in range(400)] + [("none", None), ("hole", [None, 1.0])], "id string, embedding array<double>")
    own = v.filter("embedding[0] is not null").select("id", F.col("embedding").alias("ivec"))
    cells = vectors.Cells(own, 3, 4, 50)
    q = own.select(F.col("id").alias("query"), F.col("ivec").alias("qvec")).filter("id < 'v030'")
    assert cells.nearest(q).count() <= 3 * cells.visits(q).count()
    got = {}
    for r in vectors.knn_batch(v, v.filter("id < 'v030'"), 3, pivots=4, block=50).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, r.distance))
    for k in range(30):
        same = [i for i in range(k % 7, 400, 7) if i != k][:3]
        assert sorted(got[f"v{k:03d}"]) == [(n, f"v{i:03d}", 0.0) for n, i in enumerate(same, 1)]


def test_lines_go_to_levels_that_have_spans(spark, most_rows):
    """no bin gathers all lines of a file where no span is so long."""
    n = 2000
    lines = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    short = spark.range(0, n, 10).select(F.col("id").cast("string").alias("id"), F.lit("f").alias("file"), F.col("id").alias("line_start"), (F.col("id") + 4).alias("line_end"))
    found = spans.within(lines, short)
    assert most_rows(found) <= 2 * n and found.count() == n // 2
    assert spans.within(lines, short.limit(0)).count() == 0
    long = short.limit(1).select(F.lit("x").alias("id"), "file", F.lit(0).alias("line_start"), F.lit(100_000).alias("line_end"))
    assert spans.within(lines, short.withColumn("line_start", F.col("line_start").cast("int")).withColumn("line_end", F.col("line_end").cast("int")).union(long)).count() == n // 2 + n
