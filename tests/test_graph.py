"""The graph kernel and the reports on hand-made graphs."""

import pytest

from callweave.operators import areas, context, drift, graph, health, linking, notes, onboarding, reports, vectors, viz
from pyspark.sql import functions as F

U = "id string, name string, file string, type string, line_start int, line_end int, signature string, docstring string"
E = "src_id string, dst_id string, rel_type string, file string"


def make(spark, ids, edges, files=None):
    files = files or {}
    u = spark.createDataFrame([(i, i, files.get(i, "a/m.py"), "function", 1, 5, None, None) for i in ids], U)
    return u, spark.createDataFrame([(s, d, k, "a/m.py") for s, d, k in edges], E)


def calls(*pairs):
    return [(a, b, "LOCAL_CALL") for a, b in pairs]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(df):
    return df.first()[0]


def test_callers_by_depth(spark):
    u, e = make(spark, "abcd", calls("ab", "bc", "cd", "ab", "dc") + [("d", "x", "RUNTIME_BOUNDARY")])
    got = rows(graph.callers(u, e))
    assert ("c", "b", 1) in got and ("c", "a", 2) in got and ("c", "d", 1) in got and ("d", "b", 2) in got
    assert len([r for r in got if r[:2] == ("b", "a")]) == 1
    assert not [r for r in got if r[0] == r[1]]


def test_two_hops_both_ways(spark):
    u, e = make(spark, "ABCD", calls("AB", "BC", "CD") + [("A", "x", "RUNTIME_BOUNDARY")])
    seed = u.filter("id = 'A'")
    assert rows(graph.two_hops(e, seed)) == [("B",), ("C",)]
    assert rows(graph.two_hops(e, seed, True)) == [("A",), ("B",), ("C",)]
    assert rows(graph.two_hops(e, u.filter("id = 'C'"))) == [("A",), ("B",), ("D",)]
    assert rows(graph.boundary_warnings(e, seed)) == [("A", "x")]
    assert graph.two_hops(e, u.limit(0), True).count() == 0


def test_risk_formula(spark):
    from callweave.functions.scores import risk, risk_label

    r = spark.range(1).select(risk(F.lit(1), F.lit(2), F.lit(2), F.lit(5), F.lit(0.5)).alias("r")).withColumn("l", risk_label("r")).first()
    assert r.r == pytest.approx(1.44) and r.l == "LOW"
    low = spark.range(1).select(risk(F.lit(1), F.lit(0), F.lit(1), F.lit(1), F.lit(0.0)).alias("r")).first().r
    assert low == pytest.approx(20)


def test_health(spark):
    area = {"x": "x/", "y": "y/"}
    files = {"a": "x/1.py", "b": "y/1.py", "t": "x/2.py"}
    u, e = make(spark, "abt", calls("ab", "ta"), files)
    assert value(health.coupling(u, e, area)) == 0.5
    u, e = make(spark, "abc", calls("ab", "bc"))
    assert value(health.average_closure(u, e)) == 1.0
    u, e = make(spark, ["live", "dead"], calls(("live", "live")))
    assert value(health.dead_share(u, e)) == 50.0
    u, e = make(spark, ["t", "impl"], calls(("t", "impl")), {"t": "x/test_a.py"})
    assert value(health.test_surface(u, e)) == 100.0
    u, e = make(spark, ["t", "impl"], [], {"t": "x/test_a.py"})
    assert value(health.test_surface(u, e)) == 0.0
    u, e = make(spark, ["hub", *"abcde"], calls(*((c, "hub") for c in "abcde")))
    top = health.hotspots(u, e, {"a": "a/"}).first()
    assert (top.id, top.callers) == ("hub", 5)
    empty, none = u.limit(0), e.limit(0)
    assert tuple(health.metrics(empty, none, area).first())[:6] == (0.0,) * 6


def test_reach_through_tests_or_not(spark):
    u, e = make(spark, ["t1", "t2", "a"], calls(("t1", "t2"), ("t2", "a")), {"t1": "x/test_1.py", "t2": "x/test_2.py"})
    assert rows(health.tested(u, e)) == [("a",)]
    u, e = make(spark, ["t", "h", "a"], calls(("t", "h"), ("h", "a")), {"t": "x/test_1.py", "h": "x/test_h.py"})
    start = u.filter("id = 't'")
    assert rows(graph.reach(u, e, start, through=u.filter("id = 'a'"))) == []
    assert rows(graph.reach(u, e, start)) == [("a",), ("h",)]


def test_silo_and_ownership(spark):
    u, e = make(spark, "tabc", calls("at", "bt", "ct"))
    lines = spark.createDataFrame([("a/m.py", k, "alice" if k != 2 else "bob") for k in (1, 2, 3, 4)], "file string, line int, author string")
    own = reports.ownership(u, lines).filter("id = 't'").first()
    assert (own.authors, own.primary_author, own.share) == (2, "alice", 0.75)
    assert tuple(reports.ownership(u, lines.limit(0)).first())[1:] == (1, "unknown", 1.0)
    s = reports.silos(u, e, lines.filter("author = 'alice'")).filter("id = 't'").first()
    assert (s.silo_score, s.label) == (3.0, "MEDIUM")


def test_coverage_gap_keeps_quiet_files(spark):
    u, e = make(spark, "tabcde", calls("at", "bt", "ct", "dt", "et"))
    none = u.select("id").limit(0)
    v = spark.createDataFrame([("a/m.py", 10)], "file string, velocity long")
    got = reports.coverage_gaps(u, e, none, v).filter("id = 't'").first()
    assert got.callers == 5 and got.gap_score > 0
    assert reports.coverage_gaps(u, e, none, v.limit(0)).filter("id = 't'").first().gap_score == 0


def test_exposure(spark):
    edges = [("view", "external::pkg.get", "RUNTIME_BOUNDARY")]
    u, e = make(spark, ["view"], edges)
    assert reports.exposure(u, e, reports.package_callers(u, e, "pkg")).first().score == 1.0
    u, e = make(spark, ["view", "fetch"], [("fetch", "external::pkg", "RUNTIME_BOUNDARY"), ("view", "fetch", "LOCAL_CALL")])
    got = reports.exposure(u, e, reports.package_callers(u, e, "pkg")).first()
    assert (got.score, got.entry) == (0.6, "view")
    u, e = make(spark, ["t"], [("t", "external::pkg", "RUNTIME_BOUNDARY")], {"t": "tests/a.py"})
    assert reports.exposure(u, e, reports.package_callers(u, e, "pkg")).first().level == "low"
    u, e = make(spark, ["v"], [("v", "external::pkg_other", "RUNTIME_BOUNDARY")])
    assert reports.package_callers(u, e, "pkg").count() == 0
    steps = reports.remediation(reports.exposure(u, e, u.select("id")), "pkg", "1.0").collect()
    assert steps[-1].action == "pin pkg > 1.0"


def test_reading_order_and_hotspots(spark):
    area = {"graph": "graph/", "db": "db/", "config": "config/"}
    files = {"g": "graph/a.py", "d": "db/a.py", "c": "config/a.py"}
    u, e = make(spark, "gdc", calls("gd", "dc"), files)
    assert [r.area for r in onboarding.reading_order(u, e, area).orderBy("ord").collect()] == ["config", "db", "graph"]
    u, e = make(spark, "gdc", calls("gd", "dc", "cg"), files)
    assert onboarding.reading_order(u, e, area).count() == 3
    u, e = make(spark, ["hub", "p", "q", "r"], calls(("p", "hub"), ("q", "hub"), ("r", "hub")), {"hub": "graph/h.py", "p": "graph/a.py", "q": "db/a.py", "r": "db/b.py"})
    h = onboarding.hotspots(u, e, area).first()
    assert (h.id, h.callers, h.spread, h.closure) == ("hub", 3, 2, 3)


def test_sequence_ends_with_the_target(spark):
    u, e = make(spark, "tab", calls("at", "ba"), {"t": "x/t.py", "a": "x/a.py", "b": "x/b.py"})
    got = reports.refactor_sequence(u, e, u.filter("id = 't'")).orderBy("step").collect()
    assert [r.file for r in got] == ["x/a.py", "x/b.py", "x/t.py"]


def test_linking(spark):
    u = spark.createDataFrame([("a::m", "m", "a.py", "module", 1, 50), ("a::f", "f", "a.py", "function", 8, 20), ("a::h", "helper", "a.py", "function", 30, 31), ("b::h", "helper", "b.py", "function", 1, 3), ("b::o", "other", "b.py", "function", 5, 6)], "id string, name string, file string, type string, line_start int, line_end int")
    c = spark.createDataFrame([("call", "helper()", "a.py", 10), ("call", "gone(1)", "a.py", 10), ("call", "other(", "a.py", 60), ("import", "import other", "a.py", 1)], "capture_name string, text string, file string, line int")
    got = {(r.src_id, r.dst_id, r.rel_type) for r in linking.link(c, u).collect()}
    assert got == {("a::m", "a::h", "LOCAL_CALL"), ("a::m", "b::h", "EXTERNAL_CALL"), ("a::m", "external::gone", "RUNTIME_BOUNDARY"), ("a::m", "b::o", "IMPORT")}
    inner = {(r.src_id, r.dst_id) for r in linking.link(c, u, "innermost").collect()}
    assert ("a::f", "a::h") in inner
    twice = u.filter("id = 'a::f'").union(u.filter("id = 'a::f'").withColumn("line_start", F.lit(1)))
    assert linking.dedupe_units(twice).first().line_start == 1


def test_knn_and_hybrid(spark):
    v = spark.createDataFrame([("n1", [1.0, 0.0, 0.0, 0.0]), ("n2", [0.9, 0.1, 0.0, 0.0]), ("n3", [0.7, 0.3, 0.0, 0.0]), ("n4", [0.4, 0.6, 0.0, 0.0]), ("n5", [0.0, 1.0, 0.0, 0.0])], "id string, embedding array<float>")
    got = vectors.knn(v, [1.0, 0, 0, 0], 3).collect()
    assert [r.id for r in got] == ["n1", "n2", "n3"] and all(0 <= r.similarity <= 1 for r in got)
    u, e = make(spark, ["n1", "n2", "x"], calls(("x", "n1")))
    found = {r.id: r.source for r in vectors.hybrid(v, u, e, [1.0, 0, 0, 0], 1).collect()}
    assert found == {"n1": "matched", "x": "neighbour"}
    whole = sorted(map(str, vectors.knn_batch(v, v, 2).collect()))
    assert len(whole) == 10 and sorted(map(str, vectors.knn_batch(v, v, 2, pivots=2, block=2).collect())) == whole
    assert vectors.knn_batch(v, v.limit(0)).count() == 0
    u = u.withColumn("file", F.when(F.col("id") == "x", "lib/x.py").otherwise(F.col("file")))
    in_area = vectors.hybrid(v, u, e, [1.0, 0, 0, 0], 1, {"Main": "a/", "lib": "lib/"}, area="AI")
    assert [r.id for r in in_area.collect()] == ["n1"]
    assert vectors.embedder("local") is vectors.hashed_embedding and vectors.embedder("none") is None
    with pytest.raises(ValueError):
        vectors.embedder("other")


def test_long_chains_have_an_end(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGE", 4)
    n = 210
    u, e = make(spark, [f"n{k:03d}" for k in range(n)], calls(*((f"n{k:03d}", f"n{k + 1:03d}") for k in range(n - 1))))
    e = e.unionByName(e.limit(1).withColumn("src_id", F.lit(f"n{n - 1:03d}")).withColumn("dst_id", F.lit("n200")))
    assert graph.reach(u, e, u.filter("id = 'n000'")).count() == n - 1


def test_layers_and_refactor_sequence(spark):
    u, e = make(spark, ["t", "a", "b", "c", "d", "x", "y"], calls(("a", "t"), ("b", "a"), ("b", "t"), ("c", "b"), ("x", "t"), ("x", "y"), ("y", "x"), ("t", "a"), ("d", "d")), {"t": "t.py", "a": "z.py", "b": "m.py", "c": "m.py", "x": "c.py", "y": "c.py"})
    got = {r.id: r.layer for r in graph.layers(u, e.filter("src_id <> 't'")).collect()}
    assert (got["t"], got["a"], got["b"], got["c"], got["d"]) == (0, 1, 2, 3, 0) and got["x"] == got["y"] == 4
    steps = [(r.step, r.file, r.ids) for r in reports.refactor_sequence(u, e, u.filter("id = 't'")).orderBy("step").collect()]
    assert steps == [(1, "z.py", ["a"]), (2, "m.py", ["b", "c"]), (3, "c.py", ["x", "y"]), (4, "t.py", ["t"])]
    assert reports.refactor_sequence(u, e, u.limit(0)).count() == 0


def test_lines_within_spans(spark):
    import random

    from callweave.operators.spans import within

    r = random.Random(3)
    lines = [(r.choice("ab"), r.randint(-5, 3000), k) for k in range(300)] + [("a", None, 900), (None, 5, 901)]
    spans = []
    for k in range(60):
        start = r.randint(0, 2500)
        spans.append((r.choice("ab"), start, start + r.choice([-1, 0, 3, 31, 32, 33, 500, 2000, 10**6]), k))
    spans += [("b", 0, 10**9, 60), (None, 1, 5, 61), ("a", None, 7, 62)]
    got = within(spark.createDataFrame(lines, "file string, line int, k int"), spark.createDataFrame(spans, "file string, line_start int, line_end int, s int"))
    want = [(k, s) for f, n, k in lines for g, a, b, s in spans if f is not None and f == g and None not in (n, a) and a <= n <= b]
    assert sorted((r.k, r.s) for r in got.collect()) == sorted(want)


def test_targets_of_changed_files(spark):
    u, e = make(spark, ["f", "m", "g"], [], {"f": "x.py", "m": "x.py", "g": "y.py"})
    u = u.withColumn("type", F.when(F.col("id") == "m", "module").otherwise("function"))
    files = spark.createDataFrame([("x.py",), ("x.py",)], "file string")
    assert [r.id for r in reports.units_of_files(u, files).collect()] == ["f"]


def test_decay(spark):
    from callweave.functions.scores import decay, decay_status

    r = spark.range(1).select(decay(F.lit(70.0), F.lit(False)).alias("a"), decay(F.lit(0.0), F.lit(True)).alias("b")).withColumn("s", decay_status("b")).first()
    assert r.a == pytest.approx(0.5) and r.b <= 0.31 and r.s == "active"


def test_context_budget(spark):
    rows_ = [("a", "x", 1.0, [("full", 50, 200), ("signature", 10, 40), ("area", 5, 0), ("name", 2, 8)]), ("b", "x", 0.5, [("full", 90, 360), ("signature", 20, 80), ("area", 5, 0), ("name", 2, 8)])]
    df = spark.createDataFrame(rows_, "id string, area string, score double, tiers array<struct<tier:string,tokens:long,size:int>>")
    got = {r.id: (r.tier, r.tokens) for r in context.fill(df, 75).collect()}
    assert got == {"a": ("full", 50), "b": ("signature", 20)}
    assert {r.tier for r in context.fill(df, 10).collect()} == {None}


def test_viz_prefixes(spark):
    u, e = make(spark, ["a", "b"], [("a", "b", "CALLS")], {"a": "pkg.py", "b": "zzz/1.py"})
    got = viz.viz_nodes(u, e, {"p": "pkg"}).collect()
    assert [(r.id, r.area, r.n_out) for r in got] == [("a", "p", 0)]
    f = spark.createDataFrame([("src/a/x.py",), ("src/ab.py",)], "file string")
    assert [r[0] for r in f.select(areas.longest_prefix("file", {"s": "src", "a": "src/a/"})).collect()] == ["a", "s"]


def test_notes(spark):
    n = spark.createDataFrame([("1", "u", "x", "warning", "t", 5, "active"), ("2", None, "y", "decision", "t", 6, "stale")], "id string, unit_id string, area string, type string, title string, created_ts long, status string")
    assert [r.id for r in notes.list_notes(n).collect()] == ["1"]
    assert notes.list_notes(n, area="y", include_stale=True).count() == 1
    assert notes.stale_count(n).first()[0] == 1
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from_id string, to_id string")
    start = spark.createDataFrame([("c",)], "id string")
    assert rows(graph.note_ancestry(e, start, 5)) == [("c", "a", 2), ("c", "b", 1), ("c", "c", 0)]


def test_drift(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file string, hash string")
    assert rows(drift.hash_diff(old, new)) == [("b", "M"), ("c", "D"), ("d", "A")]
    lines = spark.createDataFrame([(0, "M\tx.py"), (1, "R100\told.py\tnew.py"), (2, "bare.py"), (3, " ")], "ord long, line string")
    assert rows(drift.name_status(lines).drop("ord")) == [("bare.py", "A"), ("new.py", "A"), ("old.py", "D"), ("x.py", "M")]


def test_exact_search_passes_over_far_cells(spark):
    import numpy as np

    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(400, 8)) * 0.05 + c for c in r.normal(size=(6, 8)) * 4] + [np.repeat(r.normal(size=(1, 8)), 900, axis=0)])
    rows = [(f"v{i:04}", v.tolist()) for i, v in enumerate(x)] + [("null", None)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    q = v.filter("id in ('v0000', 'v0500', 'v2399', 'v2400', 'v2500', 'null')").union(spark.createDataFrame([("other", (x[7] + 0.01).tolist())], v.schema))
    cells = vectors.Cells(v.filter("embedding is not null").select("id", vectors.F.col("embedding").alias("ivec")), 10, 16, 200)
    met = cells.candidates(q.filter("embedding is not null").select(vectors.F.col("id").alias("query"), vectors.F.col("embedding").alias("qvec")))
    assert met.count() < 0.5 * 6 * len(x)  # most pairs aren't compared
    got = sorted((t.query, t["rank"], t.id, round(t.distance, 9)) for t in vectors.knn_batch(v, q, 10, pivots=16, block=200).collect())
    want = []
    for name, own in [(t.id, np.array(t.embedding)) for t in q.collect() if t.embedding is not None]:
        far = sorted((round(float(np.sqrt(((own - y) ** 2).sum())), 9), f"v{i:04}") for i, y in enumerate(x) if f"v{i:04}" != name)
        want += [(name, k, i, d) for k, (d, i) in enumerate(far[:10], 1)]
    assert got == sorted(want)
