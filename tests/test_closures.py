"""Sets of callers as bitmaps, and transitive callers of all units, against search."""

import random

import pytest

from callweave.operators import closures, graph, reports

UNIT = "id string, name string, file string, type string, line_start int, line_end int"
EDGE = "src_id string, dst_id string, rel_type string, file string"


def some_graph(r, n, m, loops=0.0):
    """Units, some in tests, and calls: hubs, cycles, names that are no units."""
    units = [(f"u{k}", f"n{k}", f"{r.choice(['a', 'b/c', 'tests', 'd'])}/f{k % 7}.py", "function", 1, 2) for k in range(n)]
    end = lambda: f"u{min(int(r.expovariate(3 / n)), n - 1)}" if r.random() < 0.95 else f"gone{r.randint(0, 3)}"
    edges = []
    for _ in range(m):
        a, b = r.randrange(n), end()
        if loops or not b.startswith("u") or int(b[1:]) < a:
            edges.append((f"u{a}" if r.random() < 0.97 else "gone1", b, r.choice(["LOCAL_CALL", "EXTERNAL_CALL", "IMPORT", "RUNTIME_BOUNDARY"]), "f"))
    return units, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_hubs_as_sets_equal_pairs(spark, seed, monkeypatch):
    r = random.Random(seed)
    rows, calls = some_graph(r, 90, 700, loops=1)
    u, e = spark.createDataFrame(rows, UNIT), spark.createDataFrame(calls, EDGE)
    targets = None if seed == 1 else u.filter("id < 'u5'")
    plain = closures.Closures(u, e, targets)
    monkeypatch.setattr(closures.Closures.__init__, "__defaults__", (None, 20))
    sets = closures.Closures(u, e, targets)
    assert not plain.any and sets.any and sets.hubs.count() > 10 and not sets.few.isEmpty()
    # No pair of a hub and its callers of callers is made.
    assert sets.few.join(sets.hubs.withColumnRenamed("id", "target"), "target", "left_semi").count() == 0
    own = {x.id for x in (u if targets is None else targets).collect()}
    for name in ("counts", "spread", "tests"):
        get = lambda c: sorted(tuple(x) for x in getattr(c, name)().collect() if x.target in own)  # noqa: B023, E731
        assert get(sets) == get(plain), name
    adj = graph.adjacency(u, e)
    pairs = {(s, d) for s, d in map(tuple, adj.select("src_id", "dst_id").collect())}
    two = pairs | {(a, d) for a, b in pairs for c, d in pairs if b == c}
    assert closures.closure_total(u, adj).first()[0] == len(two)
    assert reports.closure_risk(u, e, targets).count() == len(own)


@pytest.mark.parametrize("seed,loops", [(3, 1), (4, 0), (5, 1)])
def test_all_transitive_callers(spark, seed, loops):
    r = random.Random(seed)
    rows, calls = some_graph(r, 60, 75 if loops else 200, loops)
    calls += [("u50", "u51", "IMPORT", "f"), ("u51", "u52", "IMPORT", "f"), ("u52", "u50", "IMPORT", "f"), ("u50", "u50", "IMPORT", "f")] if loops else []
    u, e = spark.createDataFrame(rows, UNIT), spark.createDataFrame(calls, EDGE)
    ids = {x[0] for x in rows}
    into = {}
    for s, d, kind, _ in calls:
        if kind != "RUNTIME_BOUNDARY" and s in ids and d in ids:
            into.setdefault(d, set()).add(s)

    def above(x):
        seen, todo = set(), [x]
        while todo:
            for s in into.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    got = {x.id: x.n for x in closures.all_transitive_callers(u, e).collect()}
    assert got == {x: len(above(x) - {x}) for x in ids}
    want = {frozenset(y for y in ids if y in above(x) and x in above(y)) for x in ids if x in above(x)}
    found = {}
    for x in closures.cycles(graph.adjacency(u, e)).collect():
        found.setdefault(x.root, set()).add(x.id)
    assert set(map(frozenset, found.values())) == {c for c in want if len(c) > 1}
    some = graph.transitive_callers(u, e, u.filter("id < 'u3'"))
    assert all(got[x.root] == x.n for x in some.collect())


def test_of_nothing(spark):
    u, e = spark.createDataFrame([], UNIT), spark.createDataFrame([], EDGE)
    assert closures.all_transitive_callers(u, e).count() == 0
    u = spark.createDataFrame([("a", "a", "f", "function", 1, 1), ("b", "b", "f", "function", 1, 1)], UNIT)
    assert {tuple(x) for x in closures.all_transitive_callers(u, e).collect()} == {("a", 0), ("b", 0)}
    assert closures.Closures(u, e).counts().count() == 0


def test_numbers_are_dense(spark):
    rows = [(f"u{k}", f"f{k % 3}") for k in range(100)]
    got = closures.numbered(spark.createDataFrame(rows, "id string, file string").repartition(5), "file").collect()
    assert [x.id for x in sorted(got, key=lambda x: x.number)] == [i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert sorted(x.number for x in got) == list(range(1, 101))
