"""Updates in proportion to the change: relinking, parts, leases, micro-batches."""

import random
import time

import pytest

from callweave import schema, store
from callweave.engine import Engine
from callweave.operators import linking, relink
from callweave.sources import files
from callweave.streaming import velocity

UNITS, CAPTURES = schema.UNITS, schema.CAPTURES


def some_file(r, name):
    """Units and captures of a file, with names that many files share."""
    units = [(f"{name}::{name}", name, name, "module", 1, 60, None, None, "h")]
    for n in r.sample(["run", "go", "stop", "x.y", "load", "save"], r.randint(0, 4)):
        at = r.randint(1, 50)
        units.append((f"{name}::{n}", n, name, "function", at, at + r.randint(0, 8), "s", None, "h"))
    calls = [("call", f"{r.choice(['run', 'go', 'stop', 'x.y', 'load', 'print', 'lib.f'])}(1)", name, r.randint(1, 60)) for _ in range(r.randint(0, 5))]
    return units, calls + [("import", f"from z import {r.choice(['run', 'save', 'os'])}", name, 1) for _ in range(r.randint(0, 2))]


def test_relinking_equals_linking_anew(spark):
    r = random.Random(31)
    tree = {f"d{k % 3}/f{k}": some_file(r, f"d{k % 3}/f{k}") for k in range(14)}
    frame = lambda k, names, ddl: spark.createDataFrame([x for n in names for x in tree[n][k]], ddl)
    less = False
    for step in range(5):
        units, captures = frame(0, tree, UNITS), relink.with_names(frame(1, tree, CAPTURES))
        edges = spark.createDataFrame(linking.link_named(captures, units).collect(), "src_id string, dst_id string, rel_type string, file string, callee string")
        gone = r.sample(sorted(tree), r.randint(0, 2)) if step else []
        edited = r.sample([n for n in sorted(tree) if n not in gone], r.randint(1, 2)) if step != 1 else []
        added = [f"d9/new{step}"] if r.random() < 0.6 else []
        for n in gone:
            del tree[n]
        for n in (*edited, *added):
            tree[n] = some_file(r, n)
        changes = spark.createDataFrame([(n, "D") for n in gone] + [(n, "M") for n in edited] + [(n, "A") for n in added], "file string, status string")
        new_units, new_captures = frame(0, (*edited, *added), UNITS), frame(1, (*edited, *added), CAPTURES)
        u, c, e = relink.update(units, captures, edges, changes, new_units, new_captures)
        want = linking.link_named(frame(1, tree, CAPTURES), frame(0, tree, UNITS))
        assert sorted(map(tuple, e.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(x.id for x in u.collect()) == sorted(x[0] for n in tree for x in tree[n][0])
        assert c.count() == sum(len(x[1]) for x in tree.values())
        users = relink.change(units, captures, changes, new_units, new_captures).captures
        less |= users.count() < captures.count() // 2
    assert less  # most captures aren't linked anew


def test_many_names_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "b"), ("b", None), (None, "c"), ("d", "d"), (None, None)], "called string, imported string")
    names = spark.createDataFrame([("b",), ("d",)], "name string")
    few = sorted(map(str, relink.named(rows, names, "called", "imported").collect()))
    monkeypatch.setattr(relink, "FILTER", 1)
    assert sorted(map(str, relink.named(rows, names, "called", "imported").collect())) == few and len(few) == 3


def write(root, **texts):
    for name, text in texts.items():
        p = root / f"{name}.py"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_only_touched_parts_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LEAST", 16)
    root = tmp_path / "src"
    write(root, **{f"m{k}": f"def f{k}(x):\n    return f{(k + 1) % 30}(x)\n" for k in range(30)})
    read = lambda: files.read_tree(spark, str(root))
    e = Engine(spark, str(tmp_path / "index"), {"all": "."})
    e.build(read(), "2024-01-01T00:00:00Z", now=1)
    before = e.store.manifest()["tables"]
    write(root, m3="def f3(x):\n    return f4(x) + f9(x)\ndef other():\n    pass\n")
    e.update(read(), "2024-01-02T00:00:00Z", now=2)
    after = e.store.manifest()["tables"]
    own = e.store.buckets_of(spark.createDataFrame([("m3.py",)], "file string"))
    for table in ("units", "captures", "vectors", "file_hashes", "edges"):
        assert {int(b) for b in after[table] if after[table][b] != before[table].get(b)} == own, table
    # A name that goes takes the edges of its callers in other files with it.
    write(root, m3="def renamed(x):\n    return f4(x)\n")
    e.update(read(), "2024-01-03T00:00:00Z", now=3)
    assert ("m2.py::f2", "external::f3") in {(r.src_id, r.dst_id) for r in e.edges.collect()}
    anew = Engine(spark, str(tmp_path / "anew"), e.areas)
    anew.build(read(), "2024-01-03T00:00:00Z", now=3)
    for table in ("units", "edges", "file_hashes", "captures", "vectors", "meta"):
        assert sorted(map(str, e.store.read(table).collect())) == sorted(map(str, anew.store.read(table).collect())), table
    # Parts that no snapshot names are deleted, all others are there.
    e.update(read(), "2024-01-04T00:00:00Z", now=4)
    named = {p for k in e.store._pointers() for own in e.store.manifest(e.store._text(f"current/{k}"))["tables"].values() for p in own.values()}
    there = {str(p.relative_to(tmp_path / "index")) for p in (tmp_path / "index").glob("snapshot-*/*/bucket=*")}
    assert there == named and e.units.count() == 60


def test_a_part_that_is_gone_is_an_error(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    rows = lambda *ids: spark.createDataFrame([(i, "caused", "x", 1, "me") for i in ids], "from_id string, rel_type string, to_id string, created_ts long, author string")
    s.append("note_edges", rows("a"))
    s.append("note_edges", rows("b"))
    s.append("note_edges", rows("b"), batch=("s", 4))
    s.append("note_edges", rows("b"), batch=("s", 4))  # a replay
    assert sorted(r.from_id for r in s.read("note_edges").collect()) == ["a", "b", "b"]
    put = s._put
    s._put = lambda *a: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):  # between writing and naming what is written
        s.replace("note_edges", s.read("note_edges").filter("from_id = 'a'"))
    s._put = put
    assert s.read("note_edges").count() == 3
    s.replace("note_edges", s.read("note_edges").filter("from_id = 'a'"))
    assert [r.from_id for r in s.read("note_edges").collect()] == ["a"]
    for k in range(store.MERGE + 2):
        s.append("note_edges", rows(f"n{k}"))
    assert s.read("note_edges").count() == store.MERGE + 3 and len(s._listed("note_edges")[1]["parts"]) < store.MERGE
    part = s._listed("note_edges")[1]["parts"][0]
    (tmp_path / "i/note_edges" / part).rename(tmp_path / "away")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        s.read("note_edges").count()


def test_lease(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "i"))
    meta = {"meta": spark.createDataFrame([("k", "v")], schema.META)}
    with s.lease("one") as lease:
        with pytest.raises(store.Taken, match="one is writing"), s.lease("two"):
            pass
        lease.renew()
        s.publish(meta, lease=lease)
    with s.lease("three", seconds=0.01) as stale:
        time.sleep(0.05)
        with s.lease("four") as now:  # it has run out, and is taken
            with pytest.raises(store.Taken, match="four"):
                s.publish(meta, lease=stale)
            s.publish(meta, lease=now)
    assert s.number() == 2
    with s.lease("five"):
        pass
    import socket
    import subprocess
    import sys

    ended = subprocess.Popen([sys.executable, "-c", ""])
    ended.wait()
    dead = s.lease(f"{socket.gethostname()} {ended.pid}")
    dead.__enter__()  # its process is gone: the lease can be taken at once
    with s.lease(), pytest.raises(store.Taken), s.lease("not this one"):
        pass
    s.lease("another-machine 1").__enter__()
    with pytest.raises(store.Taken), s.lease():  # whether that one lives isn't known
        pass
    s._put(f"lease/{s._numbers('lease')[-1] + 1}", '{"owner": "x", "until": 0}')
    e = Engine(spark, str(tmp_path / "i"))
    with s.lease("other"), pytest.raises(store.Taken):
        e.build(spark.createDataFrame([], "file string, content string, hash string"), "2024-01-01T00:00:00Z")


def test_a_replayed_batch_publishes_nothing(spark, tmp_path):
    root = tmp_path / "src"
    write(root, a="def f():\n    pass\n", b="def g():\n    return f()\n")
    read = lambda: files.read_tree(spark, str(root))
    e = Engine(spark, str(tmp_path / "index"), {"all": "."})
    with pytest.raises(ValueError):
        e.update(read(), "2024-01-01T00:00:00Z")
    e.build(read(), "2024-01-01T00:00:00Z", now=1)
    write(root, a="def h():\n    pass\n")
    changes = spark.createDataFrame([("a.py", "M")], "file string, status string")
    changes.write.parquet(str(tmp_path / "in"))
    handle = e.on_batch(read, lambda: "2024-01-02T00:00:00Z", now=2)
    velocity.watch_changes(spark, str(tmp_path / "in"), changes.schema, handle, str(tmp_path / "state"))
    number, rows = e.store.number(), e.store.read("health").count()
    assert number == 2 and rows == 2 and {"a.py::h"} < {r.id for r in e.units.collect()}
    # The query dies before it has noted the batch: it comes again, here from a lost state.
    velocity.watch_changes(spark, str(tmp_path / "in"), changes.schema, handle, str(tmp_path / "lost"))
    assert (e.store.number(), e.store.read("health").count()) == (number, rows)
    handle(changes, 1)
    assert e.store.number() == number + 1


def test_migration(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    write(root, a="def f():\n    pass\n")
    e = Engine(spark, str(tmp_path / "index"), {"all": "."})
    e.build(files.read_tree(spark, str(root)), "2024-01-01T00:00:00Z", now=1)
    text = {r.area: r.text for r in e.area_documents().collect()}["map"]
    assert e.map_is_current(text) and not e.map_is_current("state: other\n") and e.exit_code(files.read_tree(spark, str(root))) == 0
    monkeypatch.setattr(schema, "SCHEMA_VERSION", 3)
    with pytest.raises(ValueError, match="migrate"):
        e.units.count()
    with pytest.raises(ValueError, match="no step"):
        e.migrate({1: lambda s: {}}, 3)
    named = lambda s: {"units": s.read_any("units", schema.UNITS).withColumn("name", relink.F.upper("name"))}
    assert e.migrate({1: named, 2: lambda s: {}}, 3) == [1, 2]
    assert {r.name for r in e.units.collect()} == {"A", "F"} and e.edges.count() == 0 and e.migrate({}, 3) == []
    e.store.check_version()
