"""Parsers, text formats, the store and the engine, end to end."""

import pytest

from callweave.engine import Engine
from callweave import sinks
from callweave.operators import confidence, drift, intent
from callweave.sources import config, coverage, files, git, parse, trees
from callweave.streaming import velocity
from pyspark.sql import functions as F


def tree(tmp_path, **contents):
    for name, text in contents.items():
        p = tmp_path / name.replace("__", "/").replace("_py", ".py")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


A = 'import helper\n\ndef run(x):\n    """Runs."""\n    return helper(x)\n'
B = "def helper(x):\n    return len(x)\n"


def test_build_update_rebuild(spark, tmp_path):
    root = tree(tmp_path / "src", pkg__a_py=A, lib__b_py=B)
    (tmp_path / "src/pkg/skip.min.js").write_text("x")
    (tmp_path / "src/lib/bad.py").write_text("def (:\n")
    now = files.read_tree(spark, root)
    assert sorted(r.file for r in now.collect()) == ["lib/b.py", "lib/bad.py", "pkg/a.py"]
    e = Engine(spark, str(tmp_path / "index"), {"pkg": "pkg/", "lib": "lib/"})
    e.build(now, "2024-01-01T00:00:00Z")
    e.store.check_version()
    edges = {(r.src_id, r.dst_id, r.rel_type) for r in e.edges.collect()}
    assert ("pkg/a.py::a", "lib/b.py::helper", "EXTERNAL_CALL") in edges
    assert ("pkg/a.py::a", "lib/b.py::helper", "IMPORT") in edges
    assert ("lib/b.py::b", "external::len", "RUNTIME_BOUNDARY") in edges
    unit = e.target("run").first()
    assert (unit.docstring, unit.signature, unit.line_start) == ("Runs.", "def run(x):", 3)
    assert e.validate(files.read_tree(spark, root)).count() == 0
    (tmp_path / "src/lib/b.py").write_text("# moved\n" + B + "\ndef more():\n    return helper(1)\n")
    later = files.read_tree(spark, root)
    assert {(r.file, r.drift) for r in e.validate(later).collect()} == {("lib/b.py", "structural")}
    e.update(later, "2024-01-02T00:00:00Z")
    other = Engine(spark, str(tmp_path / "again"), e.areas)
    other.build(files.read_tree(spark, root), "2024-01-02T00:00:00Z")
    for table in ("units", "edges", "file_hashes"):
        assert sorted(map(str, e.store.read(table).collect())) == sorted(map(str, other.store.read(table).collect())), table
    e.snapshot_health(1704153600)
    assert e.store.read("health").count() == 3  # one of the build, one of the update
    assert e.search("helper", 2).filter("source = 'matched'").count() == 2
    assert e.health().count() == 1 and set(e.onboard()) >= {"entry_points", "hotspots"}
    assert e.caller_closure().count() == e.units.count()
    assert e.vuln("len").count() >= 1
    assert e.confidence(later, 72.0).first().confidence < 0.9


def test_trees_are_read_by_their_listing(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a b").mkdir()
    for name in ("node_modules/x.js", "a b/[odd]{1},2.py", "y.txt", "plain.py"):
        (tmp_path / name).write_text(name)
    assert sorted((r.file, r.content) for r in files.read_tree(spark, str(tmp_path)).collect()) == [("a b/[odd]{1},2.py",) * 2, ("plain.py",) * 2]
    assert files.read_tree(spark, str(tmp_path / "node_modules")).count() == 1
    assert files.read_tree(spark, str(tmp_path), tracked=(".nothing",)).count() == 0


def test_listing_by_tasks_equals_a_walk(spark, tmp_path):
    import os

    for k in range(120):
        p = tmp_path / "/".join(f"d{(k * 7 + i) % (i + 3)}" for i in range(k % 6))
        p.mkdir(parents=True, exist_ok=True)
        (p / f"f{k}.py").write_text("x = 1\n" * k)
    for name in ("__init__.py", ".hidden/x.py", "_own/y.py", "a%20b/z 1.py", "vendor/v.py", "deep/vendor/w.py", "gen/a.py", "gen/keep/b.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    os.symlink(tmp_path, tmp_path / "d0" / "up")
    os.symlink(tmp_path / "__init__.py", tmp_path / "link.py")
    want = {(os.path.relpath(os.path.join(d, f), tmp_path), os.path.getsize(os.path.join(d, f))) for d, _, fs in os.walk(tmp_path) for f in fs}
    for step in (1, 3, 1000):
        got = [tuple(r) for r in trees.list_tree(spark, str(tmp_path), step=step).collect()]
        assert len(got) == len(want) and set(got) == want
    # A rule leaves out a folder, but for what a later one lets in.
    rules = ("vendor/", "gen/", "!gen/keep/")
    seen = {r.file for r in trees.list_tree(spark, str(tmp_path), rules).collect()}
    assert {f for f, _ in want} - seen == {"vendor/v.py", "deep/vendor/w.py"} or "gen/keep/b.py" in seen
    got = {r.file: r.content for r in files.read_tree(spark, f"file://{tmp_path}", rules).collect()}
    assert set(got) == {f for f, _ in want} - {"vendor/v.py", "deep/vendor/w.py", "gen/a.py"}
    assert got["a%20b/z 1.py"] == "a%20b/z 1.py" and got["link.py"] == "__init__.py"
    with pytest.raises(Exception, match="gone"):
        trees.list_tree(spark, str(tmp_path / "gone"))


def test_state_hash(spark):
    import hashlib

    from callweave.operators import drift

    rows = [(f"f{k}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(500)]
    want = hashlib.sha256("\n".join(sorted(h for _, h in rows)).encode()).hexdigest()
    df = spark.createDataFrame(rows, "file string, hash string")
    assert drift.state_hash(df.repartition(7)).first()[0] == want
    assert drift.state_hash(df.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()


CONFIG = """lobes:
  pkg: pkg/
  lib: lib/
tracked_extensions: [.py, .xyz]
embedding_model: local
memory:
  decay_half_life_days: 7
"""


def test_config_and_intent(spark, tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text(CONFIG)
    c = config.load_config(str(path))
    assert c.areas == {"pkg": "pkg/", "lib": "lib/"} and c.tracked == (".py", ".xyz") and c.half_life == 7.0 and c.stale == 0.1
    assert len(c.warnings) == 1 and ".xyz" in c.warnings[0]
    path.write_text("lobes: {}\ntracked_extensions: []\nembedding_model: odd\n")
    assert len(config.load_config(str(path)).warnings) == 3
    path.write_text("lobes: {}\n")
    with pytest.raises(KeyError):
        config.load_config(str(path))
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.yaml"))
    assert config.load_intent(spark, str(tmp_path / "none.yaml")) == (None, [])
    doc = tmp_path / "intent.yaml"
    doc.write_text("sprint:\n  name: s\n  priority_lobes: [pkg]\nincidents:\n  - id: 1\n    affected_lobes: [gone]\narchitecture:\n  avoid_patterns: [x]\n# " + "y" * 60_000 + "\n")
    row, warnings = config.load_intent(spark, str(doc))
    got = row.first()
    assert (got.sprint, got.priority, got.avoid, got.incidents[0].status, got.goal, got.concerns) == ("s", ["pkg"], ["x"], "open", None, []) and len(warnings) == 1
    assert [r.area for r in intent.unknown_areas(row, ["pkg"]).collect()] == ["gone"]


def test_engine_hooks_notes_and_git(spark, tmp_path):
    root = tree(tmp_path / "src", pkg__a_py=A, lib__b_py=B)
    (tmp_path / "config.yaml").write_text(CONFIG)
    e = Engine.of_config(spark, str(tmp_path / "index"), str(tmp_path / "config.yaml"))
    day = 86400
    e.build(files.read_tree(spark, root), "2024-01-01T00:00:00Z", now=10 * day, documents=str(tmp_path / "docs"))
    assert {r.area for r in spark.read.json(str(tmp_path / "docs")).collect()} == {"pkg", "lib", "map"}
    note = "id string, unit_id string, area string, type string, title string, body string, author string, created_ts long, tags array<string>, decay_score double, status string"
    rows = [(i, u, "pkg", "warning", f"title {i}", "body", "me", 10 * day, ["t"], 1.0, "active") for i, u in (("1", "pkg/a.py::run"), ("2", "lib/b.py::helper"), ("3", None))]
    e.remember(spark.createDataFrame(rows, note))
    edge = "from_id string, to_id string, rel_type string, created_ts long, author string"
    e.link(spark.createDataFrame([("1", "2", "caused", 1, "me"), ("2", "3", "caused", 1, "me")], edge))
    e.link(spark.createDataFrame([("1", "2", "caused", 2, "you")], edge))
    assert {(r.from_id, r.created_ts) for r in e.store.read("note_edges").collect()} == {("1", 2), ("2", 1)}
    with pytest.raises(ValueError):
        e.link(spark.createDataFrame([("1", "9", "caused", 2, "you")], edge))
    with pytest.raises(ValueError):
        e.link(spark.createDataFrame([("1", "2", "odd", 2, "you")], edge))
    with pytest.raises(ValueError):
        e.remember(spark.createDataFrame([(*rows[0][:3], "odd", *rows[0][4:])], note))
    assert [r.id for r in e.trace(spark.createDataFrame([("3",)], "id string")).orderBy("depth").collect()] == ["3", "2", "1"]
    # An update by what git says: the changed unit's note pays, all decay by a half life.
    (tmp_path / "src/lib/b.py").write_text("def helper(x):\n    return 1\n")
    status = git.status_files(spark.createDataFrame([(" M lib/b.py\n?? notes.txt\n",)], "text string"))
    assert [(r.file, r.status) for r in e.changes(None, status=status).collect()] == [("lib/b.py", "M")]
    e.update(files.read_tree(spark, root), "2024-01-02T00:00:00Z", now=17 * day, status=status)
    score = {r.id: r.decay_score for r in e.store.read("notes").collect()}
    assert score["1"] == pytest.approx(0.5, abs=1e-3) and score["2"] == pytest.approx(0.15, abs=1e-3)
    assert e.store.read("health").count() == 2 and e.edges.filter("dst_id = 'external::len'").count() == 0
    e.forget(spark.createDataFrame([("2",)], "id string"))
    assert {r.id for r in e.list_notes(include_stale=True).collect()} == {"1", "3"} == {r.id for r in e.store.read("note_vectors").collect()}
    assert e.store.read("note_edges").count() == 0
    e.vuln("helper", now=18 * day)
    (tmp_path / "src/lib/b.py").write_text("import os\ndef helper(x):\n    return os.system(x)\n")
    e.update(files.read_tree(spark, root), "2024-01-03T00:00:00Z", now=18 * day)
    e.vuln("os.system", now=18 * day)
    warned = [r for r in e.list_notes().collect() if r.author == "agent:vuln"]
    assert [(r.unit_id, r.area, r.tags[2]) for r in warned] == [("lib/b.py::b", "lib", "os.system")]  # the first unit that holds the line
    assert {r.area: r.units for r in e.list_areas().collect()} == {"pkg": 2, "lib": 2}
    assert {r.id for r in e.search("helper", 3, area="LI").collect()} <= {"lib/b.py::helper", "lib/b.py::b"}
    assert "confidence" in e.decorated(e.units, files.read_tree(spark, root), 1.0).first().json
    assert set(e.onboard()) >= {"things_to_know"}
    assert e.health_history("coupling").count() == 3 and e.export_notes().count() == 3
    with pytest.raises(ValueError):
        e.health_history("nothing")
    assert sinks.exit_code(drift.verdict(e.validate(files.read_tree(spark, root)))) == 0
    mute = Engine(spark, str(tmp_path / "mute"), embed="none")
    mute.build(files.read_tree(spark, root), "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        mute.search("helper")


def test_snapshots_are_numbered(spark, tmp_path):
    from callweave import store

    s = store.Store(spark, str(tmp_path / "index"))
    meta = lambda v: {"meta": spark.createDataFrame([("schema_version", v)], store.schema.META)}
    assert s.current() is None and s.read("meta").count() == 0
    names = [s.publish(meta("1")) for _ in range(5)]
    assert s.current() == names[-1]
    (tmp_path / "index/current/.draft").write_text("torn")  # of a writer that died
    assert s.current() == names[-1] and not (tmp_path / "index" / names[0]).exists() and (tmp_path / "index" / names[-2]).exists()
    held, s._pointers = s._pointers, lambda: [4]
    with pytest.raises(RuntimeError):  # another writer took the number
        s.publish(meta("2"))
    s._pointers = held
    assert s.read("meta").first()["value"] == "1"
    s.publish(meta("7"))
    with pytest.raises(ValueError):
        s.check_version()


def test_ignore_rules(spark):
    f = lambda p, rules: spark.range(1).select(files.ignored(F.lit(p), rules)).first()[0]
    assert f("a/node_modules/x.js", files.DEFAULT_IGNORE) and f("a.min.js", files.DEFAULT_IGNORE)
    assert not f("builder/a.py", files.DEFAULT_IGNORE)
    assert f("docs/a.md", ("docs/*.md",)) and not f("x/docs/a.md", ("docs/*.md",))
    assert f("a/b/c.py", ("a/**",)) and f("a/z/c.py", ("a/**/c.py",)) and not f("a.py", ("*.py", "!a.py"))


def test_area_detection(spark):
    d = lambda *p: files.detect_areas(spark.createDataFrame([(x,) for x in p], "file string"))
    assert d("src/a/x.py", "src/b/y.py", "doc/z.md") == {"a": "src/a/", "b": "src/b/"}
    assert d("one/package.json", "two/sub/go.mod", "x/y.py") == {"one": "one/", "sub": "two/sub/"}
    assert d("one/x.py", ".git/y") == {"one": "one/"}
    assert d("x.py") == {"root": "."}


def found(file, text, lang):
    rows = list(parse.parse_file(file, text, lang))
    return [(r[2], r[5], r[6]) for r in rows if r[0] == "unit" and r[4] != "module"], [(r[5], r[-1]) for r in rows if r[1] == "call"], [r[-1] for r in rows if r[1] == "import"], {r[2]: r[8] for r in rows if r[8]}


JS = """import {a,
  b} from "x";
// function no() {}
class K extends L {
  static async run(x, y = f(1)) {
    // Runs it.
    if (x) { helper(x); }
    return this.go(y);
  }
  get size() { return 1; }
}
class Empty {}
export default async function main(a) {
  const g = (q) => q.map(z => z + "function f() {");
  function inner() { return g(a); }
  return inner();
}
const o = { meth(a) { return a; } };
"""
TS = "interface I { f(x: number): void; }\ntype T = { a: string };\nclass C<X> {\n  private m<T>(a: T): Promise<{ b: T }> {\n    return g<T>(a);\n  }\n}\n"
GO = 'package p\nimport (\n  "fmt"\n)\ntype S struct {\n  a int\n}\ntype N int\nfunc (s *S) Do(x map[string]int) (int, error) {\n  /* doc */\n  return fmt.Sprint(x), nil\n}\nfunc G[T any](x T) interface{} { return os.Open("f()") }\n'
RUST = "use std::io::{self, Read};\npub struct P<T> { x: T }\nenum E { A, B }\nimpl<T> Show for P<T> {\n    fn show(&self, c: char) -> String { let q = '{'; format_it(self.x, 'a') }\n}\npub async fn free<'a>(x: &'a str) -> u8 { P::new(x).go() }\ntrait Q { fn decl(&self); }\n"
JAVA = "import java.util.List;\npublic class A extends B {\n  public A(int x) { super(x); }\n  @Override\n  public List<String> get(int a) throws E1, E2 {\n    if (a > 0) { return foo(a); }\n    Other o = new Other(a);\n    return o.bar(a);\n  }\n  interface In { void f(int x); }\n}\nclass Bare { int x; }\n"
CPP = "#include <a.h>\nstruct S { int a; };\nstatic int add(int a, int b)\n{\n  /* adds */\n  return mul(a, b);\n}\nnamespace n { int *ptr(const char *s) { return f(s); } struct T {}; }\nclass W { int m() { return 1; } };\nint W::out() { return 2; }\n"
RUBY = "module M\n  class K < L\n    def self.run(x)\n      # Runs.\n      return 1 if x\n      x.each do |y|\n        puts(y)\n      end\n    end\n    def one = two(1)\n  end\n  class Empty; end\nend\ndef last?(a)\n  while a do\n    go(a)\n  end\nend\n"


def test_units_of_other_languages_nest():
    units, calls, imports, docs = found("a.js", JS, "javascript")
    assert units == [("run", 5, 9), ("size", 10, 10), ("Empty", 12, 12), ("main", 13, 17), ("inner", 15, 15), ("meth", 18, 18)]
    assert calls == [(5, "f"), (7, "helper"), (8, "this.go"), (14, "q.map"), (15, "g"), (16, "inner")]
    assert imports == ['import {a,\n  b} from "x"'] and docs == {"run": "Runs it."}
    assert found("a.ts", TS, "typescript")[0] == [("I", 1, 1), ("T", 2, 2), ("m", 4, 6)]
    units, calls, imports, docs = found("a.go", GO, "go")
    assert units == [("S", 5, 7), ("N", 8, 8), ("Do", 9, 12), ("G", 13, 13)] and calls == [(11, "fmt.Sprint"), (13, "os.Open")]
    assert imports == ['import (\n  "fmt"\n)'] and docs == {"Do": "doc"}
    units, calls, imports, _ = found("a.rs", RUST, "rust")
    assert units == [("P", 2, 2), ("E", 3, 3), ("show", 5, 5), ("free", 7, 7)] and calls == [(5, "format_it"), (7, "P::new")] and imports == ["use std::io::{self, Read};"]
    units, calls, _, _ = found("A.java", JAVA, "java")
    assert units == [("get", 5, 9), ("f", 10, 10), ("Bare", 12, 12)] and calls == [(6, "foo"), (7, "Other"), (8, "o.bar")]
    units, calls, imports, docs = found("a.cpp", CPP, "cpp")
    assert units == [("S", 2, 2), ("add", 3, 7), ("ptr", 8, 8), ("T", 8, 8), ("W", 9, 9)] and calls == [(6, "mul"), (8, "f")] and docs == {"add": "adds"}
    assert found("a.c", "static int\nadd(int a)\n{\n return a;\n}\nint (*fp)(int);\n#define F(x) { \\\n x }\n#if A(1) {\n", "c")[:2] == ([("add", 2, 5)], [])
    assert found("a.h", "int f(int a);\nstruct S { int x; };\nvoid g(void) ;\n", "c_header")[:2] == ([("f", 1, 1), ("S", 2, 2), ("g", 3, 3)], [])
    units, calls, _, docs = found("a.rb", RUBY, "ruby")
    assert units == [("run", 3, 9), ("one", 10, 10), ("Empty", 12, 12), ("last?", 14, 18)] and calls == [(7, "puts"), (10, "two"), (16, "go")] and docs == {"run": "Runs."}


def test_broken_files_keep_what_can_be_found():
    text = "import os\nclass K:\n    def f(self):\n        print 'x'\n        return g(1)\n\ndef h(x):\n    return x\n"
    rows = list(parse.parse_file("a.py", text, "python"))
    assert [r[0] for r in rows].count("warning") == 1
    assert found("a.py", text, "python")[:3] == ([("f", 3, 5), ("h", 7, 8)], [(5, "g")], ["import os"])
    for lang in ("javascript", "typescript", "tsx", "jsx", "go", "rust", "java", "ruby", "c", "cpp", "c_header"):
        for text in ("", "}})(", 'f( { class } "unclosed', "function f(", "/* open", "def\nend\nend"):
            assert list(parse.parse_file("a.x", text, lang))[0][4] == "module"
    assert list(parse.parse_file("a.txt", "x", None))[0][0] == "warning"


def test_deep_files_are_a_warning(spark):
    deep = {"minus.py": "x = " + "-" * 50_000 + "1", "calls.py": "def g():\n    pass\n" + "f(" * 3000 + ")" * 3000, "names.py": "def h():\n    a" + ".b" * 5000 + "(1)\n", "nest.js": "function f() {" * 3000, "sound.py": "def ok():\n    return run.all(1)\n"}
    parsed = parse.parse(spark.createDataFrame(list(deep.items()), "file string, content string")).collect()
    units = {(r.file, r.name) for r in parsed if r.kind == "unit" and r.type != "module"}
    assert {("calls.py", "g"), ("names.py", "h"), ("sound.py", "ok")} <= units
    assert {r.file for r in parsed if r.kind == "warning"} >= {"minus.py", "calls.py"}
    assert "run.all" in {r.text for r in parsed} and "a" + ".b" * 5000 in {r.text for r in parsed}


def test_dependencies_by_table(spark):
    toml = '[build-system]\nrequires = ["requests==9"]\n[project]\nname = "requests"\ndependencies = [\n  "Foo_Bar[x]>=1.2,<2",\n  "requests-toolbelt==1.0",\n]\n[tool.poetry.dependencies]\npython = "^3.10"\nRequests = {version = "^2.31", extras = ["s"]}\n"foo.bar" = "7"\n'
    rows = [("a/requirements.txt", "# requests==0\nrequests>=1.0 ; python_version > '3'\nplain\n-r other.txt\n"), ("a/pyproject.toml", toml), ("b/pyproject.toml", "[project\n"), ("c/requirements.txt", None)]
    found = coverage.dependencies(spark.createDataFrame(rows, "file string, content string"))
    get = lambda p: [tuple(r) for r in coverage.pinned(found, p).collect()]
    assert get("foo-bar") == [("Foo_Bar", "[x]>=1.2,<2", "1.2")]
    assert get("requests") == [("Requests", "^2.31", "2.31")]  # neither the build system's nor the project's name
    assert get("plain") == [("plain", "", None)] and get("request") == [] and found.count() == 7


def test_thresholds_of_the_configuration(spark, tmp_path):
    (tmp_path / "config.yaml").write_text(CONFIG + "  stale_threshold: 0.4\n  possibly_stale_threshold: 0.9\n")
    e = Engine.of_config(spark, str(tmp_path / "index"), str(tmp_path / "config.yaml"))
    note = "id string, unit_id string, area string, type string, title string, body string, author string, created_ts long, tags array<string>, decay_score double, status string"
    e.remember(spark.createDataFrame([(str(k), None, "a", "warning", "t", "b", "me", k * 86400, ["t"], 1.0, "active") for k in (0, 5, 14)], note))
    e.decay(14 * 86400)
    assert {r.id: r.status for r in e.store.read("notes").collect()} == {"0": "stale", "5": "possibly_stale", "14": "active"}


def test_tokens_by_a_tokenizer(spark):
    from callweave.functions.text import model_tokens

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([("hello world",), ("",), (None,)], "text string")
    assert [r[0] for r in rows.select(model_tokens(path)("text")).collect()] == [2, 0, 0]


def test_git_text(spark):
    one, two = "a" * 40, "b" * 40
    text = f"{one} 1 1 2\nauthor A\nauthor-mail <a@x>\n\tcode\n{one} 2 2\n\tcode\n{two} 3 3 1\nauthor-mail <b@x>\n\tauthor-mail <no@x>\n"
    df = spark.createDataFrame([("f.py", text)], "file string, text string")
    assert sorted((r.line, r.author) for r in git.blame(df).collect()) == [(1, "a@x"), (2, "a@x"), (3, "b@x")]
    diff = spark.createDataFrame([("--- a/x\n+++ b/x.py\n+ y\n+++ b/z.py\n+++ b/x.py\n",)], "text string")
    assert [r.file for r in git.diff_files(diff).orderBy("ord").collect()] == ["x.py", "z.py"]
    log = spark.createDataFrame([("\x011704067200\n\na.py\nb.py\n\x011704067300\na.py\n",), ("\x011704067400\nc.py\n\x01broken\nd.py\n",), (None,)], "text string").repartition(3)
    assert sorted((r.file, int(r.s)) for r in git.log_commits(log).select("file", F.unix_timestamp("ts").alias("s")).collect()) == [("a.py", 1704067200), ("a.py", 1704067300), ("b.py", 1704067200), ("c.py", 1704067400)]
    st = spark.createDataFrame([(" M a.py\n?? b.py\nD  c.py\n",)], "text string")
    assert {(r.file, r.status) for r in git.status_files(st).collect()} == {("a.py", "M"), ("b.py", "A"), ("c.py", "D")}


def test_coverage_and_manifests(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="a\\\\m.py"><lines><line number="1" hits="0"/><line number="2" hits="3"/></lines></class></classes></package></packages></coverage>'.replace("\\\\", "\\"))
    assert [tuple(r) for r in coverage.covered_lines(spark, str(tmp_path / "c.xml")).collect()] == [("a/m.py", 2)]
    m = spark.createDataFrame([(0, "requests-toolbelt==1.0"), (1, '    "Requests>=2.31,<3",'), (2, "other")], "ord long, line string")
    assert coverage.pinned_version(m, "requests").first().version == "2.31"
    assert coverage.pinned_version(m, "nothing").count() == 0


def test_confidence_factors(spark):
    def f(*v):
        names = ("age", "changed", "total", "languages", "dynamic")
        return spark.createDataFrame([v], "age double, changed long, total long, languages long, dynamic long").select(confidence.factors(*names)).first()[0]

    assert f(72.0, 0, 10, 0, 0) < 0.9 and f(1e6, 10, 10, 9, 5) == 0.5 and f(0.0, 0, 10, 0, 1) == pytest.approx(0.9)


def test_intent(spark):
    doc = spark.createDataFrame([("s", "g", ["a"], ["b"], [("1", "d", "high", "open", ["a"]), ("2", "d", "low", "closed", ["a"])], ["globals"], ["small"], ["a is slow"])], intent.SCHEMA)
    rows = spark.createDataFrame([(["a"],), (["b"],), (["c"],), ([],)], "areas array<string>")
    got = intent.enrich(rows, doc).collect()
    assert [r.relevance for r in got] == ["HIGH", "LOW", "MEDIUM", "UNKNOWN"]
    assert [i.id for i in got[0].open_incidents] == ["1"] and got[0].concern == "a is slow" and got[0].guidance == ["AVOID: globals", "PRINCIPLE: small"]
    assert {r.area for r in intent.unknown_areas(doc, ["a"]).collect()} == {"b"}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-{d:02d} 05:00:00", "click") for d in range(1, 20)], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    velocity.run_available(velocity.event_velocity(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    out = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in velocity.event_velocity(events).collect()}
    assert out and out <= batch  # windows past the watermark are out; the last are open
    seen = []
    velocity.watch_changes(spark, str(tmp_path / "in"), events.schema, lambda df, k: seen.append(df.count()), str(tmp_path / "state2"))
    assert sum(seen) == 19
