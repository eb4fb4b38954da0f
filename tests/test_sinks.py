import pytest

from callweave import sinks


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from callweave.lineage import shared_dir

    def session(master, **conf):
        own = SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: own))

    assert shared_dir(session("local[4]")).startswith("file:///") and shared_dir(session("local"))
    assert shared_dir(session("spark://x:7077", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_documents_and_lookups(spark, tmp_path):
    u = spark.createDataFrame([("x/a::f", "f", "x/a.py", "function", 1, 3, "def f()", "Says | so"), ("y::g", "g", "y.py", "function", 1, 3, None, None)], "id string, name string, file string, type string, line_start int, line_end int, signature string, docstring string")
    e = spark.createDataFrame([("y::g", "x/a::f", "CALL")], "src_id string, dst_id string, rel_type string")
    a = spark.createDataFrame([("all", "."), ("x", "X/")], "name string, path string")
    docs = {r.area: r.text for r in sinks.area_documents(u, e, a).collect()}
    assert "| f | function | x/a.py | 1 | 0 | Says \\| so |" in docs["x"] and "| g |" in docs["all"] and "| g |" not in docs["x"]
    text = sinks.area_map(u, a, "abc").first().text
    assert "| all | 2 |" in text and sinks.map_is_current(text, "abc") and not sinks.map_is_current(text, "abd")
    assert '"kind":"unit"' in sinks.as_json(u, "kind=unit").first().json
    assert sinks.find_units(u, name="g").count() == 1 and sinks.find_units(u, file="A.PY", line=2).first().name == "f"
    assert sinks.migration_steps(1, 3, [1, 2]) == [1, 2]
    with pytest.raises(ValueError):
        sinks.migration_steps(2, 1, [])


def test_health_table_has_no_separators(spark):
    rows = spark.createDataFrame([(1, 1234.5, None), (2, 0.25, 7.0)], "build_ts long, coupling double, cohesion double")
    assert [r.line for r in sinks.health_table(rows, ["coupling", "cohesion"]).collect()] == ["| 1 | 1234.5000 | - |", "| 2 | 0.2500 | 7.0000 |"]
