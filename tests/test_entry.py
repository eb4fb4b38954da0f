"""The registered queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__
from callweave.plans import catalog, changes, details, learned

SF = "/root/testdata/sf0.001"
SOME = ["closure_risk", "callers_d2", "health_coupling", "silo_report", "link_external", "hash_diff", "knn_l2", "stream_sessions", "tags_array", "refactor_sequence", "reading_order", "context_pack", "resolve_target", "ownership", "coverage_overlap", "containing_unit_innermost", "note_ancestry", "health_metrics", "hybrid_search", "transitive_callers"]


def test_names_agree():
    q = __spark_entry__.queries()
    own = {*catalog.QUERIES, *details.QUERIES, *changes.QUERIES}
    assert len(own) == len(catalog.QUERIES) + len(details.QUERIES) + len(changes.QUERIES)
    assert own <= set(q) and own <= set(__spark_entry__.oracle_sql()) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", [*SOME, *details.QUERIES, *changes.QUERIES, *learned.ORACLE])
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, result.fetchall()))
