import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["edges_canonical", "csr_offsets", "edge_ids", "triangles", "arc_support", "incidence_runs", "prune_low_degree", "trussness_hindex", "balanced_cuts", "summary", "arc_index", "triangle_count_arcs", "vertex_cuts", "first_mismatch", "edges_file", "dataset_sinks", "triangles_unordered", "trussness_wedge", "search_keys"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    sql = entry.oracle_sql()[name]
    columns = [d[0] for d in con.execute(sql).description]
    want = sorted(con.execute(sql).fetchall())
    assert sorted(tuple(r) for r in entry.queries()[name](spark, DIR).select(columns).collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
