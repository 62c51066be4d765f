"""Registered graph queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import model as M
from edgeloom.operators import triangles as T
from edgeloom.operators import truss as K
from edgeloom.operators.blocks import Packed
from edgeloom.operators.twins import truss_of_groups
from edgeloom.plans import summary as S
from edgeloom.plans.materialize import cut, new_path
from edgeloom.sources.derived import graph, graph_sql, members
from edgeloom.sources.graph_files import read_edges, write_csv, write_edges, write_json

#: The graph of all rows of lineitem; the plain names are on the rows with l_returnflag = 'R'.
WHOLE = "part_order"

Query = Callable[[SparkSession, str], DataFrame]


def _on(f: Callable[[DataFrame], DataFrame], name: str = "g_part_r") -> Query:
    return lambda spark, sf_dir: f(graph(spark, sf_dir, name))


def _packed(f: Callable[[Packed], DataFrame], name: str) -> Query:
    """On packed edges, made from the groups without rows of pairs."""
    return lambda spark, sf_dir: f(Packed.of_groups(members(spark, sf_dir, name)))


def _probe(edges: DataFrame) -> DataFrame:
    """Every edge's ends in reverse, and each pair one further on."""
    pairs = edges.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("u").alias("b")), F.struct(F.col("u").alias("a"), (F.col("v") + 1).alias("b"))))).distinct()
    return M.edge_probe(edges, pairs)


def _ranges(edges: DataFrame) -> DataFrame:
    """A range for each vertex: from its id, as many values as its degree less 9 (none if negative)."""
    return M.multi_arange(M.degrees(edges).select(F.col("v").alias("i"), F.col("v").alias("start"), (F.col("deg") - 9).alias("n")))


def _history(edges: Packed) -> DataFrame:
    return edges.sparkSession.createDataFrame(K.peel_history(edges), "round long, k long, alive long, peeled long")


def _rounds(edges: Packed) -> DataFrame:
    return edges.sparkSession.createDataFrame([K.round_counts(K.peel_history(edges))], "rounds_peel long, rounds_arr long")


def _file_round_trip(edges: DataFrame) -> DataFrame:
    path = new_path(edges.sparkSession, "edges-file")
    write_edges(edges, path)
    return read_edges(edges.sparkSession, path)


def _sink_round_trip(edges: Packed) -> DataFrame:
    """The dataset row as the JSON and the CSV sink give it back."""
    spark = edges.sparkSession
    row = cut(S.dataset_row(edges), "dataset-row")
    found = None
    for sink, write, read in (("json", write_json, spark.read.schema(row.schema).json), ("csv", write_csv, spark.read.schema(row.schema).option("header", True).csv)):
        path = new_path(spark, f"sink-{sink}")
        write(row, path)
        back = read(path).select(F.lit(sink).alias("sink"), "*")
        found = back if found is None else found.unionByName(back)
    return found


def _first_mismatch(edges: Packed) -> DataFrame:
    """The first edge whose truss value is not its number of triangles."""
    return S.first_mismatch(K.truss(edges), T.support(edges).withColumnRenamed("sup", "k"))


def _each(name: str) -> dict[str, Query]:
    """The queries on one graph."""
    return {
        "edges_canonical": _on(lambda e: e, name),
        "arcs_symmetric": _on(M.arcs, name),
        "degrees": _on(M.degrees, name),
        "csr_offsets": _on(M.csr_offsets, name),
        "out_degree": _on(M.out_degree, name),
        "edge_ids": _on(M.edge_ids, name),
        "cantor_codes": _on(M.pair_codes, name),
        "edge_probe": _on(_probe, name),
        "search_keys": _on(M.search_keys, name),
        "multi_arange": _on(_ranges, name),
        "wedge_counts": _on(T.wedge_counts, name),
        "triangles": _packed(T.triangles, name),
        "triangles_unordered": _packed(T.triangles_unordered, name),
        "triangle_count": _packed(T.triangle_count, name),
        "support": _packed(T.support, name),
        "arc_support": _packed(T.arc_support, name),
        "incidence_runs": _packed(T.incidence_runs, name),
        "prune_low_degree": _on(lambda e: K.prune_low_degree(e, 4), name),
        "peel_history": _packed(_history, name),
        "trussness": _packed(lambda e: K.truss(e, "peel"), name),
        "ktruss_subgraph": _packed(lambda e: K.ktruss_subgraph(e, 2), name),
        "multik_alive": _packed(lambda e: K.multi_k_alive(e, 8), name),
        "trussness_hindex": _packed(lambda e: K.truss(e, "hindex"), name),
        "trussness_multik": _packed(lambda e: K.truss(e, "multi_k"), name),
        "trussness_wedge": _packed(lambda e: K.truss(e, "wedge"), name),
        "truss_histogram": _packed(lambda e: S.histogram(K.truss(e)), name),
        "innermost_truss": _packed(lambda e: S.innermost(K.truss(e)), name),
        "summary": _packed(S.summary, name),
        "dataset_row": _packed(S.dataset_row, name),
        "balanced_cuts": _on(lambda e: T.balanced_cuts(e, 8), name),
        "missing_edges": _packed(T.missing_edges, name),
        "check_truss": _packed(S.check_truss, name),
        "check_triangles": _packed(S.check_triangles, name),
        "check_summary": _packed(S.check_summary, name),
        "round_count": _packed(_rounds, name),
        "arc_index": _on(M.arc_index, name),
        "triangle_count_arcs": _packed(T.triangle_count_from_arcs, name),
        "vertex_cuts": _on(lambda e: T.vertex_cuts(e, 8), name),
        "first_mismatch": _packed(_first_mismatch, name),
        "check_multik": _packed(lambda e: S.check_truss(e, ("peel", "multi_k")), name),
        "edges_file": _on(_file_round_trip, name),
        "dataset_sinks": _packed(_sink_round_trip, name),
    }


def queries() -> dict[str, Query]:
    found = _each("g_part_r") | {f"{q}_{WHOLE}": f for q, f in _each(WHOLE).items()}
    of_groups = {"trussness_orders": "g_cust_day", "trussness_users": "user_hour"}
    return found | {q: lambda spark, sf_dir, name=name: truss_of_groups(members(spark, sf_dir, name)) for q, name in of_groups.items()}


def _edges(name: str = "g_part_r") -> str:
    return f"WITH RECURSIVE e AS MATERIALIZED ({graph_sql(name)})"


def _truss(name: str = "g_part_r") -> str:
    """Edges alive at the start of each round, by round and threshold; k: the threshold at which each goes."""
    return _edges(name) + """,
 eid AS MATERIALIZED (SELECT row_number() OVER (ORDER BY u, v) - 1 AS id, u, v FROM e),
 t AS MATERIALIZED (SELECT a.id x, b.id y, c.id z FROM eid a JOIN eid b ON a.v = b.u JOIN eid c ON c.u = a.u AND c.v = b.v),
 inc AS MATERIALIZED (SELECT x e, y o1, z o2 FROM t UNION ALL SELECT y, x, z FROM t UNION ALL SELECT z, x, y FROM t),
 rec(id, k, it) AS (
  SELECT id, 0::BIGINT, 0::BIGINT FROM eid
  UNION ALL
  SELECT id, CASE WHEN npeel > 0 THEN k ELSE k + 1 END, it + 1 FROM (
   SELECT r.id, r.k, r.it, coalesce(s.c, 0) sup, sum(CASE WHEN coalesce(s.c, 0) <= r.k THEN 1 ELSE 0 END) OVER () npeel
   FROM rec r LEFT JOIN (SELECT i.e, count(*) c FROM inc i JOIN rec p ON p.id = i.e JOIN rec q ON q.id = i.o1 JOIN rec w ON w.id = i.o2 GROUP BY i.e) s ON s.e = r.id)
  WHERE NOT (sup <= k)),
 truss AS MATERIALIZED (SELECT u, v, CAST(max(k) AS BIGINT) k FROM rec JOIN eid USING (id) GROUP BY u, v),
 rounds AS MATERIALIZED (SELECT it, k, alive, alive - coalesce(lead(alive) OVER (ORDER BY it), 0) AS peeled
  FROM (SELECT it, max(k) k, count(*) alive FROM rec GROUP BY it))
"""


def oracle_sql() -> dict[str, str]:
    found = _each_sql("g_part_r")
    found |= {"trussness_orders": _truss("g_cust_day") + "SELECT u, v, k FROM truss", "trussness_users": _truss("user_hour") + "SELECT u, v, k FROM truss"}
    # the whole graph takes too many rounds for recursive SQL
    return found | {f"{q}_{WHOLE}": sql for q, sql in _each_sql(WHOLE).items() if " rec(" not in sql}


def _each_sql(name: str) -> dict[str, str]:
    e, t = _edges(name), _truss(name)
    a = e + ", arcs AS (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e), deg AS (SELECT src AS v, count(*) AS deg FROM arcs GROUP BY src)"
    tri = e + ", t AS (SELECT a.u, a.v, b.v AS w FROM e a JOIN e b ON a.v = b.u JOIN e c ON c.u = a.u AND c.v = b.v)"
    sides = tri + ", s AS (SELECT u, v, count(*) c FROM (SELECT u, v FROM t UNION ALL SELECT u, w FROM t UNION ALL SELECT v, w FROM t) GROUP BY u, v), sup AS (SELECT e.u, e.v, coalesce(c, 0) AS sup FROM e LEFT JOIN s USING (u, v))"
    ids = ", ids AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS eid, u, v FROM e)"
    all_k = t + "SELECT u, v, k FROM truss"
    high = "SELECT x, count(*) d FROM (SELECT u x FROM {0} UNION ALL SELECT v FROM {0}) GROUP BY x"
    none = "SELECT CAST(0 AS BIGINT) AS mismatches"
    cuts = e + """, od AS (SELECT u, count(*) c FROM e GROUP BY u),
 w AS (SELECT e.u, e.v, coalesce(c, 0) AS n FROM e LEFT JOIN od ON od.u = e.v),
 p AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS pos, sum(n) OVER (ORDER BY u, v) AS upto FROM w),
 g AS (SELECT i, (i * (SELECT sum(n) FROM w)) // 8 AS target FROM range(1, 8) r(i)),
 c AS (SELECT i, min(pos) AS cut FROM g JOIN p ON upto >= target GROUP BY i UNION ALL SELECT 0, 0 UNION ALL SELECT 8, (SELECT count(*) FROM e))
 SELECT CAST(i AS BIGINT) AS part, CAST(cut AS BIGINT) AS lo, CAST(lead(cut) OVER (ORDER BY i) AS BIGINT) AS hi FROM c QUALIFY hi IS NOT NULL"""
    return {
        "edges_canonical": e + " SELECT u, v FROM e",
        "arcs_symmetric": a + " SELECT src, dst FROM arcs",
        "degrees": a + " SELECT v, deg FROM deg",
        "csr_offsets": a + " SELECT v, deg, CAST(coalesce(sum(deg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM deg",
        "out_degree": e + " SELECT u, count(*) AS outdeg FROM e GROUP BY u",
        "edge_ids": e + ids + " SELECT eid, u, v FROM ids",
        "cantor_codes": e + " SELECT u, v, (u + v) * (u + v + 1) // 2 + v AS code FROM e",
        "edge_probe": e + ids + ", p AS (SELECT v AS a, u AS b FROM e UNION SELECT u, v + 1 FROM e) SELECT a, b, eid IS NOT NULL AS found, eid FROM p LEFT JOIN ids ON ids.u = least(a, b) AND ids.v = greatest(a, b)",
        "search_keys": a + ", m AS (SELECT src AS v, max(dst) AS max_neighbor FROM arcs GROUP BY src) SELECT v, max_neighbor, CAST(coalesce(sum(max_neighbor + 1) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS mxx FROM m",
        "multi_arange": a + " SELECT v AS i, unnest(range(v, v + deg - 9)) AS x FROM deg WHERE deg > 9",
        "wedge_counts": e + ", od AS (SELECT u, count(*) c FROM e GROUP BY u) SELECT e.u, e.v, coalesce(c, 0) AS wedges FROM e LEFT JOIN od ON od.u = e.v",
        "triangles": tri + " SELECT u, v, w FROM t",
        "triangles_unordered": tri + " SELECT u, v, w FROM t",
        "triangle_count": tri + " SELECT count(*) AS n FROM t",
        "support": sides + " SELECT u, v, sup FROM sup",
        "arc_support": sides + " SELECT u AS src, v AS dst, sup FROM sup UNION ALL SELECT v, u, sup FROM sup",
        "incidence_runs": sides + ids + " SELECT eid, CAST(coalesce(sum(sup) OVER (ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, sup AS len FROM ids JOIN sup USING (u, v) WHERE sup > 0",
        "prune_low_degree": e + f""", rec(u, v, it) AS (
  SELECT u, v, 0::BIGINT FROM e UNION ALL
  SELECT r.u, r.v, r.it + 1 FROM rec r JOIN ({high.format("rec")}) a ON a.x = r.u JOIN ({high.format("rec")}) b ON b.x = r.v
  WHERE a.d > 4 AND b.d > 4 AND EXISTS (SELECT 1 FROM ({high.format("rec")}) c WHERE c.d <= 4)),
 last AS (SELECT u, v FROM rec WHERE it = (SELECT max(it) FROM rec)), dg AS ({high.format("last")})
 SELECT u, v FROM last JOIN dg a ON a.x = u JOIN dg b ON b.x = v WHERE a.d > 4 AND b.d > 4""",
        "peel_history": t + "SELECT row_number() OVER (ORDER BY it) - 1 AS round, k, alive, peeled FROM rounds WHERE peeled > 0",
        "trussness": all_k,
        "ktruss_subgraph": t + "SELECT u, v FROM truss WHERE k >= 2",
        "multik_alive": t + "SELECT j, (SELECT count(*) FROM truss WHERE k > j) AS alive FROM range(0, 8) r(j)",
        "trussness_hindex": all_k,
        "trussness_multik": all_k,
        "trussness_wedge": all_k,
        "truss_histogram": t + "SELECT k, count(*) AS n FROM truss GROUP BY k",
        "innermost_truss": t + "SELECT u, v FROM truss WHERE k = (SELECT max(k) FROM truss)",
        "summary": t + "SELECT (SELECT max(v) + 1 FROM e) AS vertex_count, (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS active_vertices, 2 * count(*) AS edge_count, count(*) AS undirected_edges, (SELECT count(*) FROM t) AS triangle_count, max(k) AS k_max, CAST(sum(k) AS BIGINT) AS k_sum FROM truss",
        "dataset_row": t + "SELECT (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS v, count(*) AS e, (SELECT max(d) FROM (SELECT count(*) d FROM (SELECT u x FROM e UNION ALL SELECT v FROM e) GROUP BY x)) AS d_max, (SELECT count(*) FROM t) AS triangles, max(k) AS k_max FROM truss",
        "balanced_cuts": cuts,
        "missing_edges": sides + " SELECT u, v FROM sup WHERE sup = 0",
        "check_truss": none,
        "check_triangles": none,
        "check_summary": none,
        "check_multik": none,
        "arc_index": a + ids + ", n AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS arc, src, dst FROM arcs) SELECT n.src, n.dst, n.arc, b.arc AS rev, eid FROM n JOIN n b ON b.src = n.dst AND b.dst = n.src JOIN ids ON ids.u = least(n.src, n.dst) AND ids.v = greatest(n.src, n.dst)",
        "triangle_count_arcs": tri + " SELECT count(*) AS n FROM t",
        "vertex_cuts": a + """, w AS (SELECT src AS v, sum(deg) AS n FROM arcs JOIN deg ON deg.v = dst GROUP BY src),
 p AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto FROM w), s AS (SELECT sum(n) AS total, max(v) + 1 AS last FROM w),
 c AS (SELECT DISTINCT cut FROM (SELECT min(v) + 1 AS cut FROM range(1, 8) r(i) JOIN s ON true JOIN p ON upto * 8 >= i * total GROUP BY i UNION ALL SELECT 0 UNION ALL SELECT last FROM s))
 SELECT CAST(row_number() OVER (ORDER BY cut) - 1 AS BIGINT) AS part, CAST(cut AS BIGINT) AS lo, CAST(lead(cut) OVER (ORDER BY cut) AS BIGINT) AS hi FROM c QUALIFY hi IS NOT NULL""",
        "first_mismatch": t.rstrip() + ", s AS (SELECT e, count(*) c FROM inc GROUP BY e), d AS (SELECT u, v, k, coalesce(c, 0) AS k2 FROM truss JOIN eid USING (u, v) LEFT JOIN s ON s.e = id) SELECT u, v, k, k2 FROM d WHERE k <> k2 ORDER BY u, v LIMIT 1",
        "edges_file": e + " SELECT u, v FROM e",
        "dataset_sinks": t + "SELECT sink, r.* FROM (VALUES ('json'), ('csv')) x(sink), (SELECT (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS v, count(*) AS e, (SELECT max(d) FROM (SELECT count(*) d FROM (SELECT u x FROM e UNION ALL SELECT v FROM e) GROUP BY x)) AS d_max, (SELECT count(*) FROM t) AS triangles, max(k) AS k_max FROM truss) r",
        "round_count": t + "SELECT CAST(count(*) AS BIGINT) AS rounds_peel, CAST(CASE WHEN max(k) = 0 THEN 0 ELSE count(*) FILTER (WHERE peeled > 0 AND k > 0) + max(k) END AS BIGINT) AS rounds_arr FROM rounds",
    }
