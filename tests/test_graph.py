import json
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import blocks as B
from edgeloom.operators import model as M
from edgeloom.operators import triangles as T
from edgeloom.operators import truss as K
from edgeloom.plans import summary as S
from edgeloom.plans.materialize import shared_dir, with_prefixes
from edgeloom.sources.graph_files import read_edges, write_csv, write_json


def complete(*nodes):
    return [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]


#: Name: edges, values (one for all, or by edge), rounds of either kind of peel.
MICRO = {
    "triangle": ([(1, 2), (1, 3), (2, 3)], 1, 2, 2),
    "path4": ([(1, 2), (2, 3), (3, 4)], 0, 1, 0),
    "diamond": ([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4)], 1, 3, 3),
    "K5": (complete(0, 1, 2, 3, 4), 3, 4, 4),
    "two_K4": (sorted(set(complete(0, 1, 2, 3) + complete(0, 1, 4, 5))), 2, 4, 4),
    "K5_tail": (complete(0, 1, 2, 3, 4) + [(4, 5), (5, 6), (4, 6), (6, 7)], {(4, 5): 1, (4, 6): 1, (5, 6): 1, (6, 7): 0}, 6, 5),
    "skip": ([(0, 1), (0, 2), (0, 4), (0, 5), (1, 4), (1, 5), (2, 4), (2, 5), (4, 5)], 2, 4, 4),
}


def frame(spark, pairs):
    return M.canonicalize(spark.createDataFrame(pairs, "src long, dst long"))


def values(df):
    return {(r.u, r.v): r.k for r in df.collect()}


def plain_peel(edges):
    live, k, out = set(edges), 0, {}
    near = {}
    while live:
        near = {}
        for a, b in live:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        gone = {(a, b) for a, b in live if len(near[a] & near[b]) <= k}
        out |= dict.fromkeys(gone, k)
        live -= gone
        k += not gone
    return out


@pytest.mark.parametrize("name", MICRO)
def test_micro_graphs(spark, name):
    edges, want, rounds, rounds_arr = MICRO[name]
    want = {e: want.get(e, 3) if isinstance(want, dict) else want for e in edges}
    df = frame(spark, [(b, a) for a, b in edges])
    told = []
    for one_task in (K.ONE_TASK, 3, 0) if name == "K5_tail" else (K.ONE_TASK,):  # in one task, after some rounds, never
        found, history = K.peel(df, one_task)
        assert values(found) == want
        assert K.round_counts(history) == (rounds, rounds_arr)
        told.append(history)
    assert all(h == told[0] for h in told)


def test_methods_agree_on_a_random_graph(spark):
    rng = random.Random(7)
    edges = [(a, b) for a, b in complete(*range(18)) if rng.random() < 0.45]
    df = frame(spark, edges)
    want = plain_peel(edges)
    for method in ("peel", "hindex", "wedge", "multi_k"):
        assert values(K.truss(df, method, chunk=2)) == want, method
    assert values(K.truss(df, "hindex", one_task=0)) == want
    assert values(K.truss(df, "multi_k", chunk=4, max_run_rows=1)) == want
    sup = {(r.u, r.v): r.sup for r in T.support(df).collect()}
    assert all(want[e] <= sup[e] for e in edges)
    assert sum(sup.values()) == 3 * T.triangle_count(df).first().n
    assert S.check_triangles(df).first().mismatches == 0
    with pytest.raises(ValueError):
        K.truss(df, "other")


def test_checks_find_planted_mismatches(spark, monkeypatch):
    df = frame(spark, complete(0, 1, 2, 3) + [(3, 4)])
    right = K.truss(df)
    wrong = right.withColumn("k", F.when(F.col("u") == 1, 7).otherwise(F.col("k")).cast("long"))
    assert S.differing_edges(right, wrong).count() == 2 and S.first_mismatch(right, wrong).first()[:] == (1, 2, 2, 7)
    assert S.differing_edges(right, right.filter("v <> 4")).collect()[0][:] == (3, 4, 0, None)
    assert S.first_mismatch(right, right).collect() == []
    monkeypatch.setattr(S, "truss", lambda e, m: wrong if m in ("peel", "wedge") else right)
    assert S.check_truss(df).first().mismatches == 2
    assert S.check_summary(df).first().mismatches == 2  # k_max and k_sum
    monkeypatch.setattr(S, "triangles_unordered", lambda e: T.triangles(e).filter("u = 0").withColumn("w", F.col("w") + 1))
    assert S.check_triangles(df).first().mismatches == 5  # 3 lost, 2 that are not there


def test_vertex_cuts_of_a_star(spark):
    got = [r[:] for r in T.vertex_cuts(frame(spark, [(0, i) for i in range(1, 9)]), 4).orderBy("part").collect()]
    # 8 arcs lead from the hub to one arc each, 8 lead from leaves to 8 each: 72 in all
    assert got == [(0, 0, 3), (1, 3, 5), (2, 5, 7), (3, 7, 9)]
    assert T.vertex_cuts(frame(spark, [(1, 1)]), 4).collect()[0][:] == (0, 0, 0)
    assert [r[:] for r in T.balanced_cuts(frame(spark, [(0, 1), (2, 3)]), 2).collect()] == [(0, 0, 0), (1, 0, 2)]


def test_prefixes(spark):
    df = spark.createDataFrame([(i, i % 3, None if i == 4 else i) for i in range(20)], "i long, g long, x long")
    got = with_prefixes(df, ["g", "i"], {"before": "x", "at": None}).orderBy("at").collect()
    total = 0
    for n, r in enumerate(got):
        assert (r.at, r.before) == (n, total)
        total += r.x or 0
    assert [r.i for r in got] == sorted(range(20), key=lambda i: (i % 3, i))


def test_no_machine_local_folder_on_a_cluster():
    def session(master, **settings):
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key.rpartition(".")[2], default))})
        return type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master})})

    assert shared_dir(session("local[8]")).startswith("file:")
    assert shared_dir(session("yarn", dir="hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_empty_graph(spark):
    none = frame(spark, [(1, 1)])
    for method in ("peel", "hindex", "wedge", "multi_k"):
        assert K.truss(none, method).collect() == []
    assert S.summary(none).first().asDict() == dict.fromkeys(S.summary(none).columns, 0)
    assert M.csr_offsets(none).collect() == [] and K.prune_low_degree(none, 1).collect() == []


FILES = {
    "a.mtx": ("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n4 4 3\n2 1\n3 2\n3 1\n", {(1, 2), (1, 3), (2, 3)}),
    "b.mtx": ("%%MatrixMarket matrix coordinate pattern general\n9 8 2\n1 2\n2 3\n", {(1, 2), (2, 3)}),
    "c.edges": ("% 3 3 3\n1 2\n2 3\n1 3\n", {(1, 2), (2, 3), (1, 3)}),
    "d.edges": ("1 2\n2 3\n", {(1, 2), (2, 3)}),
    "e.mtx": ("%MATRIXMARKET x\n5 6 1\n1 2\n", {(1, 2)}),
    "f.edges": ("1 2 0.5 1290000000\n2 3 7 1290000001\n", {(1, 2), (2, 3)}),
    "g.edges": ("# FromId ToId\n1\t2\n2\t3\n", {(1, 2), (2, 3)}),
    "h.edges": ("1 2\n2 1\n2 2\n2 3\n3 1\n1 3\n5 5\n", {(1, 2), (1, 3), (2, 3)}),
    "i.edges": ("1 1\n", set()),
}


def test_graph_files(spark, tmp_path):
    for name, (text, want) in FILES.items():
        (tmp_path / name).write_text(text)
        assert {(r.u, r.v) for r in read_edges(spark, str(tmp_path / name)).collect()} == want, name
    both = read_edges(spark, [str(tmp_path / "b.mtx"), str(tmp_path / "e.mtx")]).collect()
    assert {(r.u, r.v) for r in both} == {(1, 2), (2, 3)}


def test_sinks(spark, tmp_path):
    one = S.summary(frame(spark, complete(0, 1, 2, 3)))
    write_json(one, str(tmp_path / "j"))
    write_csv(one, str(tmp_path / "c"))
    (part,) = (tmp_path / "j").glob("part-*.json")
    assert json.loads(part.read_text())["k_max"] == 2
    assert duckdb.sql(f"select k_sum from '{tmp_path}/c/*.csv'").fetchall() == [(12,)]


def test_wide_codes(spark):
    big = frame(spark, [(4_000_000_000, 3_999_999_999)])
    s = 7_999_999_999
    assert int(M.pair_codes(big, wide=True).first().code) == s * (s + 1) // 2 + 4_000_000_000


def test_whole_graph_against_plain_peel(spark):
    """All rows of lineitem, not those of one l_returnflag; counts as in FIXTURES.md."""
    from edgeloom.plans.queries import oracle_sql, queries

    directory = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{directory}/lineitem.parquet'")
    pairs = con.execute("select distinct a.l_partkey, b.l_partkey from lineitem a join lineitem b using (l_orderkey) where a.l_partkey < b.l_partkey").fetchall()
    want = plain_peel(pairs)
    assert len(want) == 8_899 and max(want.values()) == 26
    assert values(queries()["trussness_hindex_part_order"](spark, directory)) == want
    assert queries()["triangle_count_part_order"](spark, directory).first().n == 125_968
    for name in ("degrees_part_order", "support_part_order", "edge_probe_part_order"):
        sql = oracle_sql()[name]
        columns = [d[0] for d in con.execute(sql).description]
        got = sorted(tuple(r) for r in queries()[name](spark, directory).select(columns).collect())
        assert got == sorted(con.execute(sql).fetchall()), name
    plain = {n for n in queries() if not n.endswith(("_part_order", "_orders", "_users"))}
    assert {f"{n}_part_order" for n in plain} <= set(queries())


def test_blocks_and_components_of_any_size(spark):
    """Many small blocks, ids far apart, several components; each method by components, without stored triangles and by rounds."""
    rng = random.Random(11)
    far = 1 << 55
    edges = [(a * far - 7 * far, b * far - 7 * far) for a, b in complete(*range(14)) if rng.random() < 0.6]
    for at in (100, 200):
        edges += [(a + at, b + at) for a, b in complete(*range(16)) if rng.random() < 0.5]
    edges += [(900, 901), (901, 902)]
    want = plain_peel(edges)
    df = frame(spark, edges)
    near = set(edges)
    found = sorted((a, b, c) for a, b in edges for x, c in edges if x == b and (a, c) in near)
    for block in (3, 10_000):
        packed = B.Packed(df.repartition(5), block)
        assert sorted(tuple(r) for r in packed.triangles().collect()) == found
        sup = {(r.u, r.v): (r.eid, r.sup) for r in packed.supports().collect()}
        assert [sup[e][0] for e in sorted(edges)] == list(range(len(edges)))
        assert all(s == sum(e in ((a, b), (a, c), (b, c)) for a, b, c in found) for e, (_, s) in sup.items())
    assert sorted(tuple(r) for r in T.triangles_unordered(df).collect()) == found
    for method in ("hindex", "wedge", "multi_k"):
        assert values(K.truss(df, method, chunk=2)) == want, method
    (whole, history), (mixed, again) = K.peel(df), K.peel(df, 56)  # one of the three is larger
    assert values(whole) == values(mixed) == want and history == again
    for method in ("wedge", "multi_k"):
        assert set(values(K.truss(frame(spark, complete(0, 1, 2, 3) + [(3, 4)]), method, one_task=0)).values()) == {0, 2}
    u, v = (np.array(c) for c in zip(*sorted(edges), strict=True))
    k, batch = K._peel_lists(u, v)
    assert dict(zip(sorted(edges), k.tolist(), strict=True)) == want
    assert (K._peel_stored(len(u), K._stored(u, v))[1] == batch).all()


def test_triangles_shuffle_no_wedges(spark):
    """No join of wedges is in the plan, so nothing grows with them."""
    for made in (T.triangles, T.support, T.triangles_unordered):
        assert "Join" not in made(frame(spark, complete(*range(9))))._jdf.queryExecution().toString(), made


def test_history_alone_writes_no_values(spark, monkeypatch):
    """the same history, and no table of values on disk."""
    edges, _, rounds, rounds_arr = MICRO["K5_tail"]
    df = frame(spark, edges)
    want = K.peel(df)[1]
    labels = []
    monkeypatch.setattr(K, "cut", lambda x, label, cut=K.cut: labels.append(label) or cut(x, label))
    assert K.peel_history(df) == want and K.round_counts(want) == (rounds, rounds_arr) and labels == []


def test_values_are_compared_packed(spark):
    """differences of random values by a plain comparison; no join of rows in the plan."""
    rng = random.Random(13)
    edges = rng.sample([(a - 150, b * (1 << 23)) for a in range(300) for b in range(151, 160)], 2000)
    one, two = ({e: rng.randrange(3) for e in rng.sample(edges, 1500)} for _ in range(2))
    a, b = (spark.createDataFrame([(*e, k) for e, k in x.items()], "u long, v long, k long").repartition(3) for x in (one, two))
    found = S.differing_edges(a, b)
    assert "Join" not in found._jdf.queryExecution().toString()
    want = {(*e, one.get(e), two.get(e)) for e in edges if one.get(e) != two.get(e)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert tuple(S.first_mismatch(a, b).first()) == min(want, key=lambda r: r[:2])
    assert S.differing_edges(a, b.limit(0)).count() == 1500 and S.differing_edges(a.limit(0), b.limit(0)).count() == 0


def test_equal_triangles_are_not_written(spark, monkeypatch):
    """sums by vertex, no table of triangles; repeated rows count as differences."""
    df = frame(spark, complete(*range(9)))
    labels = []
    monkeypatch.setattr(S, "cut", lambda x, label, cut=S.cut: labels.append(label) or cut(x, label))
    assert S.check_triangles(df).first().mismatches == 0 and labels == ["check-vertices"]
    monkeypatch.setattr(S, "triangles_unordered", lambda e: T.triangles(e).filter("v > 1").unionByName(T.triangles(e).filter("u = 3 AND v = 4").limit(2)))
    assert S.check_triangles(df).first().mismatches == 7 + 2


def groups_frame(spark, groups):
    return spark.createDataFrame([(x, g, "a") for g, xs in enumerate(groups) for x in xs] + [(None, 0, "a"), (1, None, "a"), (2, 0, None)], "x long, k0 long, k1 string").repartition(3)


def pairs_of(groups):
    return sorted({(a, b) for xs in groups for a in xs for b in xs if a < b})


def twin_groups(rng, copies):
    """Groups of vertices with so many twins each, a group of twins alone, a vertex alone and repeated members."""
    groups = [[x + 1000 * i for x in rng.sample(range(20), rng.randrange(2, 6)) for i in range(copies(x))] for _ in range(14)]
    return [*groups, [50, 1050, 2050, 3050], [50, 1050, 2050, 3050], [60], [70, 71, 71]]


def test_no_edge_of_groups_is_written(spark, monkeypatch):
    """classes of twins instead of their edges are in tasks and on disk; the values are those of a plain peel."""
    from edgeloom.operators import twins as G

    rng = random.Random(3)
    groups = twin_groups(rng, lambda x: 1 + x % 4)
    want = plain_peel(pairs_of(groups))
    written = []

    def told(x, label, cut=G.cut):
        made = cut(x, label)
        written.append((label, made.agg(F.sum("n")).first()[0] if label == "packed-edges" else made.count()))
        return made

    monkeypatch.setattr(G, "cut", told)
    assert values(G.truss_of_groups(groups_frame(spark, groups))) == want
    assert dict(written)["packed-edges"] < len(want) / 3 and max(n for _, n in written) < len(want) / 2
    monkeypatch.undo()
    monkeypatch.setattr(G, "PAIRS", 20)  # many blocks
    monkeypatch.setattr(G, "AT_ONCE", 7)
    assert values(G.truss_of_groups(groups_frame(spark, groups))) == want
    assert values(G.truss_of_groups(groups_frame(spark, groups), one_task=0)) == want  # by rounds
    assert values(G.truss_of_groups(groups_frame(spark, groups), one_task=30)) == want
    assert G.truss_of_groups(groups_frame(spark, [])).collect() == []


def test_queries_of_groups_equal_their_sql(spark):
    from edgeloom.plans.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("trussness_orders", "trussness_users"):
        assert sorted(tuple(r) for r in queries()[name](spark, "/root/testdata/sf0.001").collect()) == sorted(con.execute(oracle_sql()[name]).fetchall()), name


def test_copies_of_users_make_no_further_edges(spark, tmp_path, monkeypatch):
    """three copies of the events with shifted users have the packed edges of one."""
    from edgeloom.operators import twins as G
    from edgeloom.plans.queries import queries
    from edgeloom.sources.derived import graph_sql

    con = duckdb.connect()
    con.execute("create view one as select * from '/root/testdata/sf0.001/events.parquet' limit 300")
    con.execute(f"copy (select * replace (user_id + 1000000 * i as user_id) from one, range(3) r(i)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = plain_peel(con.execute(graph_sql("user_hour")).fetchall())
    single = con.execute(graph_sql("user_hour").replace("FROM events", "FROM one")).fetchall()
    packed = []

    def told(x, label, cut=G.cut):
        made = cut(x, label)
        if label == "packed-edges":
            packed.append(made.agg(F.sum("n")).first()[0])
        return made

    monkeypatch.setattr(G, "cut", told)
    assert values(queries()["trussness_users"](spark, str(tmp_path))) == want
    assert 0 < len(single) and packed[0] <= len(single) < len(want) / 8


def test_edges_of_groups_are_packed_without_rows_of_pairs(spark, monkeypatch):
    """many small ranges and tasks, nulls, repeated members, ids and keys far apart; nothing but groups and packed edges is written."""
    rng = random.Random(5)
    groups = [[rng.choice((-3, 7)) * (1 << 52) + rng.randrange(25) for _ in range(rng.randrange(1, 7))] for _ in range(60)]
    rows = [(x, g * (1 << 57) % 1_000_003 - 500_000) for g, xs in enumerate(groups) for x in [*xs, xs[0]]]
    members = spark.createDataFrame([*rows, (None, 0), (1, None)], "x long, k0 long").repartition(3)
    want = pairs_of(groups)
    monkeypatch.setattr(B, "GATHERED", 40)
    monkeypatch.setattr(B, "RANGE", 50)
    labels = []
    monkeypatch.setattr(B, "cut", lambda x, label, cut=B.cut: labels.append((label, "Join" in x._jdf.queryExecution().toString())) or cut(x, label))
    packed = B.Packed.of_groups(members, 40)
    assert labels == [("groups", False), ("packed-edges", False)]
    assert [r[:] for r in packed.edges().orderBy("eid").collect()] == [(i, *e) for i, e in enumerate(want)]
    assert packed.rows.select("p").distinct().count() > 3
    assert values(K.truss(packed)) == plain_peel(want)
    assert [label for label, _ in labels[2:]] == ["links"]
    assert packed.triangle_count().first().n == T.triangles_unordered(packed).count() == T.triangles(packed).count() > 0
    assert B.Packed.of_groups(members.limit(0)).edges().collect() == []


def test_two_methods_are_compared_without_written_values(spark, monkeypatch):
    """no table of values is on disk."""
    labels = []
    monkeypatch.setattr(S, "cut", lambda x, label, cut=S.cut: labels.append(label) or cut(x, label))
    df = frame(spark, complete(0, 1, 2, 3) + [(3, 4)])
    assert S.check_truss(df).first().mismatches == 0 and labels == []
    assert S.check_truss(df, ("peel", "multi_k", "wedge")).first().mismatches == 0 and labels == ["check"]


def test_rounds_of_few_edges_do_not_count_all_triangles_anew(monkeypatch):
    """a chain of tetrahedra that goes from its end, and random graphs; all methods of one task give the same values."""
    counted = []
    monkeypatch.setattr(K, "closed", lambda *a, closed=K.closed: counted.append(1) or closed(*a))
    rng = random.Random(17)
    chain = sorted({e for i in range(300) for e in complete(i, i + 1, i + 2, i + 3)})
    for edges in (chain, *([e for e in complete(*range(n)) if rng.random() < p] for n, p in ((20, 0.5), (30, 0.7), (30, 0.2)))):
        u, v = (np.array(c) for c in zip(*edges, strict=True))
        want = K._peel_work(u, v)
        assert dict(zip(edges, want["k"].tolist(), strict=True)) == (plain_peel(edges) if edges is not chain else dict.fromkeys(edges, 2))
        counted.clear()
        assert (K._wedge_work(u, v)["k"] == want["k"]).all()
        assert len(counted) < len(set(zip(*want.values(), strict=True))) or len(counted) < 3
        assert (K._hindex_work(u, v)["k"] == want["k"]).all() and (K._multi_k_work(2)(u, v)["k"] == want["k"]).all()


def test_two_summaries_of_a_graph_count_its_triangles_once(spark, monkeypatch):
    """what the values do not change is found once; components that fill a task have it alone."""
    counted = []
    monkeypatch.setattr(B.Packed, "triangle_count", lambda self, own=B.Packed.triangle_count: counted.append(1) or own(self))
    monkeypatch.setattr(B, "BLOCK", 10)
    edges = [e for at in (0, 10, 20, 30) for e in complete(*range(at, at + 5))] + [(40, 41), (42, 43)]
    packed = B.Packed(frame(spark, edges))
    assert S.check_summary(packed).first().mismatches == 0 and len(counted) == 1
    assert S.summary(packed).first()[:] == (44, 24, 84, 42, 40, 3, 120) and S.dataset_row(packed).first()[:] == (24, 42, 4, 40, 3)
    rows, others = packed.apart(100)
    assert others is None and packed.tasks == 5
    assert sorted((r.task, r.label) for r in rows.select("task", "label").distinct().collect()) == [(0, 0), (1, 10), (2, 20), (3, 30), (4, 40), (4, 42)]


def test_sets_of_groups_keep_all_triangles(spark, monkeypatch):
    """F9 and others: one component is worked on set by set, no edge travels to blocks; the same rows as of packed edges."""
    from edgeloom.operators import sets

    rng = random.Random(11)
    groups = [[rng.randrange(-40, 160) for _ in range(rng.randrange(1, 6))] for _ in range(110)]
    groups += [[1, 2, 900], [2, 3, 901], [1, 3, 902], [1, 2, 903], [5, 1 << 50, (1 << 50) + 1]]
    rows = [(x, g * 1009 % 997 - 400) for g, xs in enumerate(groups) for x in [*xs, xs[0]]]
    members = spark.createDataFrame([*rows, (None, 0), (1, None)], "x long, k0 long").repartition(3)
    want, plain = pairs_of(groups), B.Packed.of_groups(members)
    for name, x in (("GATHERED", 60), ("RANGE", 70)):
        monkeypatch.setattr(B, name, x)
    for name, x in (("LARGE", 10), ("BLOCK", 40), ("ASKED", 16)):
        monkeypatch.setattr(sets, name, x)
    own = B.Packed.of_groups(members)
    monkeypatch.setattr(B.Packed, "_dealt", None)
    assert plain.sets is None and len(set(own.sets.root.tolist())) > 3 and own.sets.shared > 2 and len(own.sets.large) > 0
    for method in ("hindex", "peel", "multi_k", "wedge"):
        assert values(K.truss(own, method)) == plain_peel(want)
    assert K.peel_history(own) == K.peel_history(plain)
    monkeypatch.undo()
    assert own.sets is not None and own.measures == plain.measures
    assert values(T.support(own).withColumnRenamed("sup", "k")) == values(T.support(plain).withColumnRenamed("sup", "k"))
    found = sorted(tuple(r) for r in T.triangles(own).collect())
    assert found == sorted(tuple(r) for r in T.triangles_unordered(own).collect()) == sorted(tuple(r) for r in T.triangles(plain).collect())
    assert (1, 2, 3) in found and S.check_triangles(own).first().mismatches == 0
    assert S.first_mismatch(K.truss(own), T.support(own).withColumnRenamed("sup", "k")).collect() == S.first_mismatch(K.truss(plain), T.support(plain).withColumnRenamed("sup", "k")).collect()
    monkeypatch.setattr(sets, "LARGE", 10)
    monkeypatch.setattr(sets, "MOST_EDGES", 3)
    monkeypatch.setattr(sets, "BLOCK", 4)
    assert B.Packed.of_groups(members).sets is None


def test_triangles_of_edges_in_one_task(monkeypatch):
    rng = np.random.default_rng(3)
    for n, share, scale in ((40, 0.3, 1), (60, 0.1, 1 << 40), (12, 1.0, 7), (2, 1.0, 1)):
        u, v = (np.sort(rng.choice(10 * n, n, replace=False))[x] * scale - 5 * scale for x in np.triu_indices(n, 1))
        some = rng.random(len(u)) < share
        u, v = u[some], v[some]
        edge = {e: i for i, e in enumerate(zip(u.tolist(), v.tolist(), strict=True))}
        want = {(i, edge[a, w], edge[b, w]) for (a, b), i in edge.items() for w in {y for x, y in edge if x == b} if (a, w) in edge}
        for listed, asked in ((1 << 14, 1 << 17), (1, 1), (5, 40)):
            monkeypatch.setattr(B, "LISTED", listed)
            monkeypatch.setattr(B, "ASKED", asked)
            got = [tuple(sorted(t)) for s in B.closed_within(u, v) for t in zip(*(x.tolist() for x in s), strict=True)]
            assert len(got) == len(set(got)) and set(got) == {tuple(sorted(t)) for t in want}
    assert list(B.closed_within(u[:0], v[:0])) == []


def test_two_methods_on_one_component_are_two_tasks(spark):
    df = frame(spark, complete(0, 1, 2, 3) + [(3, 4)])
    both = K.truss(df, "peel").unionByName(K.truss(df, "multi_k"))
    assert len({r[0] for r in both.select(F.spark_partition_id()).collect()}) == 2


def test_packed_numbers_take_the_bytes_that_they_need():
    for width in (1, 2, 3, 4, 5, 6, 8):
        for n in (1, 300):
            x = np.r_[-5, np.full(n - 1, min((1 << 8 * width) - 6, (1 << 62)))].astype(np.int64)
            assert (B._large(B._small(x)) == x).all() and (n == 1 or len(B._small(x)) == 16 + n * width)


def test_sums_of_triangles_by_few_remainders(spark, monkeypatch):
    df = frame(spark, complete(*range(9)))
    monkeypatch.setattr(S, "SUMS", 2)
    assert S.check_triangles(df).first().mismatches == 0
    monkeypatch.setattr(S, "triangles_unordered", lambda e: T.triangles(e).filter("v > 1").unionByName(T.triangles(e).filter("u = 3 AND v = 4").limit(2)))
    assert S.check_triangles(df).first().mismatches == 7 + 2


def test_shuffles_are_freed_before_the_filter_of_edges_is_sent(spark, monkeypatch):
    from edgeloom.operators import sets

    told = []
    monkeypatch.setattr(sets, "LARGE", 1)
    monkeypatch.setattr(sets, "free_shuffles", lambda s: told.append(s))
    members = spark.createDataFrame([(x, g) for g in range(3) for x in (g, g + 5, g + 9)], "x long, k0 long")
    assert B.Packed.of_groups(members).sets is not None and len(told) == 1


def test_many_pairs_travel_in_parts(spark, monkeypatch):
    """The rows are those of one part; the shuffle of a part goes before the next."""
    rng = np.random.default_rng(5)
    members = spark.createDataFrame([(int(x), int(k)) for x, k in zip(rng.integers(0, 300, 900), rng.integers(0, 300, 900))], "x long, k0 long")
    monkeypatch.setattr(B, "GATHERED", 60)
    groups = B._by_group(members)
    of = lambda rows: [(u, v) for r in rows.orderBy("p", "eid").collect() for u, v in zip(B._large(bytes(r.us)).tolist(), B._large(bytes(r.vs)).tolist())]
    plain, told = of(B.sorted_rows(groups, B._pairs_of_groups)), []
    monkeypatch.setattr(B, "free_shuffles", lambda s: told.append(s))
    monkeypatch.setattr(B, "RANGE", 100)
    monkeypatch.setattr(B, "RANGES", 1)
    assert of(B.sorted_rows(groups, B._pairs_of_groups)) == plain == sorted(set(plain)) and len(plain) > 500 and len(told) == B.PASSES


def test_the_filter_is_one_file_for_all(spark):
    from edgeloom.operators import sets

    one = sets.Shared(spark.range(1), "edge-filter", pa.chunked_array([[b"ab", b"c"]], pa.binary()))
    assert one.sent is None and spark.range(1).rdd.map(lambda _: one.bytes().tobytes()).collect() == [b"abc"]
    one.destroy()
    with pytest.raises(FileNotFoundError):
        one.bytes()


def test_innermost_finds_the_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, i + 1, i % 7) for i in range(70)]
    values = spark.createDataFrame(rows, "u long, v long, k long").repartition(5).mapInArrow(once, "u long, v long, k long")
    assert sorted(tuple(r) for r in S.innermost(values).collect()) == [(u, v) for u, v, k in rows if k == 6]
    assert seen.value == len(rows)
    assert S.innermost(values.filter("k < 0")).collect() == []
