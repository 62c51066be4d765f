"""Measures of a decomposition, and checks of one against another."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.blocks import Packed, differing, packed
from edgeloom.operators.triangles import triangles, triangles_unordered
from edgeloom.operators.truss import hindex, truss
from edgeloom.plans.materialize import cut

#: Sums that :func:`check_triangles` compares.
SUMS = 1 << 16


def histogram(values: DataFrame) -> DataFrame:
    return values.groupBy("k").agg(F.count("*").alias("n"))


def innermost(values: DataFrame) -> DataFrame:
    """u, v of the edges with the greatest k. The values are found once: a task gives the edges of its own greatest k alone."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held = None, []
        for batch in batches:
            k = batch.column(2).to_numpy(zero_copy_only=False)
            if len(k) and (most is None or k.max() >= most):
                held = [] if most is None or k.max() > most else held
                most = k.max()
                held.append(batch.filter(pa.array(k == most)))
        yield from held

    rows = cut(values.select("u", "v", "k").mapInArrow(own, "u long, v long, k long"), "innermost")
    most = rows.agg(F.max("k").alias("k"))
    return rows.join(F.broadcast(most), "k").select("u", "v")


def _one_row(edges: DataFrame | Packed, values: DataFrame | None, names: dict[str, str]) -> DataFrame:
    """One row of ``names`` (the name here: that in the measures); what the truss values do not change is found once for a graph."""
    own = packed(edges)
    values = hindex(own) if values is None else values
    found = own.measures | {"edge_count": 2 * own.measures["undirected_edges"]}
    columns = {name: F.lit(x) for name, x in found.items()} | {"k_max": F.coalesce(F.max("k"), F.lit(0)), "k_sum": F.coalesce(F.sum("k"), F.lit(0))}
    return values.agg(*(columns[of].cast("long").alias(name) for name, of in names.items()))


def summary(edges: DataFrame | Packed, values: DataFrame | None = None) -> DataFrame:
    """One row: vertex_count (largest id + 1), active_vertices, edge_count (arcs),
    undirected_edges, triangle_count, k_max, k_sum; all 0 for no edges."""
    names = ("vertex_count", "active_vertices", "edge_count", "undirected_edges", "triangle_count", "k_max", "k_sum")
    return _one_row(edges, values, dict(zip(names, names)))


def dataset_row(edges: DataFrame | Packed, values: DataFrame | None = None) -> DataFrame:
    """v (active vertices), e, d_max, triangles, k_max."""
    return _one_row(edges, values, {"v": "active_vertices", "e": "undirected_edges", "d_max": "d_max", "triangles": "triangle_count", "k_max": "k_max"})


def differing_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """u, v, k, k2 where two decompositions differ (null: absent)."""
    return differing(a, b)


def first_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    return differing_edges(a, b).orderBy("u", "v").limit(1)


def check_truss(edges: DataFrame | Packed, methods: tuple[str, ...] = ("hindex", "peel")) -> DataFrame:
    """mismatches: edges on which the first method differs from any other."""
    edges = packed(edges)
    first, total = truss(edges, methods[0]), None
    if len(methods) > 2:
        first = cut(first, "check")
    for m in methods[1:]:
        n = differing_edges(first, truss(edges, m)).agg(F.count("*").alias("mismatches"))
        total = n if total is None else total.unionByName(n)
    return total.agg(F.sum("mismatches").cast("long").alias("mismatches"))


def check_triangles(edges: DataFrame | Packed) -> DataFrame:
    """mismatches: triangles that one route finds and the other does not.

    The triangles of smallest vertices with the same remainder are summed up where they are found, as their number and sums of
    two 64-bit hashes; only those of remainders whose sums differ are held against each other one by one. So a task gives at
    most ``SUMS`` rows, however many vertices it meets.
    """
    edges = packed(edges)
    a, b = triangles(edges), triangles_unordered(edges)
    names, part = [f"s{i}" for i in range(5)], F.pmod(F.col("u"), F.lit(SUMS)).alias("part")

    def sums(rows: DataFrame, to: str) -> DataFrame:
        of = [F.xxhash64("u", "v", "w"), F.xxhash64(F.lit(1), "w", "v", "u")]
        halves = [x for h in of for x in (h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32))]
        return rows.groupBy(part).agg(F.struct(F.count("*").alias("n"), *(F.sum(x).alias(n) for n, x in zip(names, halves))).alias(to))

    both = sums(a, "a").join(sums(b, "b"), "part", "full_outer")
    wrong = cut(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("part"), "check-vertices")
    if wrong.isEmpty():
        return edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("mismatches"))
    a, b = (cut(x.withColumn("part", part).join(wrong, "part", "left_semi").select("u", "v", "w"), "check") for x in (a, b))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("mismatches"))


def check_summary(edges: DataFrame | Packed, a: str = "hindex", b: str = "wedge") -> DataFrame:
    """mismatches: measures in which the summaries of two methods differ."""
    edges = packed(edges)
    x, y = summary(edges, truss(edges, a)), summary(edges, truss(edges, b))
    names = x.columns
    both = x.select(F.lit(1).alias("_one"), *names).join(y.select(F.lit(1).alias("_one"), *(F.col(c).alias(f"_{c}") for c in names)), "_one")
    wrong = sum((F.when(F.col(c) != F.col(f"_{c}"), 1).otherwise(0) for c in names), F.lit(0))
    return both.select(wrong.cast("long").alias("mismatches"))
