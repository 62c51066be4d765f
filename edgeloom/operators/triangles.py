"""Triangles, supports and incidences.

Triangles are closed in blocks of vertices (:mod:`edgeloom.operators.blocks`): wedges stay in a task,
only packed edges travel. Each triangle is found once, as ``u < v < w``.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.blocks import Packed, packed
from edgeloom.operators.model import arcs, degrees, out_degree
from edgeloom.plans.materialize import with_prefix, with_prefixes


def triangles(edges: DataFrame | Packed) -> DataFrame:
    """u, v, w of each triangle, closed at its smallest vertex."""
    return packed(edges).triangles()


def edge_triples(ids: DataFrame) -> DataFrame:
    """e1, e2, e3: the edges' ids of each triangle; ``ids`` has eid (as :func:`edge_ids` gives it), u, v."""
    return Packed(ids).triples()


def triangles_unordered(edges: DataFrame | Packed) -> DataFrame:
    """The same rows by the other route: vertices in reverse order, so each triangle is closed at its greatest vertex."""
    return packed(edges).turned().triangles().select((-F.col("w")).alias("u"), (-F.col("v")).alias("v"), (-F.col("u")).alias("w"))


def wedge_counts(edges: DataFrame) -> DataFrame:
    """u, v, wedges (edges that go on from v to a larger vertex)."""
    return edges.join(out_degree(edges).select(F.col("u").alias("v"), "outdeg"), "v", "left").select("u", "v", F.coalesce("outdeg", F.lit(0)).cast("long").alias("wedges"))


def triangle_count(edges: DataFrame | Packed) -> DataFrame:
    return packed(edges).triangle_count()


def support(edges: DataFrame | Packed) -> DataFrame:
    """u, v, sup (triangles of the edge, 0 kept)."""
    return packed(edges).supports().select("u", "v", "sup")


def arc_support(edges: DataFrame) -> DataFrame:
    """src, dst, sup of each arc: both have what the edge has."""
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return support(edges).select(F.inline(both), "sup")


def triangle_count_from_arcs(edges: DataFrame) -> DataFrame:
    """n: a sixth of the arcs' supports."""
    return arc_support(edges).agg(F.floor(F.coalesce(F.sum("sup"), F.lit(0)) / 6).cast("long").alias("n"))


def incidence(triples: DataFrame) -> DataFrame:
    """eid of each side of each triangle (e1, e2, e3)."""
    return triples.select(F.explode(F.array("e1", "e2", "e3")).alias("eid"))


def incidence_runs(edges: DataFrame) -> DataFrame:
    """eid, start, len of each edge's run in the incidences sorted by edge."""
    counts = packed(edges).supports().filter("sup > 0").select("eid", F.col("sup").alias("len"))
    return with_prefix(counts, ["eid"], "len", "start").select("eid", "start", "len")


def missing_edges(edges: DataFrame) -> DataFrame:
    """u, v of the edges in no triangle."""
    return support(edges).filter("sup = 0").select("u", "v")


def _first_reaching(rows: DataFrame, weight: str, place: str, least: str, most: str, parts: int) -> DataFrame:
    """p, cut: for each p from 1 to ``parts`` - 1 the first ``place`` of a row whose range
    ``least`` to ``most`` has p; by sequences, so no join of rows and targets is needed."""
    some = rows.withColumn("_upto", F.col("_before") + F.col(weight)).select(F.col(place).alias("cut"), F.expr(least).alias("least"), F.least(F.lit(parts - 1).cast("long"), F.expr(most)).alias("most"))
    return some.filter("least <= most").select("cut", F.explode(F.sequence("least", "most")).alias("p")).groupBy("p").agg(F.min("cut").alias("cut"))


def _ranges(spark: SparkSession, cuts: list[int]) -> DataFrame:
    rows = [(p, lo, hi) for p, (lo, hi) in enumerate(pairwise(cuts))]
    return spark.createDataFrame(rows, "part long, lo long, hi long")


def balanced_cuts(edges: DataFrame, parts: int) -> DataFrame:
    """part, lo, hi: runs of edges (in the order of u, v) with about equal numbers of wedges.

    Cut p is the first position whose wedges up to and with it reach
    p * total div parts. Only the ``parts`` cuts reach the driver.
    """
    placed = with_prefixes(wedge_counts(edges), ["u", "v"], {"_before": "wedges", "_at": None}, "cuts")
    total, m = placed.agg(F.coalesce(F.sum("wedges"), F.lit(0)), F.count("*")).first()
    if not total:
        return _ranges(edges.sparkSession, [0] * parts + [m])
    # before < p * total div parts <= upto, and targets of 0 for the first edge
    least = f"if(_at = 0, 1L, ((_before + 1) * {parts} + {total} - 1) div {total})"
    found = {r["p"]: r["cut"] for r in _first_reaching(placed, "wedges", "_at", least, f"((_upto + 1) * {parts} - 1) div {total}", parts).collect()}
    return _ranges(edges.sparkSession, [0, *(found[p] for p in range(1, parts)), m])


def vertex_cuts(edges: DataFrame, parts: int) -> DataFrame:
    """part, lo, hi: ranges of vertices whose arcs lead on to about equal numbers of arcs.

    A cut comes after the first vertex with which p * total / parts is reached; equal cuts
    are one, so there may be fewer parts. The last range ends after the greatest vertex.
    """
    deg = degrees(edges)
    weight = arcs(edges).join(deg.select(F.col("v").alias("dst"), "deg"), "dst").groupBy(F.col("src").alias("v")).agg(F.sum("deg").alias("wedges"))
    placed = with_prefixes(weight, ["v"], {"_before": "wedges", "_at": None}, "vertex-cuts")
    total, last = placed.agg(F.coalesce(F.sum("wedges"), F.lit(0)), F.coalesce(F.max("v") + 1, F.lit(0))).first()
    if not total:
        return _ranges(edges.sparkSession, [0, last])
    least, most = f"_before * {parts} div {total} + 1", f"_upto * {parts} div {total}"
    found = [r["cut"] + 1 for r in _first_reaching(placed, "wedges", "v", least, most, parts).collect()]
    return _ranges(edges.sparkSession, sorted({0, *found, last}))
