"""The graph model: canonical edges, arcs, degrees, offsets, ids, lookups.

Canonical edges ``u, v`` (LONG, ``u < v``, distinct) are the input of all
other operators. Empty inputs give empty frames everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import ordered, pair_code
from edgeloom.plans.materialize import with_prefix


def canonicalize(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Simple undirected edges: no loops, no repetitions, no nulls."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    low, high = ordered(x, y)
    return pairs.filter(x != y).select(low.alias("u"), high.alias("v")).distinct()


def arcs(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select(F.inline(both))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.count("*").alias("deg"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """v, deg, off (arcs of smaller vertices)."""
    return with_prefix(degrees(edges), ["v"], "deg", "off").select("v", "deg", "off")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.count("*").alias("outdeg"))


def edge_ids(edges: DataFrame) -> DataFrame:
    """eid (0-based, in the order of u, v), u, v."""
    return with_prefix(edges, ["u", "v"], None, "eid").select("eid", "u", "v")


def pair_codes(edges: DataFrame, wide: bool = False) -> DataFrame:
    return edges.select("u", "v", pair_code(F.col("u"), F.col("v"), wide).alias("code"))


def edge_probe(edges: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """a, b, found, eid (null if absent) of each pair, in either order of its ends."""
    low, high = ordered(F.col(a), F.col(b))
    ids = edge_ids(edges)
    return pairs.withColumns({"_u": low, "_v": high}).join(ids.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "eid"), ["_u", "_v"], "left").select(
        F.col(a).alias("a"), F.col(b).alias("b"), F.col("eid").isNotNull().alias("found"), "eid"
    )


def arc_index(edges: DataFrame) -> DataFrame:
    """src, dst, arc (0-based, in the order of src, dst), rev (the arc back), eid (of the edge)."""
    at = with_prefix(arcs(edges), ["src", "dst"], None, "arc")
    back = at.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("arc").alias("rev"))
    low, high = ordered(F.col("src"), F.col("dst"))
    ids = edge_ids(edges).select(F.col("u").alias("_u"), F.col("v").alias("_v"), "eid")
    return at.join(back, ["src", "dst"]).withColumns({"_u": low, "_v": high}).join(ids, ["_u", "_v"]).select("src", "dst", "arc", "rev", "eid")


def search_keys(edges: DataFrame) -> DataFrame:
    """v, max_neighbor, mxx (sum of max_neighbor + 1 of smaller vertices)."""
    largest = arcs(edges).groupBy(F.col("src").alias("v")).agg(F.max("dst").alias("max_neighbor"))
    sized = largest.withColumn("_size", F.col("max_neighbor") + 1)
    return with_prefix(sized, ["v"], "_size", "mxx").select("v", "max_neighbor", "mxx")


def multi_arange(ranges: DataFrame, key: str = "i", start: str = "start", count: str = "n") -> DataFrame:
    """key, x: start, start + 1, ... for each row, ``count`` values (none if it is not positive)."""
    some = ranges.filter(F.col(count) > 0)
    return some.select(key, F.explode(F.sequence(F.col(start), F.col(start) + F.col(count) - 1)).alias("x"))


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "u long, v long")
