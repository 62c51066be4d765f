"""Graphs derived from the tables: two values are joined if they share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name: table, vertex, key columns, filter.
GRAPHS: dict[str, tuple[str, str, list[str], str]] = {
    "g_part_r": ("lineitem", "l_partkey", ["l_orderkey"], "l_returnflag = 'R'"),
    "part_order": ("lineitem", "l_partkey", ["l_orderkey"], "true"),
    "g_supp_r40": ("lineitem", "l_suppkey", ["l_orderkey"], "l_returnflag = 'R' and l_quantity >= 40"),
    "g_cust_day": ("orders", "o_custkey", ["date_trunc('day', o_orderdate)", "o_orderpriority"], "true"),
    "user_hour": ("events", "user_id", ["date_trunc('hour', ts)", "event_type"], "true"),
}


def members(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """x, a vertex, and k0, k1, ..., the key it has; rows may repeat."""
    table, vertex, keys, keep = GRAPHS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(keep)
    return rows.select(F.col(vertex).cast("long").alias("x"), *(F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)))


def graph(spark: SparkSession, sf_dir: str, name: str = "g_part_r") -> DataFrame:
    """Canonical edges of a derived graph."""
    side = members(spark, sf_dir, name).distinct()
    names = [c for c in side.columns if c != "x"]
    pairs = side.join(side.withColumnRenamed("x", "y"), names).filter("x < y")
    return pairs.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()


def graph_sql(name: str = "g_part_r") -> str:
    table, vertex, keys, keep = GRAPHS[name]
    same = " AND ".join(f"a.k{i} = b.k{i}" for i in range(len(keys)))
    chosen = ", ".join(f"{k} AS k{i}" for i, k in enumerate(keys))
    side = f"(SELECT {vertex} AS x, {chosen} FROM {table} WHERE {keep})"
    return f"SELECT DISTINCT a.x AS u, b.x AS v FROM {side} a JOIN {side} b ON {same} AND a.x < b.x"
