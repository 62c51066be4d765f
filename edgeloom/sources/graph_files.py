"""Graph files (MatrixMarket coordinate files and bare edge lists), and result sinks.

Rules, per file: if the first line, without leading ``%`` and white space and
in lower case, starts with ``matrixmarket``, the first line that is not a
comment is the size line and no edge. Lines that start with ``%`` or ``#``
are comments wherever they stand, and so is the rest of a line after ``#``.
An edge is two integers separated by white space; further columns are dropped.
Ids are taken as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.model import canonicalize


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """src, dst (LONG) of each data line."""
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # the first block of a file alone says whether it has a size line
    head = lines.filter("block = 0")
    banner = head.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    banner = banner.filter(F.regexp_replace(F.lower(F.regexp_replace("line", "^%+", "")), "^\\s+", "").startswith("matrixmarket")).select("file")
    data = lines.withColumn("body", F.trim(F.regexp_replace("value", "#.*$", ""))).filter((F.col("body") != "") & ~F.col("body").startswith("%"))
    size = data.join(banner, "file", "left_semi").groupBy("file").agg(F.min(F.struct("block", "at")).alias("first")).select("file", F.col("first.block").alias("block"), F.col("first.at").alias("at"))
    tokens = F.split(F.regexp_replace("body", "^\\s+", ""), "\\s+")
    return data.join(size, ["file", "block", "at"], "left_anti").select(tokens.alias("t")).select(F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"))


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Canonical edges of a file."""
    return canonicalize(read_pairs(spark, path))


def write_edges(edges: DataFrame, path: str) -> None:
    """Bare edge lists, as :func:`read_edges` reads them."""
    edges.select(F.concat_ws(" ", "u", "v").alias("value")).write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Appends part files, each with a header."""
    rows.write.mode("append").option("header", True).csv(path)
