"""Cutting lineage and numbering rows without a window over all rows."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs in one process."""
    global _local_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/edgeloom-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: a short lineage that survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by :func:`cut`."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/edgeloom-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Files of shuffles that nothing refers to any more go; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def with_prefixes(df: DataFrame, keys: list[str], sums: dict[str, str | None], label: str = "prefix") -> DataFrame:
    """Adds for each of ``sums`` (name: column, None for a count): in the order of
    ``keys``, its sum over the rows before each row.

    The rows are range-partitioned and sorted; each range sums its own in one pass, and the ranges'
    totals, one row each, shift the sums. One shuffle; no task sees more than its range.
    """
    names, n = df.columns, len(sums)
    values = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) if c else F.lit(1).cast("long") for c in sums.values()]
    rows = df.select("*", *(v.alias(f"_v{i}") for i, v in enumerate(values))).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), np.zeros(n, np.int64)
        for batch in batches:
            own = [batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(n)]
            before = []
            for i, x in enumerate(own):
                upto = np.cumsum(x) + so_far[i]
                before.append(pa.array(upto - x, pa.int64()))
                so_far[i] = upto[-1] if len(upto) else so_far[i]
            here = pa.array(np.full(batch.num_rows, part), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *before, here], [*batch.schema.names, *(f"_s{i}" for i in range(n)), "_p"])

    schema = StructType([*rows.schema.fields, *(StructField(f"_s{i}", LongType()) for i in range(n)), StructField("_p", IntegerType())])
    local = cut(rows.mapInArrow(run, schema), label)
    totals = sorted(tuple(r) for r in local.groupBy("_p").agg(*(F.sum(f"_v{i}") for i in range(n))).collect())
    at, starts = [0] * n, []
    for p, *own in totals:
        starts.append((p, *at))
        at = [a + b for a, b in zip(at, own, strict=True)]
    shift = df.sparkSession.createDataFrame(starts or [(0, *at)], ", ".join(["_p int", *(f"_a{i} long" for i in range(n))]))
    made = [(F.col(f"_s{i}") + F.col(f"_a{i}")).alias(name) for i, name in enumerate(sums)]
    return local.join(F.broadcast(shift), "_p").select(*names, *made)


def with_prefix(df: DataFrame, keys: list[str], value: str | None, out: str, label: str = "prefix") -> DataFrame:
    """Adds ``out``: in the order of ``keys``, the sum of ``value`` (or the number)
    of the rows before each row."""
    return with_prefixes(df, keys, {out: value}, label)
