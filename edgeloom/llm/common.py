"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.plans.materialize import cut, new_path
from edgeloom.plans.materialize import drop as remove

__all__ = ["cut", "held_out", "keep_rows", "kept", "new_path", "ranked", "release", "remove", "rows_at_once", "share", "table", "training_rows", "within_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def share(key: str, rows: float, wanted: int) -> Column:
    """A repeatable choice of about ``wanted`` of ``rows`` rows by a hash of ``key``."""
    part = 1.0 if rows <= wanted else wanted / rows
    return F.pmod(F.xxhash64(F.lit("share"), F.col(key)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)) + 1)


def ranked(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row in the order of ``keys``.

    A range partitioning deals the rows out, each partition numbers its own,
    and the sizes of the partitions (one row each) shift the numbers. No
    window over all rows, and equal keys may be split over partitions.
    """
    local = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    local = cut(local, label)
    pid = F.shiftright("_m", 33)
    sizes = [
        (r["p"], r["n"])
        for r in local.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect()
    ]
    shift, at = [], 0
    for p, n in sorted(sizes):
        shift.append((p, at))
        at += n
    starts = local.sparkSession.createDataFrame(shift or [(0, 0)], "_p long, _at long")
    return (
        local.withColumn("_p", pid)
        .join(F.broadcast(starts), "_p")
        .withColumn("rank", F.col("_at") + F.col("_m").bitwiseAND((1 << 33) - 1))
        .drop("_m", "_p", "_at")
    )


#: Bytes of the texts of a training set that reach the driver.
TRAIN_BYTES = 64 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, wanted: int, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with a known ``label``, none of them held out: about
    ``wanted`` of each value (at most twice that), chosen by a hash of ``key``.

    Only keys and labels are looked through; the chosen keys, of bounded
    number, are sent to the scan of the documents, whose texts stay in place.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).cast("int").alias("label"))
    known = known.groupBy(key).agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for value, n in sorted(counts.items()):
        part = known.filter((F.col("label") == value) & share(key, n, wanted)).orderBy(F.xxhash64(key)).limit(2 * wanted)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known
    return docs.join(F.broadcast(chosen), key)


def within_bytes(rows: DataFrame, text: str, most: int = TRAIN_BYTES) -> DataFrame:
    """A random part of ``rows`` whose texts have about ``most`` bytes together; all of them if they have fewer."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return rows if total <= most else rows.filter(share(text, total, most))


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows for which ``decide(batch)``, given and giving arrays, is true; no shuffle."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(decide(batch), pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


@contextmanager
def rows_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Within, Spark gives Python at most so many rows at a time: for wide rows, which either side holds several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_kept: dict = {}


def kept(name: str, make: Callable):
    """A Python worker's model, made once for all its tasks. Only the one last asked for stays: workers
    outlive a stage, and the models of the stages before would stand beside it."""
    if name not in _kept:
        _kept.clear()
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Gives freed memory back to the system: a Python worker waits for its next task beside the others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
