"""Connected components of an edge list, by contraction in random orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import cut, remove
from edgeloom.operators.blocks import joined

#: Different edges that one task joins.
ONE_TASK = 1_000_000


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
    x, y = np.concatenate([np.empty((0, 2), np.int64), *parts]).T
    nodes = np.unique(np.concatenate([x, y]))
    label = nodes.copy()
    moved, least = joined(x, y)
    label[np.searchsorted(nodes, moved)] = least
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], pa.int64()) for c in (nodes, label)], ["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """node, label (one node of its component, the same for all of them) of every node of an edge.

    In each round a node joins the one that comes first, in an order of its own for each round, among its
    neighbours and itself, and the edges become those between what was joined.
    A group around one node is done in a round or two, and a path of n nodes in about
    log n. The edges of a node are first aggregated where they lie; the joins
    are between written tables, so adaptive execution splits a node with very many
    edges. As soon as at most ``one_task`` edges are left, one task joins what they join.
    Only the number of edges left reaches the driver.
    """
    left = cut(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x <> y").distinct(), "component-edges")
    rounds: list[DataFrame] = []
    while left.count() > one_task:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))), F.col(c).alias("node"))  # noqa: B023, E731
        first = F.least(order("x"), order("y"))
        ends = left.select(F.explode(F.array("x", "y")).alias("node"), first.alias("to"))
        joined = cut(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.col("to.node").alias("label")), "component-round")
        rounds.append(joined)
        of = lambda c: joined.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")).hint("merge")  # noqa: B023, E731
        met = left.join(of("x"), "x").join(of("y"), "y").filter("x_label <> y_label")
        less = cut(met.select(F.least("x_label", "y_label").alias("x"), F.greatest("x_label", "y_label").alias("y")).distinct(), "component-edges")
        remove(left)
        left = less
    rounds.append(cut(left.coalesce(1).mapInArrow(_whole, "node long, label long"), "component-rest"))
    remove(left)
    labels = rounds[0]
    for later in rounds[1:]:
        on = later.select(F.col("node").alias("label"), F.col("label").alias("_on")).hint("merge")
        labels = cut(labels.join(on, "label", "left").select("node", F.coalesce("_on", "label").alias("label")), "component-labels")
    return labels
