"""Truss values of a graph of groups: its vertices are joined if they are in a group together.

Such a graph has many more edges than the groups have members, so the members of the groups travel, once for each
block of vertices, and pairs are made where they are needed.

Vertices of the same groups (twins) are joined and have the same other neighbours. The graph stays as it is if two of them
change places, so the edges between two classes of twins have one value, and those within a class have one. Truss
values are found on the classes, whose ids carry in their lowest bits how many twins they stand for, and are spread to the
vertices last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.blocks import _ROW, AT_ONCE, Packed, _batches, _groups, _large, _row, _small, _starts, _table, _within, on_components
from edgeloom.operators.truss import MOST_EDGES, ONE_TASK, _peel_lists, hindex
from edgeloom.plans.materialize import cut, drop, with_prefix

#: Pairs that a task makes, about.
PAIRS = 1_500_000


def truss_of_groups(members: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """u, v, k of every edge; ``members`` has x, a vertex, and the columns of its group's key. Nulls join nothing."""
    classes, bits = twins(members)
    groups = cut(classes.select("c", F.explode("gs").alias("g")).groupBy("g").agg(F.sort_array(F.collect_list("c")).alias("cs")), "class-groups")
    size = F.size("cs").cast("long")
    pairs = groups.agg(F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0)).cast("long")).first()[0]
    packed = packed_pairs(groups, bits, classes.count(), max(1, pairs // PAIRS))
    rows, others = packed.apart(min(one_task, MOST_EDGES))
    linked = groups.filter(size > 1).select(F.explode("cs").alias("c")).distinct()
    twins_of = F.col("c").bitwiseAND((1 << bits) - 1)
    values = classes.join(linked, "c", "left_anti").filter(twins_of > 1).select(F.col("c").alias("u"), F.col("c").alias("v"), (twins_of - 2).alias("k"))
    if rows is not None:
        values = values.unionByName(on_components(rows, _work(bits), ["k"], packed.tasks))
    found = spread(cut(values, "class-values"), classes, bits)
    if others is None or not packed.n:
        return found
    ends = others.select(F.explode(F.array("u", "v")).alias("c")).distinct().filter(twins_of > 1)
    some = others.unionByName(ends.select(F.col("c").alias("u"), F.col("c").alias("v"))).withColumn("k", F.lit(0).cast("long"))
    return found.unionByName(hindex(spread(cut(some, "class-edges"), classes, bits).select("u", "v"), 0))


def twins(members: DataFrame) -> tuple[DataFrame, int]:
    """Written classes of vertices of the same groups: c (a number, and in its lowest bits how many they are), xs, gs (their
    groups); and how many bits. Who is alone in all groups has no edge and is left out."""
    keys = [c for c in members.columns if c != "x"]
    groups = members.dropna().groupBy(*keys).agg(F.collect_set("x").alias("xs")).filter(F.size("xs") > 1)
    groups = cut(groups.select(F.monotonically_increasing_id().alias("g"), "xs"), "groups")
    own = groups.select("g", F.explode("xs").alias("x")).groupBy("x").agg(F.sort_array(F.collect_list("g")).alias("gs"))
    found = cut(own.groupBy("gs").agg(F.sort_array(F.collect_list("x")).alias("xs")), "twins")
    bits = int(found.agg(F.coalesce(F.max(F.size("xs")), F.lit(0))).first()[0]).bit_length()
    numbers = with_prefix(found.select(F.col("xs")[0].alias("x")), ["x"], None, "number")
    c = F.shiftleft("number", bits).bitwiseOR(F.size("xs").cast("long")).alias("c")
    classes = cut(found.withColumn("x", F.col("xs")[0]).join(numbers, "x").select(c, "xs", "gs"), "classes")
    drop(groups, found)
    return classes, bits


def packed_pairs(groups: DataFrame, bits: int, classes: int, blocks: int) -> Packed:
    """The edges between classes, from the classes ``cs`` of each group, in ascending order, made in ``blocks`` ranges of classes."""

    def block(c: np.ndarray) -> np.ndarray:
        """Each range has about as many pairs with greater classes."""
        return np.minimum((blocks * (1 - (1 - (c >> bits) / classes) ** 2)).astype(np.int64), blocks - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cs in b.column(0):
                c = cs.values.to_numpy(zero_copy_only=False)
                at = [*_starts(block(c[:-1])).tolist(), len(c) - 1]
                if len(c) > 1:
                    yield _table([[int(block(c[lo : lo + 1])[0]), hi - lo, _small(c[lo:])] for lo, hi in zip(at, at[1:])], "p long, own long, cs binary")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _groups(batches):
            cs = [_large(r["cs"]) for r in rows]
            own, size = np.array([r["own"] for r in rows]), np.array([len(c) for c in cs])
            first = np.repeat(np.cumsum(size) - size, own) + _within(own)
            after = np.repeat(size, own) - 1 - _within(own)
            c = np.concatenate(cs)
            u, v = _distinct(c, first, after)
            made = []
            for at in range(0, len(u), 1 << 13):
                made.append([p, *_row(at, u[at : at + (1 << 13)], v[at : at + (1 << 13)])])
            yield _table(made, f"p long, {_ROW}")

    dealt = groups.select("cs").mapInArrow(deal, "p long, own long, cs binary").repartition(min(blocks, 2000), "p").sortWithinPartitions("p")
    return Packed.of(cut(dealt.mapInArrow(make, f"p long, {_ROW}"), "packed-edges"))


def _distinct(c: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs of each ``c[first]`` with as many places ``after`` it."""
    names, places = np.unique(c, return_inverse=True)
    held, done, at, upto = [], 0, 0, np.cumsum(after)
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(upto, done + 4 * AT_ONCE, "right")))
        one = np.repeat(first[at:end], after[at:end])
        held.append(np.unique(places[one] * len(names) + places[one + 1 + _within(after[at:end])]))
        at, done = end, int(upto[end - 1])
    key = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
    return names[key // len(names)], names[key % len(names)]


def _work(bits: int) -> Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """Values between the classes of a component and within them (u = v)."""

    def work(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        names = np.unique(np.concatenate([u, v]))
        within = names[names & ((1 << bits) - 1) > 1]
        return {"u": np.concatenate([u, within]), "v": np.concatenate([v, within]), "k": _peel_lists(u, v, bits)[0]}

    return work


def spread(values: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
    """u, v, k of the edges between the vertices of classes u, v (c, xs), or within one (u = v). Tasks are pairs of
    blocks of classes: a value travels once, a class as many times as there are blocks."""
    low = (1 << bits) - 1
    of = lambda c: F.col(c).bitwiseAND(low)
    n = values.agg(F.coalesce(F.sum(of("u") * of("v")), F.lit(0))).first()[0]
    blocks = max(1, isqrt(2 * n // PAIRS))
    schema = "task long, kind long, n long, us binary, vs binary, ks binary"

    def task(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = (x >> bits) % blocks, (y >> bits) % blocks
        return np.minimum(a, b) * blocks + np.maximum(a, b)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, k = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            own = task(u, v)
            order = np.lexsort((v, u, own))
            u, v, k, own = u[order], v[order], k[order], own[order]
            at = [*_starts(own).tolist(), len(u)]
            if len(u):
                yield _table([[int(own[lo]), 1, hi - lo, *(_small(x[lo:hi]) for x in (u, v, k))] for lo, hi in zip(at, at[1:])], schema)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, xs = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for own in np.unique((c >> bits) % blocks):
                some = np.flatnonzero((c >> bits) % blocks == own)
                row = [len(some), _small(c[some]), _small(xs.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)), b""]
                other = np.arange(blocks)
                yield _table([[int(t), 0, *row] for t in np.minimum(own, other) * blocks + np.maximum(own, other)], schema)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = x = begin = None
        named: list[dict] = []
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] != now:
                    now, named, c = r["task"], [], None
                if not r["kind"]:
                    named.append(r)
                    continue
                if c is None:
                    c, x = (np.concatenate([_large(o[i]) for o in named]) for i in ("us", "vs"))
                    begin = np.cumsum(c & low) - (c & low)
                    order = np.argsort(c)
                    c, begin = c[order], begin[order]
                u, v, k = (_large(r[i]) for i in ("us", "vs", "ks"))
                a, b = begin[np.searchsorted(c, u)], begin[np.searchsorted(c, v)]
                counts, width, inner = (u & low) * (v & low), v & low, u == v
                upto, at = np.cumsum(counts), 0
                while at < len(u):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
                    for lo in range(0, int(counts[at]) if end == at + 1 else 1, AT_ONCE):  # a pair of large classes in parts
                        if end == at + 1:
                            place = np.arange(lo, min(lo + AT_ONCE, int(counts[at])))
                            which = np.full(len(place), at)
                        else:
                            which, place = np.repeat(np.arange(at, end), counts[at:end]), _within(counts[at:end])
                        i, j = np.divmod(place, width[which])
                        if inner[at:end].any():
                            once = ~inner[which] | (i < j)
                            which, i, j = which[once], i[once], j[once]
                        one, two = x[a[which] + i], x[b[which] + j]
                        yield from _batches({"u": np.minimum(one, two), "v": np.maximum(one, two), "k": k[which]})
                    at = end

    both = values.select("u", "v", "k").mapInArrow(pack, schema).unionByName(classes.select("c", "xs").mapInArrow(name, schema))
    tasks = blocks * (blocks + 1) // 2
    return both.repartition(min(2000, tasks), "task").sortWithinPartitions("task", "kind").mapInArrow(give, "u long, v long, k long")
