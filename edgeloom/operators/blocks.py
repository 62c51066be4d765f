"""Packed edges: triangles by blocks of vertices, and work on whole components.

A wedge is never a row of a shuffle. The edges are sorted by ``u, v`` once and written
some thousand to a row, as numbers of few bytes. For triangles the vertices are cut
into ranges with about ``BLOCK`` edges each; a task gets two blocks and closes the edges from the
first block to the second: the shorter of two neighbour lists is looked up in the
longer, so the tasks together look up at most (edges x arboricity x 2) pairs. An edge travels to
as many tasks as its block has others that it is linked with.

For truss values each component goes whole to one task, as long as it has at most a
given number of edges: the components of a graph do not touch each other's values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import pairwise
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.plans.materialize import append, cut, drop, free_shuffles, new_path

if TYPE_CHECKING:
    from edgeloom.operators.sets import Sets

BLOCK = 1_500_000
#: Rows of groups that one task gathers, and pairs of one range of vertices, about.
GATHERED = 500_000
RANGE = 1_000_000
#: Times that many pairs travel to their ranges, some ranges each time, and ranges from which on it is one more.
PASSES, RANGES = 2, 16
#: Pairs that are looked up at once, and rows given at once.
AT_ONCE = 1 << 21
#: Edges whose lists are asked together, bits of a place in their filter, and pairs that ask at once: few enough to stay in a core's cache.
LISTED, PLACES, ASKED = 1 << 14, 19, 1 << 17
#: Links between vertices that one task joins to components.
MOST_LINKS = 8_000_000


def _small(x: np.ndarray) -> bytes:
    """Least value, width and differences from the least value."""
    low = int(x.min())
    span = int(x.max()) - low
    width = next(w for w in (1, 2, 3, 4, 5, 6, 8) if w == 8 or span < 1 << (8 * w))
    room = next(w for w in (1, 2, 4, 8) if w >= width)
    made = (x - low).astype(f"<u{room}")
    if width < room:
        made = made.view(np.uint8).reshape(-1, room)[:, :width]
    return np.array([low, width], "<i8").tobytes() + made.tobytes()


def _large(b: bytes) -> np.ndarray:
    low, width = np.frombuffer(b[:16], "<i8")
    if width in (1, 2, 4, 8):
        return np.frombuffer(b, f"<u{width}", offset=16).astype(np.int64) + low
    made = np.zeros(((len(b) - 16) // width, 8), np.uint8)
    made[:, :width] = np.frombuffer(b, np.uint8, offset=16).reshape(-1, width)
    return made.view("<i8").ravel() + low


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Lists:
    """Neighbour lists: edges sorted by u, v, and which pairs are edges."""

    def __init__(self, u: np.ndarray, v: np.ndarray, low: int, span: int) -> None:
        self.u, self.v, self.low, self.span = u, v, low, span
        self.begin = _starts(u)
        self.tails = u[self.begin]
        self.size = np.diff(np.r_[self.begin, len(u)])
        self.row = np.repeat(np.arange(len(self.begin)), self.size)
        self.key = self.row * span + (v - low)
        bits = max(6, (16 * len(u)).bit_length())
        self.shift = np.uint64(64 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[self._place(self.key)] = True
        self.seen = np.packbits(seen, bitorder="little")

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, row: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked pairs are edges, and their places."""
        key = row * self.span + (v - self.low)
        place = self._place(key)
        some = np.flatnonzero((self.seen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
        key = key[some]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return some[hit], at[hit]


def lists(*pairs: tuple[np.ndarray, np.ndarray]) -> list[Lists]:
    """Lists of blocks that are to be closed with each other; very wide ids are numbered anew."""
    vs = [v for _, v in pairs]
    low, high = min(int(v.min()) for v in vs), max(int(v.max()) for v in vs)
    if max(len(v) for v in vs) * (high - low + 1) >= 1 << 62:
        vs = np.split(np.unique(np.concatenate(vs), return_inverse=True)[1].astype(np.int64), np.cumsum([len(v) for v in vs])[:-1])
        low, high = 0, max(int(v.max()) for v in vs)
    made = [Lists(u, v, low, high - low + 1) for (u, _), v in zip(pairs, vs, strict=True)]
    for own, (_, v) in zip(made, pairs, strict=True):
        own.true_v = v
    return made


def closed(p: Lists, q: Lists) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of (u, v) in ``p``, (u, w) in ``p`` and (v, w) in ``q`` of the triangles u < v < w."""
    for lo in range(0, len(p.true_v), AT_ONCE):  # look-ups of some edges at a time, for memory
        yield from _closed(p, q, lo, p.true_v[lo : lo + AT_ONCE])


def _closed(p: Lists, q: Lists, lo: int, true_v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    row = np.minimum(np.searchsorted(q.tails, true_v), len(q.tails) - 1)
    edge = np.flatnonzero(q.tails[row] == true_v)
    row, edge = row[edge], edge + lo
    there = q.size[row]
    here = (p.begin + p.size)[p.row[edge]] - edge - 1
    there_less = there <= here
    counts = np.minimum(here, there)
    first = np.where(there_less, q.begin[row], edge + 1)
    for side in (True, False):
        chosen = np.flatnonzero((there_less == side) & (counts > 0))
        upto = np.cumsum(counts[chosen])
        at = 0
        while at < len(chosen):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            c = chosen[at:end]
            n = counts[c]
            which = np.repeat(c, n)
            third = np.repeat(first[c], n) + _within(n)
            if side:
                hit, other = p.find(p.row[edge[which]], q.v[third])
                yield edge[which[hit]], other, third[hit]
            else:
                hit, other = q.find(row[which], p.v[third])
                yield edge[which[hit]], third[hit], other
            at = end


def _ranked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The ends numbered from 0 by their degrees, and how many there are."""
    low = min(int(u.min()), int(v.min()))
    span = max(int(u.max()), int(v.max())) - low + 1
    x, y, names = u - low, v - low, None
    if span > 8 * len(u) + (1 << 16):
        names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        x, y = np.split(ends, 2)
        span = len(names)
    deg = np.bincount(x, minlength=span) + np.bincount(y, minlength=span)
    some = np.flatnonzero(deg)
    rank = np.zeros(span, np.int32)
    rank[some[np.argsort(deg[some], kind="stable")]] = np.arange(len(some))
    return rank[x], rank[y], len(some)


def closed_within(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the three edges of each triangle of u, v, once, in no order.

    Lists go from vertices of few edges to those of more, so none is long. Some lists at a time are held in a filter, and
    what it lets through is held against the edges themselves.
    """
    if not len(u):
        return
    x, y, n = _ranked(u, v)
    a, b = np.minimum(x, y), np.maximum(x, y)
    key = a.astype(np.int64) * n + b
    order = np.argsort(key)
    key, a, b, order = key[order], a[order], b[order], order.astype(np.int32)
    del x, y
    size = np.bincount(a, minlength=n)
    begin = np.cumsum(size) - size
    tail, head = a.astype(np.uint32) * np.uint32(0x9E3779B1), b.astype(np.uint32) * np.uint32(0x85EBCA77)
    shift, seen = np.uint32(32 - PLACES), np.zeros(1 << PLACES, bool)
    found, told, lo = [], 0, 0
    while lo < len(a):
        hi = len(a) if lo + LISTED >= len(a) else int(begin[a[lo + LISTED]])
        hi = hi if hi > lo else lo + int(size[a[lo]])
        place = (tail[lo:hi] + head[lo:hi]) >> shift
        seen[place] = True
        counts, first = size[b[lo:hi]], begin[b[lo:hi]]
        upto, at = np.cumsum(counts), 0
        while at < hi - lo:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ASKED, "right")))
            c = counts[at:end]
            third = np.repeat(first[at:end] - (upto[at:end] - c - upto[at] + c[0]), c)
            third += np.arange(len(third))
            which = np.repeat(np.arange(lo + at, lo + end), c)
            h = tail[which]
            h += head[third]
            h >>= shift
            left = np.flatnonzero(seen[h])
            which, third = which[left], third[left]
            asked = a[which].astype(np.int64) * n + b[third]
            other = np.minimum(np.searchsorted(key[lo:hi], asked), hi - lo - 1) + lo
            hit = key[other] == asked
            found.append((order[which[hit]], order[other[hit]], order[third[hit]]))
            told += len(found[-1][0])
            if told > AT_ONCE:
                yield tuple(np.concatenate(f) for f in zip(*found, strict=True))
                found, told = [], 0
            at = end
        seen[place] = False
        lo = hi
    if told:
        yield tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], pa.int64()) for c in columns.values()], list(columns))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal first column, which lie together."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            key = r[batch.schema.names[0]]
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(r)
    if rows:
        yield now, rows


def _edges_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v, eid of packed rows in their order."""
    u, v = (np.concatenate([_large(r[c]) for r in rows]) for c in ("us", "vs"))
    eid = np.concatenate([r["eid"] + np.arange(r["n"]) for r in rows])
    return u, v, eid


_ROW = "eid long, n long, us binary, vs binary"


def _row(first: int, u: np.ndarray, v: np.ndarray) -> list:
    return [first, len(u), _small(u), _small(v)]


def _table(rows: list[list], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by the columns, each row once."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    some = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return tuple(c[some] for c in columns)


def sorted_rows(source: DataFrame, pairs: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, ...]]], label: str = "packed-edges", names: tuple[str, ...] = ("us", "vs")) -> DataFrame:
    """Written packed rows (p, eid, n, us, vs) of the pairs that ``pairs`` makes from ``source``, sorted by u, v, each once.

    The pairs are made once for the ranges of u with about ``RANGE`` pairs each, and again to travel packed to their range: many
    in up to ``PASSES`` parts, so that the shuffle of one part alone is there beside what is written. With
    more ``names`` than two, what else belongs to a pair comes along, and a row has all pairs of its first vertices.
    """
    packing = ", ".join(f"{c} binary" for c in names)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, *_ in pairs(batches):
            if len(u):
                at = np.linspace(0, len(u) - 1, len(u) // 2000 + 2).astype(np.int64)
                yield from _batches({"u": np.sort(u)[at], "n": np.full(len(at), max(1, len(u) // len(at)))})

    found = source.mapInArrow(sampled, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).toArrow().sort_by("u")
    u, n = (found.column(i).to_numpy() for i in (0, 1))
    upto = np.cumsum(n)
    parts = max(1, -(-int(upto[-1]) // RANGE)) if len(upto) else 1
    cuts = np.unique(u[np.searchsorted(upto, np.arange(1, parts) * (upto[-1] / parts))]) if parts > 1 else np.empty(0, np.int64)

    def deal(first: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """To the ranges ``first..end``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for made in pairs(batches):
                if first:
                    some = np.flatnonzero(made[0] >= cuts[first - 1])
                    made = tuple(c[some] for c in made)
                if end <= len(cuts):
                    some = np.flatnonzero(made[0] < cuts[end - 1])
                    made = tuple(c[some] for c in made)
                if len(made[0]):
                    made = distinct(*made)
                    own = np.searchsorted(cuts, made[0], "right")
                    at = [*_starts(own).tolist(), len(own)]
                    yield _table([[int(own[lo]), hi - lo, *(_small(c[lo:hi]) for c in made)] for lo, hi in zip(at, at[1:])], f"p long, n long, {packing}")

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _groups(batches):
            made = distinct(*(np.concatenate([_large(r[c]) for r in rows]) for c in names))
            at = np.arange(0, len(made[0]), 1 << 13)
            if len(names) > 2:
                begin = _starts(made[0])
                at = np.unique(begin[np.searchsorted(begin, at, "right") - 1])
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(made[0])]):
                yield _table([[p, lo, hi - lo, *(_small(c[lo:hi]) for c in made)]], f"p long, eid long, n long, {packing}")

    schema, path = f"p long, eid long, n long, {packing}", new_path(source.sparkSession, label)
    ends = np.linspace(0, len(cuts) + 1, min(PASSES, 1 + len(cuts) // RANGES) + 1).astype(np.int64).tolist()
    for first, end in pairwise(ends):
        if len(ends) > 2:
            free_shuffles(source.sparkSession)
        dealt = source.mapInArrow(deal(first, end), f"p long, n long, {packing}").repartitionById(end - first, (F.col("p") - first).cast("int"))
        append(dealt.mapInArrow(merge, schema), path)
    return source.sparkSession.read.schema(schema).parquet(path)


def _by_group(members: DataFrame) -> DataFrame:
    """Written rows (task, ks, xs) of the distinct members x and their groups' keys k0, whole numbers; a group's rows have one task."""
    rows = members.dropna().select(F.col("x").cast("long"), F.col("k0").cast("long").alias("k"))
    tasks = int(max(1, min(2000, rows.count() // GATHERED)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            x, k = (np.concatenate(c) for c in zip(*held, strict=True))
            own = ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % tasks
            order = np.lexsort((x, k, own))
            x, k, own = x[order], k[order], own[order]
            some = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])])
            x, k, own = x[some], k[some], own[some]
            at = [*_starts(own).tolist(), len(x)]
            made = [[int(own[lo]), int(k[lo]), _small(np.diff(k[lo:hi], prepend=k[lo])), _small(x[lo:hi])] for lo, hi in zip(at, at[1:])]
            yield _table(made, "task long, k long, ks binary, xs binary")

        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            n += b.num_rows
            if n > AT_ONCE:
                yield from told()
                held, n = [], 0
        if n:
            yield from told()

    packed = rows.mapInArrow(pack, "task long, k long, ks binary, xs binary")
    return cut(packed.repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("task"), "groups")


def members_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and members of packed groups, sorted, each once."""
    return distinct(np.concatenate([r["k"] + np.cumsum(_large(r["ks"])) for r in rows]), np.concatenate([_large(r["xs"]) for r in rows]))


def _pairs_of_groups(batches: Iterator[pa.RecordBatch], with_groups: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """u < v of each two members of a group, many at once, and the group's key if asked for; a pair that several groups have may come again."""
    for _, rows in _groups(batches):
        k, x = members_of(rows)
        begin = _starts(k)
        size = np.diff(np.r_[begin, len(k)])
        after = np.repeat(size, size) - 1 - _within(size)
        upto, at = np.cumsum(after), 0
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            first = np.repeat(np.arange(at, end), after[at:end])
            yield x[first], x[first + 1 + _within(after[at:end])], *([k[first]] if with_groups else [])
            at = end


def packed(edges: DataFrame | Packed) -> Packed:
    return edges if isinstance(edges, Packed) else Packed(edges)


class Packed:
    """Canonical edges in written rows: p (partition), eid (place of the first edge in its partition), n, us, vs."""

    #: With these, edges are made from the groups where they are needed, and rows only if asked for.
    sets: Sets | None = None

    def __init__(self, edges: DataFrame, block: int = BLOCK) -> None:
        self.spark, self.block = edges.sparkSession, block

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, part = 0, TaskContext.get().partitionId()
            for b in batches:
                if b.num_rows:
                    u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    yield _table([[part, *_row(at, u, v)]], f"p long, {_ROW}")
                    at += len(u)

        rows = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).repartitionByRange("u").sortWithinPartitions("u", "v")
        self.rows = cut(rows.mapInArrow(pack, f"p long, {_ROW}"), "packed-edges")

    @classmethod
    def of(cls, rows: DataFrame, block: int = BLOCK) -> Packed:
        """Of written rows (p, eid, n, us, vs), in the order of u, v by p and eid."""
        own = cls.__new__(cls)
        own.spark, own.block, own.rows = rows.sparkSession, block, rows
        return own

    @classmethod
    def of_groups(cls, members: DataFrame, block: int = BLOCK) -> Packed:
        """Of the edges between members x of the same group; k0, a whole number, is its key. Members travel, and packed pairs, but no rows of pairs.
        With many pairs, sets of groups are looked for that no triangle leaves."""
        from edgeloom.operators.sets import sets_of

        groups = _by_group(members)
        if sets := sets_of(groups):
            return cls._of_sets(groups.sparkSession, sets, block)
        own = cls.of(sorted_rows(groups, _pairs_of_groups), block)
        drop(groups)
        return own

    @classmethod
    def _of_sets(cls, spark: SparkSession, sets: Sets, block: int) -> Packed:
        own = cls.__new__(cls)
        own.spark, own.block, own.sets = spark, block, sets
        return own

    @cached_property
    def rows(self) -> DataFrame:
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for u, v in _pairs_of_groups(batches):
                yield (u, v) if sign > 0 else (-v, -u)

        sign = self.sets.sign
        return sorted_rows(self.sets.groups, pairs)

    def _of_tasks(self, give: Callable[[tuple], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """``give(u, v, Lists)`` of the edges of each task of the sets, which has all their triangles."""
        return self.sets.work(lambda u, v: give(u, v, lists((u, v))[0]), schema)

    def turned(self) -> Packed:
        """-v, -u of each edge: the same graph with its vertices in reverse order."""

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, n = [], 0
            for b in batches:
                for r in b.to_pylist():
                    held.append((-_large(r["vs"]), -_large(r["us"])))
                    n += r["n"]
                    if n > AT_ONCE:
                        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                        held, n = [], 0
            if n:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

        if self.sets is not None:
            return Packed._of_sets(self.spark, self.sets.turned(), self.block)
        return Packed.of(sorted_rows(self.rows, pairs), self.block)

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802 - as a DataFrame has it
        return self.spark

    @cached_property
    def begin(self) -> dict[int, int]:
        """Edges before each partition."""
        at, out = 0, {}
        for p, n in sorted(tuple(r) for r in self.rows.groupBy("p").agg(F.sum("n")).collect()):
            out[p] = at
            at += n
        return out

    @cached_property
    def n(self) -> int:
        if self.sets is not None:
            return self.measures["undirected_edges"]
        return self.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def edges(self) -> DataFrame:
        """eid, u, v."""
        begin = self.begin

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    u, v = _large(r["us"]), _large(r["vs"])
                    yield from _batches({"eid": begin[r["p"]] + r["eid"] + np.arange(len(u)), "u": u, "v": v})

        return self.rows.mapInArrow(run, "eid long, u long, v long")

    def degrees(self) -> DataFrame:
        """v, deg; counted where the edges lie, then added up."""
        if self.sets is not None:
            return self.sets.work(lambda u, v: [dict(zip(("v", "deg"), np.unique(np.concatenate([u, v]), return_counts=True)))], "v long, deg long").groupBy("v").agg(F.sum("deg").alias("deg"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def told() -> Iterator[pa.RecordBatch]:
                v, deg = np.unique(np.concatenate(held), return_counts=True)
                yield from _batches({"v": v, "deg": deg})

            for b in batches:
                for r in b.to_pylist():
                    held += [_large(r["us"]), _large(r["vs"])]
                    n += r["n"]
                    if n > AT_ONCE:
                        yield from told()
                        held, n = [], 0
            if n:
                yield from told()

        return self.rows.mapInArrow(run, "v long, deg long").groupBy("v").agg(F.sum("deg").alias("deg"))

    @cached_property
    def measures(self) -> dict[str, int]:
        """vertex_count (largest id + 1), active_vertices, undirected_edges, d_max, triangle_count; all 0 for no edges."""
        of_vertices = self.degrees().agg(F.max(F.col("v") + 1).alias("vertex_count"), F.count("*").alias("active_vertices"), F.max("deg").alias("d_max"), (F.sum("deg") / 2).cast("long").alias("undirected_edges")).first()
        found = of_vertices.asDict() | {"triangle_count": self.triangle_count().first()[0]}
        return {name: x or 0 for name, x in found.items()}

    @cached_property
    def cuts(self) -> np.ndarray:
        """Vertices with which blocks begin, all but the first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _batches({"u": np.array([_large(r["us"])[-1] for r in b.to_pylist()], np.int64), "n": b.column(2).to_numpy(zero_copy_only=False)})

        found = self.rows.mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).toArrow().sort_by("u")
        u, n = (found.column(i).to_numpy() for i in (0, 1))
        upto = np.cumsum(n)
        parts = int(upto[-1]) // self.block if len(upto) else 0
        return np.unique(u[np.minimum(np.searchsorted(upto, np.arange(1, parts + 1) * self.block), len(u) - 1)] + 1) if parts else np.empty(0, np.int64)

    def _dealt(self) -> DataFrame:
        """task, role (0: first block, 1: second, 2: both), eid, n, us, vs; a partition has whole tasks, each sorted by role and eid."""
        cuts, begin = self.cuts, self.begin
        blocks = len(cuts) + 1

        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((blocks, blocks), bool) if blocks < 5000 else None
            for b in batches:
                some = []
                for r in b.to_pylist():
                    x, y = (np.searchsorted(cuts, _large(r[c]), "right") for c in ("us", "vs"))
                    pairs = np.unique(x * blocks + y)
                    if seen is not None:
                        pairs = pairs[~seen.ravel()[pairs]]
                        seen.ravel()[pairs] = True
                    some.append(pairs)
                yield from _batches({"task": np.unique(np.concatenate(some)) if some else np.empty(0, np.int64)})

        tasks = sorted(r[0] for r in self.rows.mapInArrow(links, "task long").distinct().collect())
        roles: dict[int, list[tuple[int, int]]] = {}
        for t in tasks:
            x, y = divmod(t, blocks)
            for b, role in [(x, 2)] if x == y else [(x, 0), (y, 1)]:
                roles.setdefault(b, []).append((t, role))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    u, v = _large(r["us"]), _large(r["vs"])
                    own = np.searchsorted(cuts, u, "right")
                    at = [*_starts(own).tolist(), len(u)]
                    out = []
                    for lo, hi in zip(at, at[1:]):
                        row = _row(begin[r["p"]] + r["eid"] + lo, u[lo:hi], v[lo:hi])
                        out += [[t, role, *row] for t, role in roles.get(int(own[lo]), [])]
                    if out:
                        yield _table(out, f"task long, role long, {_ROW}")

        dealt = self.rows.mapInArrow(deal, f"task long, role long, {_ROW}")
        return dealt.repartition(max(1, min(len(tasks), 2000)), "task").sortWithinPartitions("task", "role", "eid")

    def _closing(self, give: Callable, schema: str) -> DataFrame:
        """``give(p, q)`` makes batches from (u, v, eid, Lists) of the two blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _groups(batches):
                first, second = [r for r in rows if r["role"] != 1], [r for r in rows if r["role"] == 1]
                if first and (second or first[0]["role"] == 2):
                    p = _edges_of(first)
                    q = _edges_of(second) if second else p
                    made = lists(p[:2], q[:2]) if second else lists(p[:2]) * 2
                    yield from give((*p, made[0]), (*q, made[1]))

        return self._dealt().mapInArrow(run, schema)

    def triangles(self) -> DataFrame:
        """u, v, w."""
        if self.sets is not None:
            return self._of_tasks(lambda u, v, p: ({"u": u[a], "v": v[a], "w": v[b]} for a, b, _ in closed(p, p)), "u long, v long, w long")

        def give(p, q):
            for a, b, _ in closed(p[3], q[3]):
                yield from _batches({"u": p[0][a], "v": p[1][a], "w": p[1][b]})

        return self._closing(give, "u long, v long, w long")

    def triangle_count(self) -> DataFrame:
        """n: the triangles, counted where they are closed."""

        def give(p, q):
            yield from _batches({"n": np.array([sum(len(a) for a, _, _ in closed(p[3], q[3]))])})

        found = self._closing(give, "n long") if self.sets is None else self.sets.work(lambda u, v: ({"n": np.array([len(a)])} for a, _, _ in closed_within(u, v)), "n long")
        return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def triples(self) -> DataFrame:
        """e1, e2, e3: ids of (u, v), (u, w), (v, w)."""

        def give(p, q):
            for a, b, c in closed(p[3], q[3]):
                yield from _batches({"e1": p[2][a], "e2": p[2][b], "e3": q[2][c]})

        return self._closing(give, "e1 long, e2 long, e3 long")

    def supports(self) -> DataFrame:
        """u, v, sup of all edges, and eid where they are in rows. Counts travel packed to the edges of their block."""
        if self.sets is not None:
            return self.sets.work(lambda u, v: [{"u": u, "v": v, "sup": sum((np.bincount(s, minlength=len(u)) for of in closed_within(u, v) for s in of), np.zeros(len(u), np.int64))}], "u long, v long, sup long")
        cuts, begin = self.cuts, self.begin

        def give(p, q):
            p_sup = np.zeros(len(p[0]), np.int64)
            q_sup = p_sup if q[3] is p[3] else np.zeros(len(q[0]), np.int64)
            for a, b, c in closed(p[3], q[3]):
                for sup, x in ((p_sup, a), (p_sup, b), (q_sup, c)):
                    sup += np.bincount(x, minlength=len(sup))
            for (u, _, eid, _), sup in [(p, p_sup)] + ([] if q_sup is p_sup else [(q, q_sup)]):
                whole = np.searchsorted(cuts, u[0], "right")  # a block is a run of ids
                for at in range(0, len(sup), 1 << 15):
                    yield _table([[whole, *_row(eid[at], sup[at : at + (1 << 15)], np.zeros(1, np.int64))]], f"block long, {_ROW}")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    u, v = _large(r["us"]), _large(r["vs"])
                    block = np.searchsorted(cuts, u, "right")
                    at = [*_starts(block).tolist(), len(u)]
                    yield _table([[int(block[lo]), *_row(begin[r["p"]] + r["eid"] + lo, u[lo:hi], v[lo:hi])] for lo, hi in zip(at, at[1:])], f"block long, {_ROW}")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _groups(batches):
                u, v, eid = _edges_of([r for r in rows if not r["counts"]])
                sup = np.zeros(len(u), np.int64)
                for r in rows:
                    if r["counts"]:
                        at = r["eid"] - eid[0]
                        sup[at : at + r["n"]] += _large(r["us"])
                yield from _batches({"eid": eid, "u": u, "v": v, "sup": sup})

        schema = f"block long, {_ROW}"
        both = self.rows.mapInArrow(own, schema).withColumn("counts", F.lit(False)).unionByName(self._closing(give, schema).withColumn("counts", F.lit(True)))
        both = both.repartition(max(1, min(len(cuts) + 1, 2000)), "block").sortWithinPartitions("block", "counts", "eid")
        return both.mapInArrow(add, "eid long, u long, v long, sup long")

    def apart(self, most: int) -> tuple[DataFrame | None, DataFrame | None]:
        """Edges of components of at most ``most`` edges, as rows (label, task, eid, n, us, vs), and u, v of the others; None
        where there are none. Nothing is apart if the parts of components are too many for one task. A component's label is its
        least vertex; those of all vertices reach the tasks packed. ``tasks`` is set to the number of tasks of the first: each has
        components of about ``BLOCK`` edges, or a larger one alone."""
        self.tasks = 0
        if not most or not self.n:
            return None, self.edges().select("u", "v")

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Links of vertices to labels, and the edges of each label (u = v)."""
            held, n = [], 0

            def told() -> Iterator[pa.RecordBatch]:
                u, v = (np.concatenate([_large(r[c]) for r in held]) for c in ("us", "vs"))
                moved, root = joined(u, v)
                tails, of = np.unique(_mapped(u, moved, root), return_counts=True)
                yield from _batches({"u": np.concatenate([moved, tails]), "v": np.concatenate([root, tails]), "n": np.concatenate([np.zeros(len(moved), np.int64), of])})

            for b in batches:
                for r in b.to_pylist():
                    held.append(r)
                    n += r["n"]
                    if n > 2 * AT_ONCE:
                        yield from told()
                        held, n = [], 0
            if n:
                yield from told()

        links = cut(self.rows.mapInArrow(local, "u long, v long, n long"), "links")
        if links.count() > MOST_LINKS:
            return None, self.edges().select("u", "v")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
            u, v, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            apart = u != v
            moved, root = joined(u[apart], v[apart])
            names, place = np.unique(_mapped(u, moved, root), return_inverse=True)
            of = np.zeros(len(names), np.int64)
            np.add.at(of, place, n)
            large, some = names[of > most], of <= most
            firsts, n = [], BLOCK
            for name, size in zip(names[some].tolist(), of[some].tolist(), strict=True):
                n += size
                if n > BLOCK:
                    firsts.append(name)
                    n = size
            made = [[0, _small(moved[at : at + (1 << 16)]), _small(root[at : at + (1 << 16)])] for at in range(0, len(moved), 1 << 16)]
            yield _table([*made, [len(firsts), *(_small(np.array(x, np.int64)) if len(x) else b"" for x in (large, firsts))]], "n long, us binary, vs binary")

        *labels, last = links.coalesce(1).mapInArrow(whole, "n long, us binary, vs binary").collect()
        drop(links)
        moved, root = [bytes(r["us"]) for r in labels], [bytes(r["vs"]) for r in labels]
        large, firsts = (_large(bytes(last[c])) if len(last[c]) else np.empty(0, np.int64) for c in ("us", "vs"))
        self.tasks, begin = last["n"], self.begin

        def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            names, to = np.concatenate([_large(x) for x in moved]), np.concatenate([_large(x) for x in root])
            for b in batches:
                for r in b.to_pylist():
                    u, v = _large(r["us"]), _large(r["vs"])
                    label = _mapped(u, names, to)
                    yield r, u, v, label, np.isin(label, large)

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, u, v, label, other in labelled(batches):
                at, first = [*_starts(label).tolist(), len(u)], begin[r["p"]] + r["eid"]
                task = np.searchsorted(firsts, label, "right") - 1
                made = [[int(label[lo]), int(task[lo]), *_row(first + lo, u[lo:hi], v[lo:hi])] for lo, hi in zip(at, at[1:]) if not other[lo]]
                if made:
                    yield _table(made, f"label long, task long, {_ROW}")

        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, u, v, _, other in labelled(batches):
                yield from _batches({"u": u[other], "v": v[other]})

        small = self.rows.mapInArrow(pieces, f"label long, task long, {_ROW}") if self.tasks else None
        return small, self.rows.mapInArrow(out, "u long, v long") if len(large) else None


def _mapped(x: np.ndarray, names: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``to`` of what is among ``names`` (ascending), itself for the rest."""
    if not len(names):
        return x
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return np.where(names[at] == x, to[at], x)


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex and the least of its component, where they differ."""
    if not len(u):
        return u, v
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = np.split(ends.astype(np.int64), 2)
    label = np.arange(len(names))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        at = _starts(high)
        label[high[at]] = low[at]  # each to its least neighbour: no circles
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def on_components(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str], tasks: int, at_once: int = BLOCK) -> DataFrame:
    """u, v and what ``work(u, v)`` gives for the edges of whole components, some small ones together; rows and ``tasks`` as :meth:`Packed.apart` gives them.
    There are two tasks at least, one without rows: Spark makes one of the only tasks of two such tables when they are united."""

    def given(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        parts.sort(key=lambda r: r["eid"])
        u, v = _edges_of(parts)[:2]
        yield from _batches({"u": u, "v": v, **work(u, v)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for _, more in _groups(batches):
            size = sum(r["n"] for r in more)
            if waiting and n + size > at_once:
                yield from given(waiting)
                waiting, n = [], 0
            waiting, n = waiting + more, n + size
        if waiting:
            yield from given(waiting)

    dealt = rows.repartitionById(max(2, tasks), F.col("task").cast("int")).sortWithinPartitions("label", "eid")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ["u", "v", *names]))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """u, v, k, k2 where the values k of two tables of edges differ (null: absent). Edges travel packed, those of 64
    vertices together, and are held against each other in a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            group = ((u >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64) ^ (v >> 22)
            order = np.lexsort((v, u, group))
            u, v, k, group = u[order], v[order], k[order], group[order]
            at = [*_starts(group).tolist(), len(u)]
            if len(u):
                yield _table([[int(group[lo]), len(u[lo:hi]), *(_small(x[lo:hi]) for x in (u, v, k))] for lo, hi in zip(at, at[1:])], "task long, n long, us binary, vs binary, ks binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            u, v, k = (np.concatenate([_large(r[c]) for r in rows]) for c in ("us", "vs", "ks"))
            second = np.repeat([r["second"] for r in rows], [r["n"] for r in rows])
            order = np.lexsort((second, v, u))
            u, v, k, second = u[order], v[order], k[order], second[order]
            begins = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
            at = np.flatnonzero(begins)
            last = np.r_[at[1:], len(u)] - 1
            wrong = (at == last) | (k[at] != k[last])
            at, last = at[wrong], last[wrong]
            for lo in range(0, len(at), 1 << 16):
                x, y = at[lo : lo + (1 << 16)], last[lo : lo + (1 << 16)]
                columns = [pa.array(u[x], pa.int64()), pa.array(v[x], pa.int64()), pa.array(k[x], pa.int64(), mask=second[x]), pa.array(k[y], pa.int64(), mask=~second[y])]
                yield pa.RecordBatch.from_arrays(columns, ["u", "v", "k", "k2"])

    of = lambda df: df.filter("k IS NOT NULL").select(*(F.col(c).cast("long") for c in ("u", "v", "k"))).mapInArrow(pack, "task long, n long, us binary, vs binary, ks binary")
    both = of(a).withColumn("second", F.lit(False)).unionByName(of(b).withColumn("second", F.lit(True)))
    return both.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "u long, v long, k long, k2 long")
