"""Sets of groups that no triangle leaves: work on graphs of groups without sorting or sending their edges.

The edges of a group are made where its members lie. Two groups are linked if they have an edge in common or if a triangle has
edges of both, so linked groups together have all triangles of their edges, and values of edges that depend on triangles alone
(truss values, supports) can be found set by set. Blocks of vertices do not do this: a vertex is in many groups, and in a graph
of one component each block of edges travels to all others.

To find the links, the edges lie once with their groups, in ranges of their smaller vertex. Two edges of a vertex from different groups
ask a filter of all edges (``BITS`` bits an edge, ``PROBES`` places each) whether their other ends are joined; what it lets through is
held against the edges themselves, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.blocks import BLOCK, _batches, _groups, _large, _mapped, _pairs_of_groups, _small, _starts, _table, _within, distinct, joined, members_of, sorted_rows
from edgeloom.plans.materialize import cut, drop, free_shuffles, new_path

#: Pairs in groups from which on sets are looked for.
LARGE = 8_000_000
#: Edges of a set, which one task has in memory.
MOST_EDGES = 8_000_000
BITS, PROBES = 16, 6
#: Bytes of the filter, pairs of edges asked for an edge, links: with more, blocks of vertices do the work.
MOST_FILTER, MOST_ASKED, MOST_LINKS = 200_000_000, 300, 8_000_000
#: Pairs that ask at once: few enough to stay in a core's cache.
ASKED = 1 << 17
_LOW = np.uint64((1 << 32) - 1)


def _pairs_with_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return _pairs_of_groups(batches, with_groups=True)


def _half(v: np.ndarray, by: int) -> np.ndarray:
    return v.astype(np.uint64) * np.uint64(by)


def _tail(v: np.ndarray) -> np.ndarray:
    return _half(v, 0x9E3779B97F4A7C15)


def _head(w: np.ndarray) -> np.ndarray:
    return _half(w, 0xC2B2AE3D27D4EB4F)


def _mixed(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    h = tail + head
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _place(h: np.ndarray, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
    return (((h & _LOW) + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1)) & _LOW) * size) >> np.uint64(32)


def _cliques(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and members of the groups of two or more, sorted, and for each group its key and number of pairs."""
    for _, rows in _groups(batches):
        k, x = members_of(rows)
        begin = _starts(k)
        size = np.diff(np.r_[begin, len(k)])
        some = np.repeat(size > 1, size)
        yield k[some], x[some], k[begin[size > 1]], (size * (size - 1) // 2)[size > 1]


class Shared:
    """Bytes for all tasks: one file in the shared folder, where a broadcast has one in the driver and in each executor. It is
    broadcast only if the folder is one that Spark alone can write."""

    def __init__(self, of: DataFrame, label: str, parts: pa.ChunkedArray) -> None:
        self.uri, self.sent = new_path(of.sparkSession, label), None
        try:
            system, path = fs.FileSystem.from_uri(self.uri)
        except (pa.ArrowException, OSError):
            self.sent = of.sparkSession.sparkContext.broadcast(b"".join(x.as_py() for x in parts))
            return
        with system.open_output_stream(path) as out:
            for x in parts:
                out.write(x.as_buffer())

    def bytes(self) -> np.ndarray:
        if self.sent is not None:
            return np.frombuffer(self.sent.value, np.uint8)
        system, path = fs.FileSystem.from_uri(self.uri)
        with system.open_input_file(path) as file:
            return np.frombuffer(file.readall(), np.uint8)

    def destroy(self) -> None:
        if self.sent is not None:
            self.sent.destroy()
        else:
            system, path = fs.FileSystem.from_uri(self.uri)
            system.delete_file(path)


def _links(groups: DataFrame) -> DataFrame | None:
    """Written links (a, b) between groups; None if they would take too much."""
    tagged = sorted_rows(groups, _pairs_with_groups, "tagged-edges", ("us", "vs", "gs"))
    free_shuffles(groups.sparkSession)  # before the filter

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filter of the edges of each range, and the pairs that will ask."""
        for p, rows in _groups(batches):
            u, v = (np.concatenate([_large(r[c]) for r in rows]) for c in ("us", "vs"))
            out = np.diff(np.r_[_starts(u), len(u)])
            bits = np.zeros(-(-BITS * len(u) // 64) * 64, bool)
            h = _mixed(_tail(u), _head(v))
            for i in range(PROBES):
                bits[_place(h, i, np.uint64(len(bits)))] = True
            yield _table([[p, int(u[0]), len(u), int((out * (out - 1) // 2).sum()), np.packbits(bits, bitorder="little").tobytes()]], "p long, first long, n long, asked long, bits binary")

    n = tagged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n * BITS // 8 > MOST_FILTER:
        drop(tagged)
        return None
    found = tagged.select("p", "n", "us", "vs").mapInArrow(segment, "p long, first long, n long, asked long, bits binary").toArrow().sort_by("first")
    if not n or sum(found["asked"].to_pylist()) > MOST_ASKED * n:
        drop(tagged)
        return None
    sizes = np.array([len(b.as_buffer()) for b in found["bits"]], np.uint64) * np.uint64(8)
    firsts, shared = found["first"].to_numpy(), Shared(tagged, "edge-filter", found["bits"])
    del found

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(v, w, a, b): ends of two edges from one vertex, of the groups a and b, that the filter holds for joined. With
        v = w, an edge of two groups."""
        bits, begins = shared.bytes(), np.cumsum(sizes) - sizes
        for batch in batches:
            for r in batch.to_pylist():
                u, v, g = (_large(r[c]) for c in ("us", "vs", "gs"))
                again = np.flatnonzero((u[1:] == u[:-1]) & (v[1:] == v[:-1])) + 1
                held = [(v[again], v[again], g[again - 1], g[again])]
                some = np.delete(np.arange(len(u)), again)
                u, v, g = u[some], v[some], g[some]
                size = np.diff(np.r_[_starts(u), len(u)])
                after = np.repeat(size, size) - 1 - _within(size)
                part = np.maximum(np.searchsorted(firsts, v, "right") - 1, 0)
                tail, head, begin, width = _tail(v), _head(v), begins[part], sizes[part]
                upto, at = np.cumsum(after), 0
                while at < len(u):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ASKED, "right")))
                    n = after[at:end]
                    one = np.repeat(np.arange(at, end), n)
                    two = one + 1 + _within(n)
                    h = _mixed(np.repeat(tail[at:end], n), head[two])
                    place = np.repeat(begin[at:end], n) + _place(h, 0, np.repeat(width[at:end], n))
                    left = np.flatnonzero((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                    one, two, h = one[left], two[left], h[left]
                    left = np.flatnonzero(g[one] != g[two])
                    for i in range(1, PROBES):
                        one, two, h = one[left], two[left], h[left]
                        place = begin[one] + _place(h, i, width[one])
                        left = np.flatnonzero((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                    one, two = one[left], two[left]
                    held.append((v[one], v[two], g[one], g[two]))
                    at = end
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                if len(columns[0]):
                    yield _table([[len(columns[0]), *map(_small, columns)]], _ASKED)

    asked = cut(tagged.select("us", "vs", "gs").mapInArrow(ask, _ASKED), "asked")
    n = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared.destroy()  # before the next
    links = None
    if n <= MOST_LINKS:
        rows = asked.toArrow()
        v, w, a, b = (np.concatenate([_large(x.as_py()) for x in rows[c]]) if len(rows) else np.empty(0, np.int64) for c in ("vs", "ws", "gs", "hs"))
        order = np.argsort(v, kind="stable")
        wanted = tagged.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (v, w, a, b)))

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of what was asked, the links of the edges that are there."""
            v, w, a, b = wanted.value
            for batch in batches:
                for r in batch.to_pylist():
                    x, y, g = (_large(r[c]) for c in ("us", "vs", "gs"))
                    some = slice(*np.searchsorted(v, [x[0], x[-1] + 1]))
                    low, span = int(y.min()), int(y.max()) - int(y.min()) + 1
                    inside = np.flatnonzero((w[some] >= low) & (w[some] < low + span)) + some.start
                    names = x[_starts(x)]
                    row = np.minimum(np.searchsorted(names, v[inside]), len(names) - 1)
                    inside, row = inside[names[row] == v[inside]], row[names[row] == v[inside]]
                    own, key = np.searchsorted(names, x) * span + (y - low), row * span + (w[inside] - low)
                    place = np.minimum(np.searchsorted(own, key), len(own) - 1)
                    hit = own[place] == key
                    inside, third = inside[hit], g[place[hit]]
                    yield from _batches({"a": np.concatenate([a[inside], a[inside]]), "b": np.concatenate([b[inside], third])})

        same = np.flatnonzero(v == w)
        links = cut(tagged.select("us", "vs", "gs").mapInArrow(hold, "a long, b long").unionByName(_frame(tagged, a[same], b[same])).distinct(), "group-links")
        wanted.destroy()
    drop(tagged, asked)
    return links


_ASKED = "n long, vs binary, ws binary, gs binary, hs binary"


def _frame(of: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
    return of.sparkSession.createDataFrame(pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}))


class Sets:
    """The groups, dealt to tasks by sets; each task has sets of about ``BLOCK`` edges together, or a larger one alone."""

    def __init__(self, groups: DataFrame, moved: np.ndarray, root: np.ndarray, large: np.ndarray, tasks: int, sign: int = 1) -> None:
        self.groups, self.moved, self.root, self.large, self.shared, self.sign = groups, moved, root, large, tasks, sign

    def turned(self) -> Sets:
        return Sets(self.groups, self.moved, self.root, self.large, self.shared, -self.sign)

    def work(self, give: Callable[[np.ndarray, np.ndarray], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
        """What ``give(u, v)`` makes of the edges of each task, sorted, each once in one task."""
        moved, root, large, shared, sign = self.moved, self.root, self.large, self.shared, self.sign

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, x, _, _ in _cliques(batches):
                if not len(k):
                    continue
                label = _mapped(k, moved, root)
                own = ((label.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.int64) % shared
                if len(large):
                    at = np.minimum(np.searchsorted(large, label), len(large) - 1)
                    own = np.where(large[at] == label, shared + at, own)
                order = np.argsort(own, kind="stable")
                k, x, own = k[order], x[order], own[order]
                at = [*_starts(own).tolist(), len(k)]
                yield _table([[int(own[lo]), int(k[lo]), _small(np.diff(k[lo:hi], prepend=k[lo])), _small(x[lo:hi])] for lo, hi in zip(at, at[1:])], "task long, k long, ks binary, xs binary")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one in _tasks(batches):
                u, v = (np.concatenate(c) for c in zip(*_pairs_of_groups(iter([one])), strict=True))
                u, v = distinct(u, v) if sign > 0 else distinct(-v, -u)
                for columns in give(u, v):
                    yield from _batches(columns)

        dealt = self.groups.mapInArrow(deal, "task long, k long, ks binary, xs binary").repartitionById(shared + len(large), F.col("task").cast("int"))
        return dealt.sortWithinPartitions("task").mapInArrow(run, schema)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches):
        yield pa.RecordBatch.from_pylist(rows)


def sets_of(groups: DataFrame) -> Sets | None:
    """Sets of at most ``MOST_EDGES`` edges each; None if there are few edges, a larger set, or links take too much."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, n in _cliques(batches):
            yield from _batches({"n": np.array([n.sum()])})

    pairs = groups.mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if pairs <= LARGE:
        return None
    links = _links(groups)
    if links is None:
        return None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if parts:
            moved, root = joined(*(np.concatenate([p[i] for p in parts]) for i in range(2)))
            for at in range(0, len(moved), 1 << 16):
                yield _table([[_small(moved[at : at + (1 << 16)]), _small(root[at : at + (1 << 16)])]], "us binary, vs binary")

    rows = links.coalesce(1).mapInArrow(whole, "us binary, vs binary").collect()
    drop(links)
    moved, root = (np.concatenate([_large(bytes(r[c])) for r in rows]) if rows else np.empty(0, np.int64) for c in ("us", "vs"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the sets of several groups, and of large groups."""
        several = np.unique(root)
        for _, _, k, n in _cliques(batches):
            label = _mapped(k, moved, root)
            some = (n > BLOCK // 4) | np.isin(label, several)
            names, place = np.unique(label[some], return_inverse=True)
            yield from _batches({"label": names, "n": np.bincount(place, n[some], len(names)).astype(np.int64)})

    found = groups.mapInArrow(sizes, "label long, n long").groupBy("label").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK // 4).toArrow()
    label, n = found["label"].to_numpy(), found["n"].to_numpy()
    if len(n) and int(n.max()) > MOST_EDGES:
        return None
    return Sets(groups, moved, root, np.sort(label), max(1, -(-int(pairs - n.sum()) // BLOCK)))
