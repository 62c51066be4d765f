"""Truss values: the threshold at which each edge is peeled.

``K[e]`` is the least k such that e goes when, for k = 0, 1, 2, ..., all edges
in at most k triangles of what is left are removed until none is left to
remove. Four methods give the same values:

peel     all edges at or under k go at once, and the triangles with them; k
         jumps to the least count left, so no round is idle
multi_k  several thresholds at once, each row keyed by its threshold
hindex   start from the triangle counts; each edge takes the largest h such
         that h of its triangles have both other edges at h or more, until
         nothing changes (Sariyuce, Seshadhri and Pinar, PVLDB 2018)
wedge    as peel, but the triangles are found anew from the edges left, after edges at
         vertices of low degree have gone without a look at their triangles

The components of the graph are independent, and a round over all of them costs some jobs
and the writing of all triangles however little changes. So a component of at most ``one_task`` edges (and
``MOST_EDGES``) is done by its method in one task, with its triangles in memory; one with more than ``MOST_TRIANGLES``
triangles is peeled there without storing them. Larger components (and all, if ``one_task`` is 0) go by
rounds of DataFrame operations: state is written to the shared folder each round, only scalars reach the
driver, and ``peel`` and ``hindex`` finish in one task as soon as at most ``one_task`` triangles are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators.blocks import AT_ONCE, Lists, Packed, _within, closed, closed_within, lists, on_components, packed
from edgeloom.operators.model import degrees, edge_ids
from edgeloom.operators.triangles import edge_triples, incidence, support
from edgeloom.plans.materialize import append, cut, drop, new_path

ONE_TASK = 8_000_000
MOST_EDGES = 8_000_000
MOST_TRIANGLES = 12_000_000
#: Triangles that are left when rounds end in one task.
MOST_LEFT = 4_000_000


def truss(edges: DataFrame | Packed, method: str = "hindex", chunk: int = 8, max_run_rows: int = 200_000_000, one_task: int = ONE_TASK) -> DataFrame:
    """u, v, k of every edge."""
    if method == "hindex":
        return hindex(edges, one_task)
    if method == "peel":
        return _peeled(edges, one_task).select("u", "v", "k")
    if method == "wedge":
        return wedge(edges, one_task)
    if method == "multi_k":
        return multi_k(edges, chunk, max_run_rows, one_task)
    raise ValueError(f"unknown method {method!r}: peel, multi_k, hindex or wedge")


def start(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: edges with ids (eid, u, v) and triangles by edge ids (e1, e2, e3)."""
    ids = cut(edge_ids(edges), "truss-edges")
    return ids, cut(edge_triples(ids), "truss-triangles")


def _counts(triples: DataFrame) -> DataFrame:
    return incidence(triples).groupBy("eid").agg(F.count("*").alias("sup"))


def _alive(triples: DataFrame, live: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Triangles whose three edges live."""
    keys = keys or []
    out = triples
    for e in ("e1", "e2", "e3"):
        out = out.join(live.select(*keys, F.col("eid").alias(e)), [*keys, e], "left_semi")
    return out


def _in_one_task(triples: DataFrame, work, schema: str) -> DataFrame:
    """``work(sides)``, a (triangles x 3) array of edges numbered from 0, gives columns
    for the edges; they come back with the edges' ids. For a bounded number of triangles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
        if parts and sum(map(len, parts)):
            ids, sides = np.unique(np.concatenate(parts), return_inverse=True)
            columns = [ids, *work(sides.reshape(-1, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["eid", *(x.split()[0] for x in schema.split(", "))])

    return triples.select("e1", "e2", "e3").coalesce(1).mapInArrow(run, f"eid long, {schema}")


def _peel_task(k: int, first: int, live: int):
    """k and round of each edge in a triangle, going on at ``k`` with the round ``first``, when ``live`` edges are left."""

    def work(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, at, now = int(sides.max()) + 1, first, k
        value, when = np.zeros(m, np.int64), np.zeros(m, np.int64)
        left = np.arange(m)
        while len(left):
            sup = np.bincount(sides.ravel(), minlength=m)[left]
            if at > first or m == live:  # else edges without a triangle go first
                now = max(now, int(sup.min()))
            gone = left[sup <= now]
            value[gone], when[gone] = now, at
            left = left[sup > now]
            dead = np.zeros(m, bool)
            dead[gone] = True
            sides = sides[~dead[sides].any(1)]
            at += 1
        return value, when

    return work


def _stored(u: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """The triangles of a component by the places of their edges; None if they are too many."""
    found, n = [np.empty((0, 3), np.int32)], 0
    for sides in closed_within(u, v):
        n += len(sides[0])
        if n > MOST_TRIANGLES:
            return None
        found.append(np.column_stack([s.astype(np.int32) for s in sides]))
    return np.concatenate(found)


def _schedule(m: int, sup: np.ndarray, remove) -> tuple[np.ndarray, np.ndarray]:
    """k and batch (its number at that k) of each edge; ``remove(gone)`` counts anew the supports of what is left, and may
    tell which edges have lost some: no others can go next at the same k."""
    value, when, k, batch = np.zeros(m, np.int64), np.zeros(m, np.int64), -1, 0
    left, there, n, lost = np.arange(m), np.ones(m, bool), m, None
    while n:
        gone = np.empty(0, np.int64) if lost is None else lost[sup[lost] <= k]
        gone = gone[there[gone]]
        batch += 1
        if not len(gone):
            left = left[there[left]]
            least = int(sup[left].min())
            k, batch = (least, 0) if least > k else (k, batch)
            gone = left[sup[left] <= k]
        value[gone], when[gone], there[gone] = k, batch, False
        n -= len(gone)
        if n:
            lost = remove(gone)
    return value, when


class Incident:
    """Triangles (places of their edges) by edge."""

    def __init__(self, m: int, sides: np.ndarray) -> None:
        self.m, self.sides = m, sides
        self.size = sum((np.bincount(side, minlength=m) for side in sides.T), np.zeros(m, np.int64))
        self.begin = np.cumsum(self.size) - self.size
        self.at, upto = np.empty(sides.size, np.int32), 0
        cuts = np.linspace(0, m, 2 + (sides.size >> 22)).astype(np.int64).tolist()
        for lo, hi in pairwise(cuts):  # the triangles of some edges at a time, for memory
            key = []
            for side in sides.T:
                some = np.flatnonzero((side >= lo) & (side < hi))
                key.append(side[some].astype(np.int64) * len(sides) + some)
            key = np.concatenate(key)
            key.sort()
            self.at[upto : upto + len(key)] = key % max(1, len(sides))
            upto += len(key)
        self.seen, self.met = np.zeros(len(sides), np.int32), np.zeros(m, np.int32)

    def of(self, edges: np.ndarray) -> np.ndarray:
        return self.at[np.repeat(self.begin[edges], self.size[edges]) + _within(self.size[edges])]

    def take(self, gone: np.ndarray, there: np.ndarray, sup: np.ndarray) -> np.ndarray:
        """The triangles of the edges ``gone`` are no longer ``there`` and leave ``sup``; the edges that have lost some, each once."""
        lost = []
        for some in self.parts(gone):
            t = self.of(some)
            t = t[there[t]]
            there[t] = False
            t = self._once(t, self.seen)
            e = self.sides[t].ravel()
            np.subtract.at(sup, e, 1)
            lost.append(self._once(e, self.met))
        lost = np.concatenate(lost)
        return self._once(lost, self.met)

    @staticmethod
    def _once(x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Each of ``x`` once; ``last`` is overwritten."""
        at = np.arange(len(x), dtype=np.int32)
        last[x] = at
        return x[last[x] == at]

    def parts(self, edges: np.ndarray) -> Iterator[np.ndarray]:
        """``edges`` cut where their triangles come to ``AT_ONCE``."""
        upto, at = np.cumsum(self.size[edges]), 0
        while at < len(edges):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            yield edges[at:end]
            at = end


def _peel_stored(m: int, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = Incident(m, sides)
    sup, there = own.size.copy(), np.ones(len(sides), bool)

    return _schedule(m, sup, lambda gone: own.take(gone, there, sup))


def _full_lists(a: np.ndarray, b: np.ndarray, some: np.ndarray, n: int) -> tuple[Lists, np.ndarray]:
    """Both directions of the edges ``some`` between ``n`` vertices, and which edge each is."""
    x, y, e = np.concatenate([a[some], b[some]]), np.concatenate([b[some], a[some]]), np.concatenate([some, some])
    order = np.argsort(x * n + y)
    return Lists(x[order], y[order], 0, n), e[order]


def _going(near: Lists, edge: np.ndarray, state: np.ndarray, a: np.ndarray, b: np.ndarray, gone: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The triangles of the edges ``gone`` among those with a state (1: left, 2: goes now, 0: gone), each once: its two other
    edges, and for each of them the vertex that it does not have."""
    x, y = np.searchsorted(near.tails, a[gone]), np.searchsorted(near.tails, b[gone])
    less = near.size[x] <= near.size[y]
    short, long = np.where(less, x, y), np.where(less, y, x)
    n = near.size[short]
    upto, at = np.cumsum(n), 0
    while at < len(gone):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        c = n[at:end]
        which = np.repeat(np.arange(at, end), c)
        place = np.repeat(near.begin[short[at:end]], c) + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        alive = np.flatnonzero(state[edge[place]])
        which, place = which[alive], place[alive]
        hit, other = near.find(long[which], near.v[place])
        e, f, g = gone[which[hit]], edge[place[hit]], edge[other]
        # a triangle that goes by several edges counts for the first of them
        one = ((state[f] == 1) | (state[f] == 2) & (e < f)) & ((state[g] == 1) | (state[g] == 2) & (e < g))
        row = which[hit][one]
        yield f[one], g[one], near.tails[long[row]], near.tails[short[row]]
        at = end


def _peel_lists(u: np.ndarray, v: np.ndarray, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_peel_stored`, with the triangles of the edges that go found when they go: memory by edges only.

    With ``bits``, a vertex stands for as many twins as its lowest ``bits`` bits say, and an edge for those between the
    twins of its ends; after the edges come the values of those within each class of two or more, in the order of names.
    """
    m = len(u)
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends.astype(np.int64), 2)
    twins = names & ((1 << bits) - 1) if bits else np.ones(len(names), np.int64)
    within = np.flatnonzero(twins > 1)
    loop = np.full(len(names), -1)
    loop[within] = m + np.arange(len(within))
    plain, total = not len(within), m + len(within)

    def counted(which: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Triangles of each edge, one for each twin of its third vertex."""
        return np.bincount(which, None if plain else twins[third], total).astype(np.int64, copy=False)

    def inner(some: np.ndarray) -> np.ndarray:
        """Triangles of classes of twins with edges to others, by those edges."""
        each = ((a, b), (b, a))
        return sum(np.bincount(loop[x[some]][has], twins[y[some]][has], total).astype(np.int64) for x, y in each for has in [loop[x[some]] >= 0])

    p = lists((u, v))[0]
    sup = np.zeros(total, np.int64)
    for e, f, g in closed(p, p):
        sup += counted(e, b[f]) + counted(f, b[e]) + counted(g, a[e])
    del p
    if not plain:
        sup += inner(np.arange(m))
        sup[:m] += twins[a] + twins[b] - 2
        sup[m:] += twins[within] - 2
    state = np.ones(m, np.int8)  # 1: left, 2: goes now, 0: gone

    near, edge = _full_lists(a, b, np.flatnonzero(state), len(names))
    kept = left = m

    def remove(gone: np.ndarray) -> None:
        nonlocal near, edge, kept, left
        loops, gone = within[gone[gone >= m] - m], gone[gone < m]
        state[gone] = 2
        if len(loops):
            single = np.zeros(len(names), bool)
            single[loops] = True
            some = np.flatnonzero(state == 1)
            sup[some] -= single[a[some]] * (twins[a[some]] - 1) + single[b[some]] * (twins[b[some]] - 1)
        if not len(gone):
            return
        if not plain:
            sup[:] -= inner(gone)
        for f, g, long, short in _going(near, edge, state, a, b, gone):
            sup[:] -= counted(f, long) + counted(g, short)
        state[gone] = 0
        left -= len(gone)
        if left and left < kept // 2:
            near, edge = _full_lists(a, b, np.flatnonzero(state), len(names))
            kept = left

    return _schedule(total, sup, remove)


def _peel_work(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    sides = _stored(u, v)
    k, batch = _peel_lists(u, v) if sides is None else _peel_stored(len(u), sides)
    return {"k": k, "batch": batch}


def _hindex_work(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    sides = _stored(u, v)
    if sides is None:
        return {"k": _peel_lists(u, v)[0]}
    return {"k": _hindex_stored(len(u), sides)}


def _multi_k_work(chunk: int):
    def work(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        m, base, width = len(u), 0, chunk
        sides = _stored(u, v)
        if sides is None:
            return {"k": _peel_lists(u, v)[0]}
        value, live = np.zeros(m, np.int64), np.ones(m, bool)
        while live.any():
            value[live] = base + width
            own = Incident(m, sides)
            for j in range(base, base + width):  # each run begins with what the chunk began with
                sup, alive, there = own.size.copy(), live.copy(), np.ones(len(sides), bool)
                gone = np.flatnonzero(alive & (sup <= j))
                while len(gone):
                    alive[gone] = False
                    lost = own.take(gone, there, sup)
                    gone = lost[alive[lost] & (sup[lost] <= j)]
                value[live & ~alive & (value > j)] = j
            live = live & (value == base + width)
            sides = sides[live[sides].all(1)]
            base, width = base + width, width * 2
        return {"k": value}

    return work


def _wedge_work(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Each round finds the triangles of what is left anew, or, where that takes fewer look-ups, those of what has gone since."""
    m, k = len(u), 0
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends.astype(np.int64), 2)
    value, sup, state = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int8)  # state: of the edges counted last
    left, near, cost = np.ones(m, bool), None, 0
    while left.any():
        deg = np.bincount(a[left], minlength=len(names)) + np.bincount(b[left], minlength=len(names))
        high = left & (np.minimum(deg[a], deg[b]) - 1 > k)
        lost = np.flatnonzero((state > 0) & ~high)
        less = near is not None
        if less and len(lost):
            ends = np.searchsorted(near[0].tails, a[lost]), np.searchsorted(near[0].tails, b[lost])
            less = int(np.minimum(*(near[0].size[x] for x in ends)).sum()) < cost
        if less:
            state[lost] = 2
            for f, g, _, _ in _going(*near, state, a, b, lost):
                sup -= np.bincount(f, minlength=m) + np.bincount(g, minlength=m)
            state[lost] = 0
        elif high.any():
            state[:] = high
            some = np.flatnonzero(high)
            p, cost = lists((u[some], v[some]))[0], 0
            sup[:] = 0
            for sides in closed(p, p):
                for s in sides:
                    sup += np.bincount(some[s], minlength=m)
            ahead = np.bincount(a[some], minlength=len(names))
            cost = int(np.minimum(ahead[a[some]], ahead[b[some]]).sum())
            del p
            near = _full_lists(a, b, some, len(names))
        else:
            near, state[:] = None, 0
        if near is not None and np.count_nonzero(state) < len(near[1]) // 4:
            near = _full_lists(a, b, np.flatnonzero(state), len(names)) if state.any() else None
        now = np.where(high, sup, -1)
        k = max(k, int(now[left].min()))
        gone = left & (now <= k)
        value[gone] = k
        left &= ~gone
    return {"k": value}


def _each_way(edges: DataFrame | Packed, one_task: int, work, names: list[str], rounds) -> DataFrame:
    """u, v and ``names`` of all edges: small components by ``work`` in a task, ``rounds(edges)`` for the others."""
    own = packed(edges)
    if own.sets is not None and one_task:
        return own.sets.work(lambda u, v: [{"u": u, "v": v, **work(u, v)}], ", ".join(f"{c} long" for c in ["u", "v", *names]))
    rows, others = own.apart(min(one_task, MOST_EDGES))
    done = None if rows is None else on_components(rows, work, names, own.tasks)
    if others is None:
        return done
    more = rounds(others).select("u", "v", *names)
    return more if done is None else done.unionByName(more)


def _peeled(edges: DataFrame | Packed, one_task: int) -> DataFrame:
    """u, v, k, batch."""
    return _each_way(edges, one_task, _peel_work, ["k", "batch"], lambda e: _peel_rounds(e, min(one_task, MOST_LEFT)))


def _history(found: DataFrame) -> list[tuple[int, int, int, int]]:
    sizes = sorted(tuple(r) for r in found.groupBy("k", "batch").agg(F.count("*")).collect())
    alive, history = sum(n for _, _, n in sizes), []
    for at, (k, _, n) in enumerate(sizes):
        history.append((at, k, alive, n))
        alive -= n
    return history


def peel(edges: DataFrame | Packed, one_task: int = ONE_TASK) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Truss values and the history: (round, k, alive, peeled) of each batch that removed something.

    The n-th batch at some k of the whole graph is that of all its components together.
    """
    found = cut(_peeled(edges, one_task), "peel-values")
    return found.select("u", "v", "k"), _history(found)


def peel_history(edges: DataFrame | Packed, one_task: int = ONE_TASK) -> list[tuple[int, int, int, int]]:
    """The history alone: the values are counted where they are found and never written."""
    return _history(_peeled(edges, one_task))


def hindex(edges: DataFrame | Packed, one_task: int = ONE_TASK) -> DataFrame:
    return _each_way(edges, one_task, _hindex_work, ["k"], lambda e: _hindex_rounds(e, min(one_task, MOST_LEFT)))


def wedge(edges: DataFrame | Packed, one_task: int = ONE_TASK) -> DataFrame:
    """u, v, k, with triangles found anew each round. An edge with a vertex of degree d is
    in at most d - 1 triangles, so edges that must go by their degrees go before that."""
    return _each_way(edges, one_task, _wedge_work, ["k"], _wedge_rounds)


def multi_k(edges: DataFrame | Packed, chunk: int = 8, max_run_rows: int = 200_000_000, one_task: int = ONE_TASK) -> DataFrame:
    """Thresholds ``base .. base + width - 1`` are peeled apart from each other; an edge gone in
    run j and alive in run j - 1 has value j. The width doubles after each chunk; by rounds,
    while width times the larger of triangles and edges stays under ``max_run_rows``."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    return _each_way(edges, one_task, _multi_k_work(chunk), ["k"], lambda e: _multi_k_rounds(e, chunk, max_run_rows))


def _peel_rounds(edges: DataFrame, one_task: int) -> DataFrame:
    """u, v, k, batch. Each round appends the edges that go to one folder and replaces the triangles
    by those that are left."""
    ids, triples = start(edges)
    all_triples, live, before = triples, ids.select("eid"), None
    n, k, at = ids.count(), 0, 0
    path = new_path(ids.sparkSession, "peel-gone")
    if not n:
        return ids.select("u", "v", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("batch"))
    while n:
        if triples.count() <= one_task:
            done = cut(_in_one_task(triples, _peel_task(k, at, n), "k long, round long"), "peel-rest")
            bare = live.join(done.select("eid"), "eid", "left_anti").select("eid", F.lit(k).cast("long").alias("k"), F.lit(at).cast("long").alias("round"))
            append(done.unionByName(bare), path)
            drop(done)
            break
        now = cut(live.join(_counts(triples), "eid", "left").select("eid", F.coalesce("sup", F.lit(0)).cast("long").alias("sup")), "peel-round")
        by = now.groupBy("sup").count().agg(F.min("sup").alias("least"), F.min_by("count", "sup").alias("of_least"), F.sum(F.when(F.col("sup") <= k, F.col("count"))).alias("under")).first()
        k = max(k, by["least"])
        append(now.filter(F.col("sup") <= k).select("eid", F.lit(k).cast("long").alias("k"), F.lit(at).cast("long").alias("round")), path)
        n, at = n - (by["under"] or by["of_least"]), at + 1
        live = now.filter(F.col("sup") > k).select("eid")
        if before is not None:
            drop(before)
        before = now
        left = cut(_alive(triples, live), "peel-triangles") if n else triples
        if n and triples is not all_triples:
            drop(triples)
        triples = left
    gone = ids.sparkSession.read.schema("eid long, k long, round long").parquet(path)
    first = gone.groupBy("k").agg(F.min("round").alias("first"))
    return ids.join(gone, "eid").join(F.broadcast(first), "k").select("u", "v", "k", (F.col("round") - F.col("first")).alias("batch"))


def _hindex_stored(m: int, sides: np.ndarray) -> np.ndarray:
    """Only edges with a triangle that changed are looked at anew, and only those sorted that have lost their value."""
    own = Incident(m, sides)
    value = own.size.copy()
    some = np.flatnonzero(value)
    while len(some):
        seen = np.zeros(m, bool)
        for part in own.parts(some):
            seen[_lowered(own, value, part)] = True
        some = np.flatnonzero(seen)
    return value


def _lowered(own: Incident, value: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Takes the h-index of the edges ``some`` into ``value``; the edges of triangles of those that have lost their value."""
    t, n = own.of(some), own.size[some]
    low, row = value[own.sides[t]].min(1), np.repeat(np.arange(len(some)), n)
    less = np.bincount(row[low >= value[some][row]], minlength=len(some)) < value[some]
    if not less.any():
        return np.empty(0, np.int64)
    mine = less[row]
    t, low, n, some = t[mine], low[mine], n[less], some[less]
    most = int(low.max())
    key = np.repeat(np.arange(len(some)), n) * (most + 1) + (most - low)
    key.sort()
    value[some] = np.maximum.reduceat(np.minimum(most - key % (most + 1), _within(n) + 1), np.cumsum(n) - n)
    return own.sides[t].ravel()


def _hindex_task(sides: np.ndarray) -> tuple[np.ndarray]:
    return (_hindex_stored(int(sides.max()) + 1, sides),)


def _hindex_rounds(edges: DataFrame, one_task: int) -> DataFrame:
    ids, triples = start(edges)
    if triples.count() <= one_task:
        value = cut(_in_one_task(triples, _hindex_task, "k long"), "hindex-values")
        return ids.join(value, "eid", "left").select("u", "v", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    value = cut(_counts(triples).select("eid", F.col("sup").alias("k")), "hindex-values")
    while True:
        met = triples
        for i in (1, 2, 3):
            met = met.join(value.select(F.col("eid").alias(f"e{i}"), F.col("k").alias(f"k{i}")), f"e{i}")
        low = F.least("k1", "k2", "k3").alias("m")
        sides = met.select(F.inline(F.array(*(F.struct(F.col(f"e{i}").alias("eid"), F.col(f"k{i}").alias("old"), low) for i in (1, 2, 3)))))
        counts = sides.groupBy("eid", "old", "m").agg(F.count("*").alias("n"))
        above = W.partitionBy("eid").orderBy(F.desc("m")).rowsBetween(W.unboundedPreceding, 0)
        heights = counts.withColumn("h", F.least("m", F.sum("n").over(above)))
        new = cut(heights.groupBy("eid").agg(F.max("old").alias("old"), F.max("h").cast("long").alias("k")), "hindex-values")
        changed = new.filter("old <> k").count()
        drop(value)
        value = new.select("eid", "k")
        if not changed:
            break
    return ids.join(value, "eid", "left").select("u", "v", F.coalesce("k", F.lit(0)).cast("long").alias("k"))


def _wedge_rounds(edges: DataFrame) -> DataFrame:
    live = cut(edges.select("u", "v"), "wedge-live")
    path = new_path(edges.sparkSession, "wedge-gone")
    n, k = live.count(), 0
    if not n:
        return live.withColumn("k", F.lit(0).cast("long"))
    while n:
        deg = degrees(live)
        most = F.least("du", "dv") - 1
        marked = live.join(deg.select(F.col("v").alias("u"), F.col("deg").alias("du")), "u").join(deg.select("v", F.col("deg").alias("dv")), "v")
        marked = cut(marked.select("u", "v", (most <= k).alias("low")), "wedge-marked")
        sup = support(marked.filter("NOT low").select("u", "v"))
        now = cut(marked.join(sup, ["u", "v"], "left").select("u", "v", F.coalesce("sup", F.lit(-1)).cast("long").alias("sup")), "wedge-round")
        by = now.groupBy("sup").count().agg(F.min("sup").alias("least"), F.min_by("count", "sup").alias("of_least"), F.sum(F.when(F.col("sup") <= k, F.col("count"))).alias("under")).first()
        k = max(k, by["least"])
        append(now.filter(F.col("sup") <= k).select("u", "v", F.lit(k).cast("long").alias("k")), path)
        n -= by["under"] or by["of_least"]
        left = cut(now.filter(F.col("sup") > k).select("u", "v"), "wedge-live")
        drop(live, marked, now)
        live = left
    return edges.sparkSession.read.schema("u long, v long, k long").parquet(path)


def _multi_k_rounds(edges: DataFrame, chunk: int, max_run_rows: int) -> DataFrame:
    ids = cut(edge_ids(edges), "multi-edges")
    live = ids.select("eid")
    triples = cut(edge_triples(ids), "multi-triangles")
    base, width = 0, chunk
    values: list[DataFrame] = []
    while not live.isEmpty():
        n = triples.count()
        width = max(1, min(width, max_run_rows // max(1, n, live.count())))
        runs = F.explode(F.sequence(F.lit(base).cast("long"), F.lit(base + width - 1).cast("long"))).alias("j")
        alive = cut(live.select("eid", runs), "multi-alive")
        rows = cut(triples.select("e1", "e2", "e3", runs), "multi-rows")
        while True:
            sup = rows.select("j", F.explode(F.array("e1", "e2", "e3")).alias("eid")).groupBy("j", "eid").agg(F.count("*").alias("sup"))
            kept = cut(alive.join(sup, ["j", "eid"]).filter(F.col("sup") > F.col("j")).select("eid", "j"), "multi-alive")
            same = kept.count() == alive.count()
            drop(alive)
            alive = kept
            if same:
                break
            less = cut(_alive(rows, alive, ["j"]), "multi-rows")
            drop(rows)
            rows = less
        lived = alive.groupBy("eid").agg((F.max("j") + 1).alias("k"))
        reached = cut(live.join(lived, "eid", "left").select("eid", F.coalesce("k", F.lit(base)).cast("long").alias("k")), "multi-values")
        values.append(reached.filter(F.col("k") < base + width))
        live = reached.filter(F.col("k") == base + width).select("eid")
        triples = cut(_alive(triples, live), "multi-triangles")
        base, width = base + width, width * 2
    out = ids.select("eid", F.lit(0).cast("long").alias("k")).limit(0)
    for part in values:
        out = out.unionByName(part)
    return ids.join(out, "eid").select("u", "v", "k")


def multi_k_alive(edges: DataFrame | Packed, runs: int = 8) -> DataFrame:
    """j, alive: edges that outlive threshold j, for j from 0 to ``runs`` - 1."""
    k = truss(edges)
    counts = k.filter("k > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("k"), F.lit(runs).cast("long")) - 1)).alias("j"))
    counts = counts.groupBy("j").agg(F.count("*").alias("alive"))
    every = edges.sparkSession.range(runs).select(F.col("id").alias("j"))
    return every.join(counts, "j", "left").select("j", F.coalesce("alive", F.lit(0)).cast("long").alias("alive"))


def ktruss_subgraph(edges: DataFrame | Packed, k: int, method: str = "hindex") -> DataFrame:
    return truss(edges, method).filter(F.col("k") >= k).select("u", "v")


def prune_low_degree(edges: DataFrame, k: int) -> DataFrame:
    """The edges left when edges at a vertex of degree <= k go until none is left to go: the (k+1)-core."""
    live = cut(edges.select("u", "v"), "prune")
    n = live.count()
    while n:
        high = degrees(live).filter(F.col("deg") > k).select("v")
        left = live.join(high, "v", "left_semi").join(high.select(F.col("v").alias("u")), "u", "left_semi")
        left = cut(left.select("u", "v"), "prune")
        m = left.count()
        drop(live)
        live = left
        if m == n:
            break
        n = m
    return live


def round_counts(history: list[tuple[int, int, int, int]]) -> tuple[int, int]:
    """Rounds of a peel that tries every k from 0, and of one that starts at k = 1
    and ends each k with an idle round."""
    k_max = max((k for _, k, _, _ in history), default=0)
    later = sum(1 for _, k, _, _ in history if k > 0)
    return len(history) + k_max, later + k_max if k_max else 0

