"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its words (:mod:`edgeloom.llm.bytewords`). A k-mer is k words in a row
together with how many times it occurred before in the text. A sketch samples,
for one of ``SKETCHES`` random orders, the smallest k-mer of ``K`` words and the
smallest ``PICK`` of one word, and keeps them in the order of the text: the long
k-mer makes a match rare between texts that have little in common, the short ones
survive scattered edits. Texts with an equal sketch are candidates. Texts of less
than ``FEW_WORDS`` words also have ``FEW_SKETCHES`` sketches of a k-mer of
``FEW_K`` words and one of one word, and up to about 20 words (:func:`short_limit`)
all sub-sequences of as many words as two texts in reach must have in common: two
such texts that are near always meet.

Equal texts form one class first. In each bucket of equal sketches every text is
then held against the bucket's pivot, the text that meets most others in all of its
buckets, which for edited copies is what they are copies of. After that all pairs
that still lie in different components of a bucket are tried: the classes hold
every near pair that shares a sketch, though not every pair is aligned. Pairs that can't be near by
their numbers of words, by their words' counts modulo ``2 * TURN`` in ``KINDS``
kinds (:func:`turned`), or by two bits of each of the one-word minima
(:func:`most_differ`; a near pair has more that differ in 1 of 500,000 cases) are left
out before alignment, inside the join, and a pair that shares several such buckets comes
out of the first of them only, so the join gives few rows even in a
bucket of a very common passage or line. A pair is accepted if the edit distance of the
word sequences is at most ``1 - similarity`` of the longer one, found by
bit-parallel alignment within the band that this distance allows. Components of
accepted pairs are the classes.

Texts are known by a number of their own and joined by it or by their hash and id, never by
the id alone. Joins on a hot value (equal texts, a crowded bucket, a large component) are between
written tables, so adaptive execution splits them.

Recall by similarity and length is in the README.

Defined results: null texts are empty; texts without words are near only to
equal texts; repeated rows are in one class, of which one row is kept; an id that stands for
several texts has a row for each; a class's id is its smallest
document id that is not null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import Words, filled, mix, slices
from edgeloom.llm.common import cut, release, remove, rows_at_once
from edgeloom.llm.components import components

K = 5
PICK = 2
SKETCHES = 64
SIMILARITY = 0.8
FEW_K = 3
FEW_SKETCHES = 32
FEW_WORDS = 75
MOST_KEYS = 2000  # of a short text
KINDS = 1024
TURN = 4
PARITIES = KINDS * TURN // 64  # numbers of 64 bits of a signature for the counts
AT_ONCE = 1000  # rows of texts that go to Python at once, in pairs or alone
MOST_BUCKETS = 96  # of a text whose pairs come out of one bucket only
#: For counts 0, 1, ... modulo ``2 * TURN``: bits that differ in as many places as the counts are apart on this circle.
_CODE = np.array([[(c - 1 - j) % (2 * TURN) < TURN for j in range(TURN)] for c in range(2 * TURN)], dtype=np.uint8)
_BASE = np.uint64(0xD6E8FEB86659FD93)


class Orders:
    """Random orders of 32-bit values: the smallest of ``(x ^ shift) * factor``."""

    def __init__(self, n: int, seed: int) -> None:
        x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self.shift, self.factor = x[:n].astype(np.uint32), x[n:].astype(np.uint32) | np.uint32(1)
        self.back = np.array([pow(int(f), -1, 1 << 32) for f in self.factor], dtype=np.uint32)

    def smallest(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each run of ``x`` the value that comes first in each order."""
        out = np.empty((len(self.shift), len(starts)), dtype=np.uint32)
        if not len(starts):
            return out.T
        for i, (s, f) in enumerate(zip(self.shift, self.factor, strict=True)):
            out[i] = np.minimum.reduceat((x ^ s) * f, starts)
        return ((out * self.back[:, None]) ^ self.shift[:, None]).T


_LONG, _FEW, _ONE = Orders(SKETCHES, 1), Orders(FEW_SKETCHES, 2), Orders(SKETCHES * PICK, 3)


def labelled(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes with their occurrence numbers within the owner mixed in."""
    if not len(x):
        return x
    whole = mix(x + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64((1 << max(1, (len(x) - 1).bit_length())) - 1)
    place = (np.sort((whole & ~low) | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    first = np.ones(len(x), bool)
    first[1:] = whole[place[1:]] != whole[place[:-1]]
    at = np.arange(len(x))
    label = np.empty(len(x), np.uint64)
    label[place] = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix(x + label * np.uint64(0xA0761D6478BD642F))


def kmers(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled hashes of all k-mers that lie within one owner, and the places of their first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _BASE + words[j : n + j]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return labelled(mix(out[at]), owner[at]), at


class Minima:
    """The smallest k-mers of each text for some orders, and where they stand."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, k: int, orders: Orders) -> None:
        x, at = kmers(words, owner, k)
        own = owner[at]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
        self.texts = own[starts]  # those with such a k-mer
        high = (x >> np.uint64(32)).astype(np.uint32)
        self.value = orders.smallest(high, starts)
        table = own.astype(np.uint64) << np.uint64(32) | high
        order = np.argsort(table)
        found = np.searchsorted(table[order], self.texts.astype(np.uint64)[:, None] << np.uint64(32) | self.value)
        self.place = at[order[found]] if len(at) else found

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.searchsorted(self.texts, texts)
        return self.value[rows].astype(np.uint64), self.place[rows]


def sketches(long: Minima, one: Minima, pick: int, n: int) -> np.ndarray:
    """``n`` values for each of ``long.texts``."""
    value, place = long.value.astype(np.uint64), long.place
    ones, places = one.of(long.texts)
    out = np.arange(n, dtype=np.uint64) * _BASE + value
    chosen = [place]
    for p in range(pick):
        out = out * _BASE + ones[:, p * n : (p + 1) * n]
        chosen.append(places[:, p * n : (p + 1) * n])
    for a, b in combinations(range(pick + 1), 2):  # the order of the text
        out = out * np.uint64(2) + (chosen[a] <= chosen[b])
    return mix(out)


def _in_common(n: int, limit: int, similarity: float) -> list[int]:
    """For texts of ``n`` to ``limit`` words: how many words one must share, in order, with a text of ``n`` that is near."""
    longer = range(n, min(limit, int(n / similarity + 1e-9)) + 1)
    return sorted({m - int((1 - similarity) * m + 1e-9) for m in longer})


@cache
def short_limit(similarity: float) -> int:
    """Most words of a text whose sub-sequences are keys: up to there none has more than ``MOST_KEYS``."""
    n = 0
    while n < 64 and sum(math.comb(n + 1, t) for t in _in_common(n + 1, n + 1 + n, similarity)) <= MOST_KEYS:
        n += 1
    return n


@cache
def _choices(n: int, t: int) -> np.ndarray:
    return np.array(list(combinations(range(n), t)), dtype=np.int64).reshape(-1, t)


def short_keys(words: np.ndarray, similarity: float) -> np.ndarray:
    """Hashes of the sub-sequences that a near text of no more than ``short_limit`` words shares one of."""
    made = []
    for t in _in_common(len(words), short_limit(similarity), similarity):
        chosen = words[_choices(len(words), t)]
        out = np.full(len(chosen), t, dtype=np.uint64)
        for j in range(t):
            out = out * _BASE + chosen[:, j]
        made.append(mix(out))
    return np.unique(np.concatenate(made))


class Sketched:
    """Of some texts: number of words, keys (the values by which they meet) and signature."""

    def __init__(self, words: np.ndarray, first: np.ndarray, similarity: float = SIMILARITY) -> None:
        self.n_words = np.diff(first)
        n = len(self.n_words)
        owner = np.repeat(np.arange(n), self.n_words)
        one = Minima(words, owner, 1, _ONE)
        long = Minima(words, owner, K, _LONG)
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64)] * n
        for t, row in zip(long.texts.tolist(), sketches(long, one, PICK, SKETCHES), strict=True):
            self.keys[t] = row
        few = np.flatnonzero(self.n_words < FEW_WORDS)
        if len(few):
            chosen = np.flatnonzero(self.n_words[owner] < FEW_WORDS)
            small = Minima(words[chosen], owner[chosen], FEW_K, _FEW)
            small.place = chosen[small.place] if len(chosen) else small.place
            for t, row in zip(small.texts.tolist(), sketches(small, one, 1, FEW_SKETCHES), strict=True):
                self.keys[t] = np.concatenate([self.keys[t], row])
        for t in few.tolist():
            if 0 < self.n_words[t] <= short_limit(similarity):
                self.keys[t] = np.concatenate([self.keys[t], short_keys(words[first[t] : first[t + 1]], similarity)])
        counts = turned(words, owner, n)
        bits = (mix(one.value.astype(np.uint64)) & np.uint64(3)).astype(np.uint8)
        planes = np.zeros((n, 2 * one.value.shape[1]), np.uint8)
        planes[one.texts] = np.hstack([bits & 1, bits >> 1])
        whole = np.hstack([counts, planes])
        #: Counts, then the lower and the upper bits of the one-word minima, 64 to a number.
        self.signature = np.packbits(whole, axis=1).reshape(n, -1, 8).view("<i8").reshape(n, -1) if n else np.empty((0, PARITIES + 4), np.int64)


def turned(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts the bits of its counts of words of each kind: two texts differ in at most
    as many bits as there are words without a partner, that is twice their distance less the difference of their lengths."""
    counts = np.bincount(owner * KINDS + (words & np.uint64(KINDS - 1)).astype(np.int64), minlength=n * KINDS)
    return _CODE[counts % (2 * TURN)].reshape(n, KINDS * TURN)


def traits() -> list[Column]:
    """n_words and the numbers of the signature as columns s0, s1, ..."""
    return [F.col("n_words"), *(F.col("signature")[i].alias(f"s{i}") for i in range(PARITIES + 4))]


def may_be_near(a: str, b: str, similarity: float) -> Column:
    """Whether two texts (structs with their traits) pass the tests before alignment."""
    n, m = F.col(f"{a}.n_words"), F.col(f"{b}.n_words")
    apart = [F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")) for i in range(PARITIES + 4)]
    most = F.floor((1 - similarity) * F.greatest(n, m) + 1e-9)
    alone = sum((F.bit_count(x) for x in apart[:PARITIES]), F.lit(0))
    low, high = apart[PARITIES : PARITIES + 2], apart[PARITIES + 2 :]
    differ = sum((F.bit_count(x.bitwiseOR(y)) for x, y in zip(low, high, strict=True)), F.lit(0))
    share = similarity / (2 - similarity)  # of two near texts' labelled words at least these are in both
    return (F.abs(n - m) <= most) & (differ <= most_differ(share)) & (alone <= 2 * most - F.abs(n - m))


def most_differ(share: float) -> int:
    """Minima of which two bits differ in a pair with this share of its words in common, in all but 1 of 500,000 cases."""
    n, p = SKETCHES * PICK, 0.75 * (1 - share)
    rest, k = 1.0, -1
    while rest > 2e-6 and k < n:
        k += 1
        rest -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def banded_distance(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance if it is at most ``most``, else None.

    The band holds the cells at most ``most`` off the diagonal, one bit for
    each vertical difference; it moves down one cell with each word of ``b``.
    Cells outside count as one worse than their neighbours in the band, so no
    value is too small and any within ``most`` is exact.
    """
    tail = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    lead = 0
    for x, y in zip(a, b):
        if x != y:
            break
        lead += 1
    a, b = a[lead:], b[lead:]
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return len(a) + len(b)
    m = len(a)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    low = 0  # rows up to here are above the band
    top = 0  # value of the cell just above the band
    high = min(m, most + 1)
    plus, minus = (1 << high) - 1, 0
    for j, y in enumerate(b, 1):
        if j - most - 1 > low:  # the band moves down
            top += (plus & 1) - (minus & 1)
            plus >>= 1
            minus >>= 1
            low += 1
        top += 1
        reach = min(m, j + most)
        if reach > high:
            plus |= 1 << (reach - 1 - low)
            high = reach
        full = (1 << (high - low)) - 1
        match = (places.get(y, 0) >> low) & full
        x = match | minus
        diagonal = (((x & plus) + plus) ^ plus) | x
        across_plus = minus | (full & ~(diagonal | plus))
        across_minus = plus & diagonal
        across_plus = (across_plus << 1) | 1
        across_minus <<= 1
        plus = (across_minus | ~(diagonal | across_plus)) & full
        minus = across_plus & diagonal & full
    distance = top + plus.bit_count() - minus.bit_count()
    return distance if distance <= most else None


def _sketch_rows(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(3))
            for at, end in slices(texts):
                w = Words(texts, at, end)
                s = Sketched(w.hash, w.first, similarity)
                kept = [x[at:end] if len(x) != end - at else x for x in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(s.n_words, pa.int32()), _lists(list(s.signature)), _lists(s.keys)], ["id", "h1", "h2", "n_words", "signature", "keys"])
        release()

    return run


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = filled(batch.column(1))
        out: list[bytes] = []
        for at, end in slices(texts):
            w = Words(texts, at, end)
            low = w.hash.astype("<u4")
            out += [low[w.first[k] : w.first[k + 1]].tobytes() for k in range(end - at)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["t", "words"])
    release()


def _aligned(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
                keep.append(_bag_distance(a, b) <= most and banded_distance(a.tolist(), b.tolist(), most) is not None)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longer text that find no partner wherever it stands: at most the edit distance."""
    both = np.sort(np.concatenate([a.astype(np.uint64) << np.uint64(1), b.astype(np.uint64) << np.uint64(1) | np.uint64(1)]))
    word = both >> np.uint64(1)
    edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
    ours = np.add.reduceat((both & np.uint64(1)).astype(np.int64), edge) if len(edge) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[edge, len(word)])
    return max(len(a), len(b)) - int(np.minimum(ours, sizes - ours).sum())


class _Found:
    """Written tables: ``rows`` (r, t, id, h1, h2, rep_id) of every row, t the number of its text;
    ``named`` (t, class_id, class_t) of the texts that are near others; ``links`` (a, b) of the aligned pairs."""

    def __init__(self, docs: DataFrame, similarity: float, text: str, key: str) -> None:
        base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        base = base.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
        kind = base.schema["id"].dataType.simpleString()
        made = base.mapInArrow(_sketch_rows(similarity), f"id {kind}, h1 long, h2 long, n_words int, signature array<long>, keys array<long>")
        with rows_at_once(docs.sparkSession, AT_ONCE):
            made = cut(made.withColumn("r", F.monotonically_increasing_id()), "sketches")

        # equal texts: one representative, the row of the smallest id
        smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("m")
        equal = cut(made.groupBy("h1", "h2").agg(smallest).select("h1", "h2", F.col("m.r").alias("t"), F.col("m.id").alias("rep_id")), "equal-texts")
        self.rows = cut(made.select("r", "id", "h1", "h2").join(equal, ["h1", "h2"]), "members")
        texts = cut(made.filter("n_words > 0").withColumnRenamed("r", "t").join(equal.select("t").hint("merge"), "t", "left_semi"), "texts")
        remove(made)
        met = self._meeting(texts)

        # each against the pivots of its buckets; then all that lie in different components of one
        found = self._align(self._pivot_pairs(met, texts, similarity), base, texts, similarity)
        labels = components(found)
        rest = self._align(self._between(met, texts, labels, similarity), base, texts, similarity)
        self.links = found.unionByName(rest)
        if not rest.isEmpty():
            labels = components(self.links)
        remove(met)
        remove(texts)
        known = labels.select(F.col("node").alias("t"), "label").join(equal.select("t", "rep_id"), "t")
        first = known.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "t")).alias("m"))
        self.named = cut(known.select("t", "label").join(cut(first, "classes"), "label").select("t", F.col("m.rep_id").alias("class_id"), F.col("m.t").alias("class_t")), "class-names")
        remove(equal)

    @staticmethod
    def _meeting(texts: DataFrame) -> DataFrame:
        """bucket, t, n (texts in the bucket) where more than one text meets."""
        rows = texts.select("t", F.explode("keys").alias("bucket"))
        sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
        met = cut(rows.join(sizes.hint("merge"), "bucket"), "buckets")
        remove(sizes)
        return met

    @staticmethod
    def _pivot_pairs(met: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
        """a, b: each text and the pivots of its buckets, if they may be near."""
        meets = cut(met.groupBy("t").agg(F.sum("n").alias("meets")), "meetings")
        ranked = met.select("bucket", "t").join(meets.hint("merge"), "t")
        pivots = cut(ranked.groupBy("bucket").agg(F.max(F.struct("meets", "t")).alias("p")).select("bucket", F.col("p.t").alias("b")), "pivots")
        pairs = met.select("bucket", F.col("t").alias("a")).join(pivots.hint("merge"), "bucket").filter("a <> b")
        pairs = pairs.select("a", "b").distinct()
        of = lambda c: texts.select(F.col("t").alias(c), F.struct(*traits()).alias(f"{c}_text"))
        pairs = cut(pairs.groupBy("a").agg(F.collect_list("b").alias("pivots")), "pivot-pairs")  # no more than a text has buckets
        near = pairs.join(of("a"), "a").select("a", "a_text", F.explode("pivots").alias("b")).join(of("b"), "b").filter(may_be_near("a_text", "b_text", similarity))
        near = cut(near.select("a", "b"), "candidates")
        remove(meets, pivots, pairs)
        return near

    @staticmethod
    def _between(met: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
        """a, b: pairs that share a bucket, lie in different components and may be near.

        Texts meet by bucket and by number of words on a scale where those of
        near texts are at most one step apart. Each has its smaller buckets with it, so that a pair
        comes only from the smallest it shares (from all, if a text has over ``MOST_BUCKETS``).
        """
        step = max(-math.log(similarity), 1e-3) * 1.001
        rows = cut(met.select("bucket", "t").join(labels.withColumnRenamed("node", "t"), "t", "left").select("bucket", "t", F.coalesce("label", "t").alias("label")), "labelled-buckets")
        mixed = cut(rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket"), "mixed-buckets")
        own = rows.join(mixed.hint("merge"), "bucket", "left_semi").groupBy("t", "label").agg(F.sort_array(F.collect_list("bucket")).alias("own"))
        at = own.join(texts.select("t", "n_words", "signature").hint("merge"), "t").select("*", F.posexplode("own").alias("pos", "bucket"))
        before = F.when(F.size("own") <= MOST_BUCKETS, F.slice("own", F.lit(1), F.col("pos"))).alias("before")
        x = cut(at.select("bucket", F.floor(F.log("n_words") / step).alias("size"), F.struct("t", "label", *traits(), before).alias("x")), "mixed")
        y = x.select("bucket", F.inline(F.array(F.struct("size", F.lit(False).alias("longer")), F.struct((F.col("size") - 1).alias("size"), F.lit(True).alias("longer")))), F.col("x").alias("y"))
        apart = (F.col("x.label") != F.col("y.label")) & (F.col("longer") | (F.col("x.t") < F.col("y.t")))
        first = F.coalesce(~F.arrays_overlap("x.before", "y.before"), F.lit(True))
        pairs = x.join(y.hint("merge"), ["bucket", "size"]).filter(apart & may_be_near("x", "y", similarity) & first)
        pairs = cut(pairs.select(F.least("x.t", "y.t").alias("a"), F.greatest("x.t", "y.t").alias("b")).distinct(), "between")
        remove(rows, mixed, x)
        return pairs

    @staticmethod
    def _align(pairs: DataFrame, base: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
        """The pairs that are near, written; ``pairs`` goes. The words of ``b``, which many pairs may have in common, are joined last."""
        needed = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct().join(texts.select("t", "id", "h1", "h2"), "t")
        needed = needed.withColumnsRenamed({"id": "rep", "h1": "g1", "h2": "g2"}).hint("merge")
        whole = base.join(needed, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("rep")))
        with rows_at_once(base.sparkSession, AT_ONCE):
            words = cut(whole.select("t", "text").mapInArrow(_word_rows, "t long, words binary").dropDuplicates(["t"]), "words")
        both = (
            pairs.join(words.select(F.col("t").alias("a"), F.col("words").alias("x")).hint("merge"), "a")
            .join(words.select(F.col("t").alias("b"), F.col("words").alias("y")).hint("merge"), "b")
            .select("a", "b", "x", "y")
        )
        with rows_at_once(base.sparkSession, AT_ONCE):
            found = cut(both.mapInArrow(_aligned(similarity), "a long, b long"), "links")
        remove(words, pairs)
        return found

    def classes(self) -> DataFrame:
        """id, h1, h2, class_id, keep, rep_id of every row."""
        out = self.rows.join(self.named, "t", "left")
        return out.select(
            "id", "h1", "h2", F.when(F.col("class_t").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"), (F.col("r") == F.coalesce("class_t", "t")).alias("keep"), "rep_id"
        )


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, class_id, keep (true for one row of each class), equal_id (the smallest id with an equal text) of every row."""
    found = _Found(docs, similarity, text, key).classes()
    return found.select(F.col("id").alias(key), "class_id", "keep", F.col("rep_id").alias("equal_id"))


def near_duplicate_links(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """a, b: smallest ids of two different texts that were aligned and are near. Their components, with
    ``equal_id`` of :func:`near_duplicate_classes` for membership, are the classes."""
    found = _Found(docs, similarity, text, key)
    ids = found.rows.filter("r = t").select("t", "rep_id")
    out = found.links
    for c in ("a", "b"):
        out = out.join(ids.select(F.col("t").alias(c), F.col("rep_id").alias(f"{c}_id")), c)
    return out.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, with the columns of ``docs``; of rows equal in id and text any one."""
    mark = lambda i: F.xxhash64(F.coalesce(i.cast("string"), F.lit("null")), i.isNull())
    found = _Found(docs, similarity, text, key).classes().filter("keep")
    kept = found.select(mark(F.col("id")).alias("_edgeloom_id"), F.col("h1").alias("_edgeloom_h1"), F.col("h2").alias("_edgeloom_h2"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"_edgeloom_id": mark(F.col(key)), "_edgeloom_h1": F.xxhash64(whole), "_edgeloom_h2": F.xxhash64(F.lit(1), whole)})
    names = ["_edgeloom_id", "_edgeloom_h1", "_edgeloom_h2"]
    return rows.join(kept.hint("merge"), names, "left_semi").dropDuplicates(names).select(docs.columns)
