"""Benchmark decontamination: windows of test items found in training texts.

Texts are lower-cased (A-Z) and cut into words as in
:mod:`edgeloom.llm.bytewords`. A window is ``size`` consecutive words of an
item; an item of fewer words, but not none, is one window of its own length.
A document word inside any occurrence of a window is hit.

The windows are sent to the tasks as hash sets of about ``block_windows``
windows (a stated bound; a larger item is split, its parts overlapping). The documents pass
each block in turn and carry their hit words along, so a benchmark of any size
gives the same result and no row is shuffled; between blocks the state is written to the
shared folder, so that the driver never holds more than two. Every hash that is found is
verified by the words themselves.

Defined results: a null or empty text has no words and is never contaminated;
repeated rows get a result each; items without words match nothing; a null item id is an empty one; repeated
items each count; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import Words, filled, slices
from edgeloom.llm.common import cut, remove

STATE = "n_words long, n_hit long, items array<string>, spans array<int>"


class WindowSet:
    """Windows of some items: by length, sorted hashes; by words, the items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        self.by_words: dict[bytes, tuple[str, ...]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            w = Words(filled(pa.array([text], pa.string())), 0, 1)
            n = len(w.start)
            length = min(size, n)
            if not n:
                continue
            hashes.setdefault(length, []).append(w.windows(length))
            words = [w.lower[a:b].tobytes() for a, b in zip(w.start, w.stop, strict=True)]
            for i in range(n - length + 1):
                key = b" ".join(words[i : i + length])
                known = self.by_words.get(key, ())
                if item not in known:
                    self.by_words[key] = (*known, item)
        self.hashes = {n: np.unique(np.concatenate(x)) for n, x in hashes.items()}
        #: A bit for each value of a hash's low 20 bits: most windows end there.
        self.sieve = {n: self._sieve(x) for n, x in self.hashes.items()}

    @staticmethod
    def _sieve(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, dtype=bool)
        out[hashes & np.uint64((1 << 20) - 1)] = True
        return out

    def hits(self, w: Words) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, words, items) of each occurrence within one text."""
        last = w.first[1:]
        owner = w.text_of_word()
        for size, hashes in self.hashes.items():
            found = w.windows(size)
            at = np.flatnonzero(self.sieve[size][found & np.uint64((1 << 20) - 1)])
            if len(at):
                at = at[at + size <= last[owner[at]]]
            if len(at):
                place = np.minimum(np.searchsorted(hashes, found[at]), len(hashes) - 1)
                at = at[hashes[place] == found[at]]
            for i in at.tolist():
                words = b" ".join(w.lower[a:b].tobytes() for a, b in zip(w.start[i : i + size], w.stop[i : i + size], strict=True))
                if items := self.by_words.get(words):
                    yield i, size, items


class Scan:
    """Hits of one text after another, over any number of blocks."""

    def __init__(self, texts: pa.Array, at: int, end: int, before: list[tuple[list[str], list[int]]] | None) -> None:
        self.words = w = Words(texts, at, end)
        self.mark = np.zeros(len(w.start) + 1, dtype=np.int64)
        self.items: dict[int, set[str]] = {}
        for k, (items, spans) in enumerate(before or ()):
            if items:
                self.items[k] = set(items)
                places = np.array(spans, dtype=np.int64) + w.first[k]
                np.add.at(self.mark, places[::2], 1)
                np.add.at(self.mark, places[1::2], -1)

    def look_for(self, windows: WindowSet) -> None:
        w = self.words
        for i, size, found in windows.hits(w):
            self.mark[i] += 1
            self.mark[i + size] -= 1
            self.items.setdefault(int(np.searchsorted(w.first, i, side="right")) - 1, set()).update(found)

    def finish(self) -> None:
        w = self.words
        self.hit = np.cumsum(self.mark[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(self.hit)])
        self.n_words = np.diff(w.first)
        self.n_hit = before[w.first[1:]] - before[w.first[:-1]]

    def spans(self, k: int) -> list[int]:
        """Runs of hit words of text ``k``: first, one past the last, first, ..."""
        w = self.words
        own = np.concatenate([[False], self.hit[w.first[k] : w.first[k + 1]], [False]])
        return np.flatnonzero(own[1:] != own[:-1]).tolist()


def _pass(windows: WindowSet, rest: int):
    """Over batches of the first ``rest`` columns (the text last) and, after
    them, the state of earlier blocks if there were any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(rest - 1))
            n_words: list[int] = []
            n_hit: list[int] = []
            items: list[list[str]] = []
            spans: list[list[int]] = []
            earlier = None
            if batch.num_columns > rest:
                earlier = list(zip(batch.column(rest + 2).to_pylist(), batch.column(rest + 3).to_pylist(), strict=True))
            for at, end in slices(texts):
                scan = Scan(texts, at, end, earlier and earlier[at:end])
                scan.look_for(windows)
                scan.finish()
                n_words += scan.n_words.tolist()
                n_hit += scan.n_hit.tolist()
                for k in range(end - at):
                    items.append(sorted(scan.items.get(k, ())))
                    spans.append(scan.spans(k) if k in scan.items else [])
            state = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:rest], *state], [*batch.schema.names[:rest], "n_words", "n_hit", "items", "spans"])

    return run


def item_parts(text: str, size: int, most: int) -> Iterator[tuple[str, int]]:
    """Parts of an item with all of its windows, ``most`` at most in each, and their numbers."""
    w = Words(filled(pa.array([text], pa.string())), 0, 1)
    n = len(w.start) - size + 1
    if n <= most:
        yield text, max(1, n)
        return
    for at in range(0, n, most):
        end = min(n, at + most)
        yield w.lower[w.start[at] : w.stop[end + size - 2]].tobytes().decode(), end - at


def item_blocks(benchmark: DataFrame, size: int, most: int, item: str, text: str) -> Iterator[WindowSet]:
    """Window sets of about ``most`` windows; the items reach the driver one partition at a time."""
    block: list[tuple[str, str | None]] = []
    n = 0
    for i, t in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).toLocalIterator():
        for part, windows in item_parts(t or "", size, most):
            if block and n + windows > most:
                yield WindowSet(block, size)
                block, n = [], 0
            block.append((i, part))
            n += windows
    yield WindowSet(block, size)


def _with_state(docs: DataFrame, benchmark: DataFrame, size: int, block_windows: int, text: str, item: str, item_text: str) -> tuple[DataFrame, list[str]]:
    """The documents (columns renamed c0, c1, ...; the text last) with their state."""
    order = [c for c in docs.columns if c != text] + [text]
    names = [f"c{i}" for i in range(len(order))]
    out = docs.select([F.col(f"`{c}`").alias(n) for c, n in zip(order, names, strict=True)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    last, before = False, None
    for windows in item_blocks(benchmark, size, block_windows, item, item_text):
        if last:  # another block comes: what the one before found is written, and it can go
            out = cut(out, "contamination")
            if before is not None:
                remove(before)
            before = out
        out = out.mapInArrow(_pass(windows, len(order)), f"{schema}, {STATE}")
        last = True
    return out, order


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_windows: int = 1_000_000, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, n_words, n_hit, items (with occurring windows, sorted as strings),
    spans (of hit words: first, one past the last, first, ...) of every row."""
    out, order = _with_state(docs.select(key, text), benchmark, size, block_windows, text, item, item_text)
    return out.select(F.col("c0").alias(key), "n_words", "n_hit", "items", "spans")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20):
    """At least one hit word in ``share`` words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_windows: int = 1_000_000, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that are not contaminated, with the columns of ``docs``."""
    out, order = _with_state(docs, benchmark, size, block_windows, text, item, item_text)
    kept = out.filter(~is_contaminated(share=share))
    back = {c: f"c{i}" for i, c in enumerate(order)}
    return kept.select([F.col(back[c]).alias(c) for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_windows: int = 1_000_000, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows, each run of hit words cut out of the text with what is between them."""
    out, order = _with_state(docs, benchmark, size, block_windows, text, item, item_text)
    place = len(order) - 1

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(place))
            kept = batch.column(place).to_pylist()
            for k, spans in enumerate(batch.column(place + 4).to_pylist()):
                if spans:
                    w = Words(texts, k, k + 1)
                    raw = kept[k].encode()
                    edges = [0, *(int(w.start[x]) if i % 2 == 0 else int(w.stop[x - 1]) for i, x in enumerate(spans)), len(raw)]
                    kept[k] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(kept, pa.string())], batch.schema.names[: place + 1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields[: place + 1])
    back = {c: f"c{i}" for i, c in enumerate(order)}
    return out.mapInArrow(cut_out, schema).select([F.col(back[c]).alias(c) for c in docs.columns])
