"""Encoding with a bounded memory of words.

Texts are split at safe boundaries only: before a space or line feed with a character
other than white space on both sides, and for the byte-level pre-tokeniser between a letter or digit and
one of ``.,;:!?`` too. It always
starts a new piece there, so the parts' results put together are the whole
text's result. The parts of many texts are found and hashed (128 bits) on the UTF-8
bytes at once; results are looked up in a table with one place for each value of
``PLACE_BITS`` bits, where a newer word takes an older one's place. Only words that
are not there are encoded, many at once. Parts of more than
``LONGEST`` bytes are always encoded.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from edgeloom.llm.bytewords import mix, offsets_of

PLACE_BITS = 21
LONGEST = 256
CHUNK = 1 << 20  # bytes hashed at a time
POOL = 1 << 23  # ids kept
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_tokenizers: dict = {}


def load(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


def separable(path: str) -> bool:
    """Whether texts may be split: a byte-level pre-tokeniser that adds no
    space, no normaliser, and no added token that a boundary could cut, or with stripping."""
    import json

    spec = json.loads(load(path).to_str())
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and bool(pre.get("use_regex", True))
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s.,;:!?]", t["content"])
            for t in spec.get("added_tokens", [])
        )
    )


_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _wide_space(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes are a white-space character of three bytes, or end (a = any) in one of two."""
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def _narrow_space(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == 0xC2) & ((b == 0x85) | (b == 0xA0))


def safe_places(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of spaces and line feeds between two characters of one text that are not white space."""
    at = np.flatnonzero((raw == 32) | (raw == 10))
    if not len(at):
        return at
    text = np.searchsorted(offsets, at, side="right") - 1
    at = at[(at > offsets[text]) & (at + 1 < offsets[text + 1])]
    at = at[~_ASCII_SPACE[raw[at - 1]] & ~_ASCII_SPACE[raw[at + 1]]]
    high = np.flatnonzero((raw[at - 1] >= 0x80) | (raw[at + 1] >= 0x80))
    if len(high):  # the bytes of a whole character stand on either side, so at most two more are looked at
        p, n = at[high], len(raw) - 1
        before = _narrow_space(raw[np.maximum(p - 2, 0)], raw[p - 1]) | _wide_space(raw[np.maximum(p - 3, 0)], raw[np.maximum(p - 2, 0)], raw[p - 1])
        after = _narrow_space(raw[p + 1], raw[np.minimum(p + 2, n)]) | _wide_space(raw[p + 1], raw[np.minimum(p + 2, n)], raw[np.minimum(p + 3, n)])
        at = np.delete(at, high[before | after])
    return at


_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True
_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def stop_places(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of one of ``.,;:!?`` after an ASCII letter or digit or one of the letters U+00C0 to U+00FF of the same text."""
    at = np.flatnonzero(_STOP[raw])
    at = at[~np.isin(at, offsets)] if len(at) else at
    a, b = raw[at - 1], raw[np.maximum(at - 2, 0)]
    return at[_ASCII_WORD[a] | ((b == 0xC3) & (a >= 0x80) & (a != 0x97) & (a != 0xB7))]


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _powers or len(_powers[0][0]) < n:
        _powers[:] = [tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (b, pow(b, -1, 1 << 64))) for b in _BASES]
    return _powers


def _hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each part of ``raw``."""
    values, out = raw.astype(np.uint64) + np.uint64(1), []
    for power, back in _power_tables(len(raw)):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(raw)], out=total[1:])
        out.append(mix((total[stop] - total[start]) * back[start]))
    return out


class PartCache:
    """``count``: only numbers of ids are kept. ``first_differs``: a text's first part is
    not encoded as the same part elsewhere."""

    split = True
    chunk: int | None = None  # bytes hashed at a time, if not CHUNK

    def __init__(self, count: bool, first_differs: bool = False) -> None:
        self.count, self.first_differs = count, first_differs
        self._clear()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        raise NotImplementedError

    def _learn(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts of ``raw``, of which some are the first of their texts: all
        ids in any order, and for each part where they begin and how many they are."""
        raise NotImplementedError

    def _places(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return safe_places(raw, offsets)

    def _clear(self) -> None:
        n = 1 << PLACE_BITS
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size, self.begin = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool = np.empty(0 if self.count else POOL, np.uint32)
        self.used = 0

    def _keep(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids into the pool, which grows if they do not fit; where they begin in it, how many they are."""
        begin = begin + self.used
        if not self.count:
            end = self.used + len(ids)
            if end > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty(max(end - len(self.pool), POOL), np.uint32)])
            self.pool[self.used : end] = ids
            self.used = end
        return begin, size

    def _chunk(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin in the pool and number of ids of each part."""
        key, check = _hashes(raw, start, stop)
        if self.first_differs:
            check = np.where(first, ~check, check)
        place = (key >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        known = (self.key[place] == key) & (self.check[place] == check)
        long = stop - start > LONGEST
        begin, size = self.begin[place].astype(np.int64), self.size[place].astype(np.int64)
        missing = np.flatnonzero(~known | long)
        if len(missing):
            both = np.stack([key[missing], check[missing]], axis=1)
            both[long[missing]] = np.stack([missing[long[missing]].astype(np.uint64)] * 2, axis=1)  # never taken for equal
            order = np.lexsort((both[:, 1], both[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (both[order][1:] != both[order][:-1]).any(1)
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            one = missing[order[new]]
            b, s = self._keep(*self._learn(raw, start[one], stop[one], first[one]))
            begin[missing], size[missing] = b[which], s[which]
            short = ~long[one]
            to, one = place[one[short]], one[short]
            self.key[to], self.check[to] = key[one], check[one]
            self.begin[to], self.size[to] = begin[one], size[one]
        return begin, size

    def _parts(self, texts: pa.Array, at: int, end: int):
        """For each chunk: the texts of its parts (an empty text has none), where they begin in the pool, how many ids."""
        offsets = offsets_of(texts)[at : end + 1]
        lo = int(offsets[0])
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[lo : int(offsets[-1])] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - lo
        full = np.flatnonzero(np.diff(offsets))
        start = np.sort(np.concatenate([offsets[full], self._places(raw, offsets)]))
        stop = np.append(start[1:], len(raw))
        owner = np.searchsorted(offsets, start, side="right") - 1
        first = start == offsets[owner]
        chunk = self.chunk or CHUNK
        _power_tables(chunk)
        k = 0
        while k < len(start):
            if self.used > POOL // 2:
                self._clear()
            n = max(k + 1, int(np.searchsorted(stop, start[k] + chunk, side="right")))
            base = int(start[k])
            if n == k + 1 and stop[k] - base > chunk:  # one long part
                yield owner[k:n], *self._keep(*self._learn(raw, start[k:n], stop[k:n], first[k:n]))
            else:
                yield owner[k:n], *self._chunk(raw[base : stop[n - 1]], start[k:n] - base, stop[k:n] - base, first[k:n])
            k = n

    def counts(self, texts: pa.Array, at: int, end: int) -> np.ndarray:
        """Number of tokens of the texts ``at..end``, none of them null."""
        if not self.split:
            return np.array([len(x) for x in self.library(texts[at:end].to_pylist())], dtype=np.int64)
        out = np.zeros(end - at, dtype=np.int64)
        for owner, _, size in self._parts(texts, at, end):
            out += np.bincount(owner, weights=size, minlength=end - at).astype(np.int64)
        return out

    def encode(self, texts: pa.Array, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts ``at..end``, and for each text the place of its first one (and the end)."""
        if not self.split:
            rows = self.library(texts[at:end].to_pylist())
            return np.concatenate(rows) if rows else np.empty(0, np.uint32), np.cumsum([0, *map(len, rows)])
        n, ids = np.zeros(end - at, dtype=np.int64), [np.empty(0, np.uint32)]
        for owner, begin, size in self._parts(texts, at, end):
            n += np.bincount(owner, weights=size, minlength=end - at).astype(np.int64)
            upto = np.cumsum(size)
            ids.append(self.pool[np.repeat(begin - upto + size, size) + np.arange(int(upto[-1]))])
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(n)])


class WordCache(PartCache):
    """Parts encoded by the ``tokenizers`` library."""

    def __init__(self, path: str, count: bool) -> None:
        super().__init__(count)
        self.path, self.split = path, separable(path)
        vocabulary = load(path).get_vocab()
        self.leads = {}
        for lead, mark in ((" ", "Ġ"), ("\n", "Ċ")):
            table = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            # a line feed next to other characters is a piece of its own
            table[[i for t, i in vocabulary.items() if (t.startswith(mark) if lead == " " else t == mark)]] = True
            self.leads[lead] = table

    def _places(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.concatenate([safe_places(raw, offsets), stop_places(raw, offsets)])

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in load(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts with one of ``leads`` before them, and none inside, are
        encoded together as one text: each begins at the one token that has it."""
        begin, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        at = np.repeat(start - np.cumsum(stop - start) + (stop - start), stop - start) + np.arange(int((stop - start).sum()))
        data = raw[at]  # the parts one after another
        ends = np.cumsum(stop - start)
        starts = ends - (stop - start)
        last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
        plain = (last < 0x80) & ~_ASCII_SPACE[last] | (last >= 0x80) & (before == 0xC3)
        rest, groups = np.ones(len(start), bool), []
        for lead, table in self.leads.items():
            inside = np.add.reduceat(data == ord(lead), starts) if len(start) else starts
            alike = np.flatnonzero(plain & (inside == 1) & (data[starts] == ord(lead)))
            rest[alike] = False
            for k in range(0, len(alike), 500):
                some = alike[k : k + 500]
                text = b"".join([data[x:y].tobytes() for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
                groups.append((table, some, text.decode("utf-8", "replace")))
        made, n = [], 0
        for (table, some, _), ids in zip(groups, self.library([g[2] for g in groups]), strict=True):
            place = np.flatnonzero(table[ids])
            if len(place) != len(some) or place[0]:
                rest[some] = True
                continue
            begin[some], size[some] = place + n, np.diff(np.append(place, len(ids)))
            made.append(ids)
            n += len(ids)
        alone = np.flatnonzero(rest)
        for k, ids in zip(alone.tolist(), self.library([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]), strict=True):
            begin[k], size[k] = n, len(ids)
            made.append(ids)
            n += len(ids)
        return np.concatenate([np.empty(0, np.uint32), *made]), begin, size
