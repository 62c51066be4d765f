"""Words of many texts at once, found and hashed on the UTF-8 bytes.

A word is a run of ASCII letters (A-Z lower-cased), ASCII digits and
characters above U+007F, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z. As every byte of a character above U+007F is above 0x7F,
the rule works byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        made = []
        for base in (_P, _P_INV):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 1 << 22:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    if not len(texts):
        return
    offsets = offsets_of(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(len(texts), max(end, at + 1))
        yield at, end
        at = end


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def filled(texts: pa.Array) -> pa.Array:
    """Null texts become empty ones; chunks become one array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return texts.fill_null("") if texts.null_count else texts


class Words:
    """Words of the texts ``at..end``.

    ``lower``: the bytes, A-Z lower-cased; ``start``, ``stop``: each word's
    place in them; ``hash``: each word's 64-bit hash; ``first``: for each text
    the index of its first word, and at the end the number of words.
    """

    def __init__(self, texts: pa.Array, at: int, end: int) -> None:
        offsets = offsets_of(texts)[at : end + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.n_texts = end - at
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.empty(0, np.uint8)
        self.lower = LOWER[raw]
        offsets = offsets - lo
        n = hi - lo
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = IS_WORD[self.lower]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins = inside[1:] & (~inside[:-1] | edge)
        ends = inside[:-1] & (~inside[1:] | edge)
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.stop] - total[self.start]) * inverse[self.start])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """Hash of ``size`` words from each word on; wrong for the last ``size - 1`` of a text."""
        h, n = self.hash, len(self.hash)
        if n < size:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(n - size + 1, dtype=np.uint64)
        for j in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : n - size + 1 + j]
        return mix(out)
