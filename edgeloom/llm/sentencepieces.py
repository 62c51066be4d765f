"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

An automaton over the model's pieces runs once through the text; at each
position its output links give all pieces that end there, and each relaxes
the best score of that position with the score of the place it begins at and that of the step.

For a unigram model the score of a step is its piece's, in single precision as in the library;
of equal scores the longer piece stays. A character without a piece is a step of its own
far below. For a BPE model a step from one piece to the next has score 0 if merging their
joined characters by the model's ranks gives back just these two pieces, and minus infinity otherwise (then
all of a path's pieces are what merging the whole text gives, and one path
alone reaches each position); pairs are remembered. Characters without
a piece become their UTF-8 bytes' pieces, or a run of them one unknown piece.

For BPE models a text is cut before each run of spaces, as no piece has a space after another
character, and each part's result is kept in a bounded memory.

Only models with the identity normaliser and without user-defined pieces are read. Defined results: a null or
empty text has no ids; U+2581 in a text stands for a space, as in the library,
so it does not come back; repeated rows are encoded each; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from edgeloom.llm.bytewords import filled, offsets_of, slices
from edgeloom.llm.common import kept, release
from edgeloom.llm.word_cache import PartCache

SPACE = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
NEVER = float("-inf")
#: Bytes of texts encoded, and decoded again, at a time (a longer text is done alone); steps remembered.
AT_ONCE = 1 << 20
PAIRS = 500_000
#: The library's penalty of an unknown character below the lowest score.
UNKNOWN_PENALTY = 10.0


class Pieces:
    def __init__(self, path: str | None = None, data: bytes | None = None) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data if data is not None else open(path, "rb").read())
        rule = model.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        self.bpe = model.trainer_spec.model_type == BPE
        if not self.bpe and model.trainer_spec.model_type != UNIGRAM:
            raise ValueError("only BPE and unigram models are supported")
        self.prefix = SPACE if rule.add_dummy_prefix else ""
        self.text = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        if USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == BYTE}
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == NORMAL}
        if self.bpe and any(SPACE in t.lstrip(SPACE) for t in self.id):
            raise ValueError("a piece has a space after another character")
        self.zero = 0.0 if self.bpe else np.float32(0)
        self.single = [np.float32(x) for x in self.score]
        self.low = np.float32(min((self.score[i] for i in self.id.values()), default=0.0)) - np.float32(UNKNOWN_PENALTY)
        self.low = float(self.low) if self.bpe else self.low
        self.pairs: dict[int, float] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if not self.bpe or self._merged(t) == [i]:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.alphabet = frozenset(t for t in self.id if len(t) == 1)
        self.bytes_of = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k not in (NORMAL, USER, UNKNOWN) else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kinds, strict=True)]
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.byte_size, self.byte_begin = size, np.cumsum(size) - size
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _merged(self, text: str) -> list[int]:
        """Merging pair by pair, the best rank first, from the left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id.get(p, -1) for p in parts]

    def _fallback(self, char: str) -> list[int]:
        if self.byte:
            return [self.byte[b] for b in char.encode("utf-8", "replace")]
        return [self.unknown]

    def _merges(self, a: int, b: int) -> float:
        """Score of a step from piece ``a`` to piece ``b`` of a BPE model."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = 0.0 if self._merged(self.text[a] + self.text[b]) == [a, b] else NEVER
        return known

    def viterbi(self, text: str) -> list[int]:
        """Ids of a part, spaces already marked."""
        n = len(text)
        last = [-1] * (n + 1)  # the piece that the best path to each place ends with; -1: no piece
        start = [0] * (n + 1)
        best: list[float] = [NEVER] * (n + 1)
        best[0] = self.zero
        pairs, bpe, single, alphabet = self.pairs, self.bpe, self.single, self.alphabet
        seen = 0
        for at, (piece, length) in self.automaton.iter(text):
            end, begin = at + 1, at + 1 - length
            while seen < at:  # the places before are done but for characters without a piece
                seen += 1
                if text[seen - 1] not in alphabet and best[seen - 1] + self.low > best[seen]:
                    best[seen], last[seen], start[seen] = best[seen - 1] + self.low, -1, seen - 1
            score = best[begin]
            if score == NEVER:
                continue
            if not bpe:
                score = score + single[piece]
            elif (before := last[begin]) >= 0:
                step = pairs.get(before << 32 | piece)
                score += self._merges(before, piece) if step is None else step
            if score > best[end]:
                best[end], last[end], start[end] = score, piece, begin
        for place in range(seen + 1, n + 1):
            if text[place - 1] not in alphabet and best[place - 1] + self.low > best[place]:
                best[place], last[place], start[place] = best[place - 1] + self.low, -1, place - 1
        out: list[int] = []
        place, run = n, False
        while place:
            if last[place] >= 0:
                out.append(last[place])
            elif self.byte:
                out += reversed(self._fallback(text[place - 1]))
            elif not run:  # a run of unknown characters is one piece
                out.append(self.unknown)
            run = last[place] < 0
            place = start[place]
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.viterbi(self.prefix + text.replace(" ", SPACE)) if text else []

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after another, and where each id's end."""
        size = self.byte_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.byte_begin[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.byte_pool[at], ends

    def decode(self, ids: np.ndarray) -> str:
        text = self.decoded(ids)[0].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def restored(self, ids: np.ndarray, offsets: np.ndarray, texts: pa.Array, at: int) -> np.ndarray:
        """Whether decoding the ids ``offsets[k]..offsets[k + 1]`` gives the text ``at + k`` back."""
        data, ends = self.decoded(ids)
        ends = np.append(0, ends)[offsets]
        begin, lead = ends[:-1], len(self.prefix)
        place = offsets_of(texts)[at : at + len(offsets)]
        size = np.diff(place)
        same = np.diff(ends) == size + lead * (size > 0)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[place[0] : place[-1]] if place[-1] > place[0] else np.empty(0, np.uint8)
        for k in np.flatnonzero(same & (size > 0)).tolist():
            a, b = int(begin[k]) + lead, int(place[k] - place[0])
            same[k] = (not lead or data[a - 1] == 32) and bool((data[a : a + size[k]] == raw[b : b + size[k]]).all())
        return same


class PieceCache(PartCache):
    """Parts of texts, or for some models whole texts, encoded by the model."""

    chunk = 1 << 18

    def __init__(self, pieces: Pieces) -> None:
        super().__init__(count=False, first_differs=bool(pieces.prefix))
        self.pieces = pieces
        # a line feed without a piece is bytes and stands alone
        self.split = pieces.bpe and "\n" not in "".join(pieces.id) and bool(pieces.byte)

    def _places(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = super()._places(raw, offsets)
        # U+2581 is a space too; two of them are never cut apart
        mark = (raw[at - 1] == 0x81) & (raw[np.maximum(at - 2, 0)] == 0x96) & (raw[np.maximum(at - 3, 0)] == 0xE2)
        return at[~mark]

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.pieces.ids(t), np.uint32) for t in texts]

    def _learn(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, prefix, viterbi = raw.tobytes(), self.pieces.prefix, self.pieces.viterbi
        made: list[int] = []
        size = []
        for a, b, f in zip(start.tolist(), stop.tolist(), first.tolist(), strict=True):
            ids = viterbi((prefix if f else "") + data[a:b].decode("utf-8", "replace").replace(" ", SPACE))
            made += ids
            size.append(len(ids))
        sizes = np.array(size, np.int64)
        return np.array(made, np.uint32), np.cumsum(sizes) - sizes, sizes


def load(path: str) -> PieceCache:
    """A worker's model, read once."""
    return kept(path, lambda: PieceCache(Pieces(path)))


def encoded(model: PieceCache, keys: pa.Array, texts: pa.Array, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`encode`, those of about ``AT_ONCE`` bytes of texts together."""
    for at, end in slices(texts, AT_ONCE):
        ids, offsets = model.encode(texts, at, end)
        data = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(data[a:b]) for a, b in pairwise((4 * offsets).tolist())]
        same = model.pieces.restored(ids, offsets, texts, at)
        out = [keys[at:end], pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
        names = ["key", "n_ids", "ids_crc32", "round_trip"]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32), pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names)
        release()


def encode(docs: DataFrame, path: str, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_ids, ids_crc32 (of little-endian 32-bit ids), round_trip (whether
    decoding gives the text back) and, if asked for, ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            yield from encoded(model, batch.column(0), filled(batch.column(1)), with_ids)
        release()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_ids long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``, the text of an array of ids (null: null)."""
    names = rows.columns
    place = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path).pieces
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    if out in names:
        raise ValueError(f"{out} is a column already")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))
