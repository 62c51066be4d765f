"""Token-id files: fixed-width bit packing with block offsets.

One shard file holds::

    magic (8 bytes) | packed blocks | footer | trailer

Each id takes the fewest bits that the vocabulary needs. A block holds
``BLOCK_IDS`` ids (the last one fewer) and starts on a byte. The footer has
the documents' keys (int64; 0 for those without one, which come first), the place
of each document's first id within the
shard and the number of ids (uint64, one more than documents), and the byte
offset of each block and the end (uint64). The trailer has, as uint64: bits,
ids to a block, documents, ids, blocks, the footer's byte offset, documents without
a key, then magic.

A reader finds any id range from the block offsets alone and unpacks whole
blocks with numpy. Files are written and read through ``pyarrow.fs``, so a
folder is any URI that it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import filled, slices
from edgeloom.llm.common import kept, new_path, release, rows_at_once
from edgeloom.llm.word_cache import WordCache, load

MAGIC = b"ELTOKEN2"
BLOCK_IDS = 1 << 16
TRAILER = struct.Struct("<7Q8s")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing; 64 ids fill ``bits`` words of 64 bits exactly."""
    n = len(ids)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-n // 64)
    lanes = np.zeros((64, groups), dtype=np.uint64)
    padded = np.zeros(groups * 64, dtype=np.uint64)
    padded[:n] = ids
    lanes[:] = padded.reshape(groups, 64).T
    out = np.zeros((bits, groups), dtype=np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[word] |= lanes[lane] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """``n`` ids from a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint64)
    groups = -(-n // 64)
    padded = data.ljust(groups * bits * 8, b"\0")
    words = np.frombuffer(padded, dtype="<u8").reshape(groups, bits).T
    out = np.empty((groups, 64), dtype=np.uint64)
    keep = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        x = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[word + 1] << np.uint64(64 - shift)
        out[:, lane] = x & keep
    return out.reshape(-1)[:n]


class ShardWriter:
    def __init__(self, out, bits: int) -> None:
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.keys: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.blocks: list[int] = []
        self.n_docs = self.n_ids = self.n_keyless = 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.add_all(pa.array([key], pa.int64()), ids, np.array([0, len(ids)]))

    def add_all(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents with the ids ``offsets[k]..offsets[k + 1]`` of ``ids``; those without a key first of all."""
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"the id {ids.max()} does not fit in {self.bits} bits")
        if keys.null_count and self.n_keyless < self.n_docs:
            raise ValueError("documents without a key must come first")
        self.n_keyless += keys.null_count
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        self.starts.append(offsets[:-1] + self.n_ids)
        self.n_docs += len(keys)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            data = pack(ids[at : min(at + BLOCK_IDS, whole)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting = [ids[whole:]]
        self.n_waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        footer = (
            np.concatenate([np.empty(0, np.int64), *self.keys]).astype("<i8").tobytes()
            + np.concatenate([np.empty(0, np.int64), *self.starts, [self.n_ids]]).astype("<u8").tobytes()
            + np.array([*self.blocks, self.at], dtype="<u8").tobytes()
        )
        self.out.write(footer)
        self.out.write(TRAILER.pack(self.bits, BLOCK_IDS, self.n_docs, self.n_ids, len(self.blocks), self.at, self.n_keyless, MAGIC))
        self.out.close()


class ShardReader:
    """Random access to the ids and documents of one shard."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.bits, self.block_ids, self.n_docs, self.n_ids, self.n_blocks, at, self.n_keyless, magic = TRAILER.unpack(
            self.file.read_at(TRAILER.size, size - TRAILER.size)
        )
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        footer = self.file.read_at(size - TRAILER.size - at, at)
        n, m = self.n_docs, self.n_blocks
        self.keys = np.frombuffer(footer, "<i8", n)
        self.starts = np.frombuffer(footer, "<u8", n + 1, 8 * n).astype(np.int64)
        self.blocks = np.frombuffer(footer, "<u8", m + 1, 8 * (2 * n + 1)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids ``start..stop`` of the shard; reads only their blocks."""
        if stop <= start:
            return np.empty(0, np.uint64)
        lo, hi = start // self.block_ids, (stop - 1) // self.block_ids + 1
        base = int(self.blocks[lo])
        data = self.file.read_at(int(self.blocks[hi]) - base, base)
        parts = []
        for b in range(lo, hi):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            parts.append(unpack(data[int(self.blocks[b]) - base : int(self.blocks[b + 1]) - base], n, self.bits))
        return np.concatenate(parts)[start - lo * self.block_ids : stop - lo * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def key(self, k: int) -> int | None:
        return None if k < self.n_keyless else int(self.keys[k])

    def chunks(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, one past the last, their ids), about ``most`` ids at a time."""
        at = 0
        while at < self.n_docs:
            end = int(np.searchsorted(self.starts, self.starts[at] + most, side="right")) - 1
            end = min(self.n_docs, max(end, at + 1))
            yield at, end, self.ids(int(self.starts[at]), int(self.starts[end]))
            at = end

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, first place, ids) of each document, reading about ``most`` ids at a time."""
        for at, end, ids in self.chunks(most):
            lo = int(self.starts[at])
            for k in range(at, end):
                yield self.key(k), int(self.starts[k]), ids[int(self.starts[k]) - lo : int(self.starts[k + 1]) - lo]


Encoder = Callable[[pa.Array, int, int], tuple[np.ndarray, np.ndarray]]

#: Bytes of text encoded at once and hashed at once, and rows that Python gets at once. An executor may have more
#: workers than cores, as one that has ended a task is not free at once for the next.
ENCODED, HASHED, ROWS = 1 << 20, 1 << 18, 1000


def _encode(path: str, texts: pa.Array, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    def make() -> WordCache:
        cache = WordCache(path, count=False)
        cache.chunk = HASHED
        return cache

    return kept(f"token ids {path}", make).encode(texts, at, end)


def _shard_uri(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.tok"


def write_token_files(docs: DataFrame, folder: str, encode: Encoder, vocabulary: int, end_id: int | None, text: str = "text", key: str = "doc_id") -> list[tuple[int, int]]:
    """Writes every row's ids to shards in ascending order of ``key``, an integer (null
    first; ties by the text's hash); gives (part, ids) of each shard, in that order.

    ``encode`` gives the ids of some texts of an array, and where each text's begin. A
    shard is one range of keys. A task writes under a name of its own and
    renames at the end, so a repeated task replaces the same file.
    Null texts count as empty. An id that the vocabulary does not have is an error.
    """
    bits = bits_for(max(vocabulary, (end_id or 0) + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, to = fs.FileSystem.from_uri(_shard_uri(folder, part))
        own, writer = f"{to}.{uuid.uuid4().hex}", None
        for batch in batches:
            texts, keys = filled(batch.column(1)), batch.column(0)
            for at, end in slices(texts, ENCODED):
                if writer is None:
                    system.create_dir(to.rpartition("/")[0], recursive=True)
                    writer = ShardWriter(system.open_output_stream(own), bits)
                ids, offsets = encode(texts, at, end)
                if end_id is not None:
                    ids = np.insert(ids, offsets[1:], end_id)
                    offsets = offsets + np.arange(len(offsets))
                writer.add_all(keys[at:end], ids, offsets)
        if writer is not None:
            writer.close()
            if system.get_file_info(to).type != fs.FileType.NotFound:
                system.delete_file(to)
            system.move(own, to)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["part", "n_ids"])
        release()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
    with rows_at_once(docs.sparkSession, ROWS):
        made = ordered.mapInArrow(write, "part long, n_ids long").collect()  # one row for each shard
    return sorted((r["part"], r["n_ids"]) for r in made)


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int]], key: str = "doc_id") -> DataFrame:
    """``key``, start (ids of all documents before it), n_tokens and ids_crc32 of
    each document, from the files; one task reads one shard, some blocks at a time."""
    parts = np.array([p for p, _ in shards], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum([n for _, n in shards])]).astype(np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("token file reader", lambda: None)  # no encoder stays in the worker
        for batch in batches:
            for k in batch.column(0).to_pylist():
                reader = ShardReader(_shard_uri(folder, int(parts[k])))
                for at, end, ids in reader.chunks():
                    starts = reader.starts[at : end + 1]
                    data = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[a:b]) for a, b in pairwise((4 * (starts - starts[0])).tolist())]
                    keys = pa.array(reader.keys[at:end], mask=np.arange(at, end) < reader.n_keyless)
                    columns = [keys, pa.array(starts[:-1] + int(base[k])), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [key, "start", "n_tokens", "ids_crc32"])

    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(read, schema)


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes, writes, reads back. An empty table gives no file and no row."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    vocabulary = load(tokenizer).get_vocab_size(with_added_tokens=True)
    shards = write_token_files(docs, folder, lambda texts, at, end: _encode(tokenizer, texts, at, end), vocabulary, end_id)
    return read_token_files(spark, folder, shards)
