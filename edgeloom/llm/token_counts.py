"""Token counts: exact lengths of whole texts, without shipping the ids.

Batches reach Python through Arrow and are dealt out by bytes; long texts are
split at safe boundaries (see :mod:`edgeloom.llm.word_cache`), so neither the
memory of a batch nor the library's work on it depends on the longest text.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import filled, slices
from edgeloom.llm.word_cache import WordCache

_counters: dict = {}


def library_counts(path: str, texts: pa.Array, at: int, end: int) -> np.ndarray:
    """Token counts by the library that the file is for, no special tokens added."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda texts, at, end: np.array([len(x) for x in model.encode(texts[at:end].to_pylist(), num_threads=1)], dtype=np.int64)
        else:
            _counters[path] = WordCache(path, count=True).counts
    return _counters[path](texts, at, end)


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id", batch_bytes: int = 8 << 20) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            counts = [library_counts(path, texts, at, end) for at, end in slices(texts, batch_bytes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate([np.empty(0, np.int64), *counts]), pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
