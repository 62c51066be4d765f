"""Language identification with string kernels.

Kernel: the number of character n-grams (n = 1 to ``orders``, the blended
spectrum) that two texts share, each counted once however often it occurs
(presence), divided by the geometric mean of the texts' own numbers. N-grams
are hashed to ``DIM`` places. Letters only, lower-cased; everything else is
one gap symbol.

Nystroem: the kernel against ``landmarks`` training texts stands for the whole
kernel, and a one-versus-rest ridge regression is solved in that space. As the
kernel before its division is a product of 0/1 vectors, the landmarks and the
regression's weights multiply into one (``DIM`` x languages) matrix; a batch
of texts is scored by one product of its presence matrix with it.

Training takes about ``per_language`` whole texts of each language, of any length, chosen by a
hash (a documented bound); the places of their n-grams, at most ``DIM`` to a text, and not the
texts reach the driver, so its memory grows with the number of languages only.

Defined results: a null text or one without letters is ``und`` with score 0;
so is every text if there is nothing to learn from; repeated rows get equal
results; ties go to the language that sorts first; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import filled, mix, slices

DIM = 1 << 15
GAP = 1
BLOCK = 64  # texts to a matrix product
MOST_BROADCAST = 10_000  # languages


def _letter_table() -> np.ndarray:
    """For each code point of the first plane: its lower-case letter, or GAP."""
    out = np.full(1 << 16, GAP, dtype=np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_letters: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    """Lower-case letters of a text, runs of anything else as one GAP; empty without letters."""
    if not _letters:
        _letters.append(_letter_table())
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _letters[0][np.minimum(cp, 0xFFFF)]
    if len(cp) and cp.max() > 0xFFFF:
        far = np.flatnonzero(cp > 0xFFFF)
        low[far] = [int(c) if chr(c).isalpha() else GAP for c in cp[far]]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != GAP) | (low[:-1] != GAP)
    low = low[keep]
    if not (low != GAP).any():
        return np.empty(0, np.uint32)
    edge = np.array([GAP], np.uint32)
    return np.concatenate([edge[: int(low[0] != GAP)], low, edge[: int(low[-1] != GAP)]])


def presence(text: str, orders: int) -> np.ndarray:
    """Places (below DIM) of the n-grams that occur."""
    cp = code_points(text).astype(np.uint64)
    seen = np.zeros(DIM, dtype=bool)
    code = np.zeros(len(cp), dtype=np.uint64)
    for n in range(1, orders + 1):
        if len(cp) < n:
            break
        code = code[: len(cp) - n + 1] * np.uint64(0x1F123BB5) + cp[n - 1 :] + np.uint64(n)
        scrambled = code * np.uint64(0x9E3779B97F4A7C15)
        seen[scrambled >> np.uint64(64 - 15)] = True
    return np.flatnonzero(seen)


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, orders: int) -> None:
        self.languages, self.weights, self.orders = languages, weights, orders

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        block = np.zeros((BLOCK, DIM), dtype=np.float32)
        for at in range(0, len(texts), BLOCK):
            some = [presence(t or "", self.orders) for t in texts[at : at + BLOCK]]
            if not self.languages:
                names += ["und"] * len(some)
                scores += [0.0] * len(some)
                continue
            for row, places in enumerate(some):
                block[row, places] = 1 / np.sqrt(max(1, len(places)))
            product = (block[: len(some)] @ self.weights).astype(np.float64)
            for row, places in enumerate(some):
                block[row, places] = 0
            best = product.argmax(1)
            sharp = np.exp(8.0 * (product - product.max(1, keepdims=True)))
            for k, places in enumerate(some):
                names.append(self.languages[best[k]] if len(places) else "und")
                scores.append(float(sharp[k, best[k]] / sharp[k].sum()) if len(places) else 0.0)
        return names, scores


def fit(rows: list[tuple[np.ndarray, str]], orders: int, landmarks: int, ridge: float) -> LanguageModel:
    """From (places of a text's n-grams, language) pairs."""
    pairs = [(p, lang) for p, lang in rows if len(p)]
    languages = sorted({lang for _, lang in pairs})
    if not languages:
        return LanguageModel([], np.zeros((DIM, 0), np.float32), orders)
    # landmarks in turn from each language
    by: dict[str, list[int]] = {}
    for k, (_, lang) in enumerate(pairs):
        by.setdefault(lang, []).append(k)
    chosen: list[int] = []
    turn = 0
    while len(chosen) < min(landmarks, len(pairs)):
        chosen += [x[turn] for x in by.values() if turn < len(x)]
        turn += 1
    marks = np.zeros((len(chosen), DIM), dtype=np.float32)
    for row, k in enumerate(chosen):
        marks[row, pairs[k][0]] = 1 / np.sqrt(len(pairs[k][0]))
    kernel = np.zeros((len(pairs), len(chosen)), dtype=np.float32)
    for at in range(0, len(pairs), 256):
        block = np.zeros((min(256, len(pairs) - at), DIM), dtype=np.float32)
        for row, (p, _) in enumerate(pairs[at : at + 256]):
            block[row, p] = 1 / np.sqrt(len(p))
        kernel[at : at + 256] = block @ marks.T
    number = {lang: k for k, lang in enumerate(languages)}
    own = np.array([number[lang] for _, lang in pairs])
    target = np.full((len(pairs), len(languages)), -1.0)
    target[np.arange(len(pairs)), own] = 1.0
    count = np.bincount(own)
    balance = (len(pairs) / len(languages) / count[own])[:, None]
    k64 = kernel.astype(np.float64)
    left = k64.T @ (k64 * balance) + ridge * (marks @ marks.T).astype(np.float64) + 1e-6 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, k64.T @ (target * balance))
    return LanguageModel(languages, (marks.T.astype(np.float64) @ alpha).astype(np.float32), orders)


def train(docs: DataFrame, orders: int = 4, per_language: int = 400, most: int = 20_000, landmarks: int = 256, ridge: float = 1.0, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Learns from the rows of ``docs`` with a language: about ``per_language`` of each, and
    about ``most`` together where there are very many languages (but one of each)."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    wanted = max(1, min(per_language, most // max(1, languages)))
    place = F.pmod(F.xxhash64(F.lit("share"), "key"), F.lit(1 << 30))
    # the rows of a language are few or many; a share of twice as many as wanted, at least 20, is then cut to size
    counts = F.broadcast(counts) if languages <= MOST_BROADCAST else counts.hint("merge")
    near = known.join(counts, "lang").filter(place.cast("double") * F.col("n") <= (1 << 30) * (2.0 * wanted + 20))
    first = W.partitionBy("lang").orderBy(F.xxhash64("key", "text"), "key", "text")
    sample = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= wanted).select("text", "lang")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(0))
            found = [presence(t, orders) for at, end in slices(texts, 4 << 20) for t in texts[at:end].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["lang", "places"])

    rows = sorted((r["lang"], r["places"]) for r in sample.mapInArrow(places, "lang string, places array<int>").collect())
    return fit([(np.array(p, np.int64), lang) for lang, p in rows], orders, landmarks, ridge)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, lang_pred, score (0 to 1) of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.orders))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shared.value)
        for batch in batches:
            texts = filled(batch.column(1))
            names: list[str] = []
            scores: list[float] = []
            for at, end in slices(texts, 4 << 20):
                n, s = model.predict(texts[at:end].to_pylist())
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(score, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
