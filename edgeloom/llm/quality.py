"""Quality by co-training: a view of the text and a view of its metadata.

The text view has what the text says (shares of its words, hashed to ``TERMS``
kinds) and how it looks (shares of characters and
punctuation, repetition of words and lines, lengths); the metadata view only
the source, the language and the stated length. Each is a logistic regression.
They start from the labelled rows; in each round either view is calibrated and labels the
unlabelled rows that it is surest of for the other one. In the end a regression on
the two calibrated log-odds gives the score of every document. Calibration is
on a fourth of the labelled rows, which neither view learns from (labelled rows are never in the
pool of unlabelled ones).

Training takes about ``wanted`` rows of each label and ``pool`` unlabelled
rows (documented bounds), whole texts of any length;
their features, not their texts, reach the driver.

Defined results: null and empty texts are scored by the features of an empty
text; null metadata is a value of its own; if one label is missing every
score is 1 (everything is kept); repeated rows get equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import Words, filled, mix, slices
from edgeloom.llm.common import held_out, keep_rows, share, training_rows
from edgeloom.llm.linear import logistic, predict, sigmoid

SOURCES, LANGUAGES = 64, 16
ROUNDS, SURE, PER_ROUND = 5, 0.95, 100
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
TERMS = 256
#: Width of the text view.
WIDTH = 12 + len(_PUNCTUATION) + TERMS


def content(texts: pa.Array, at: int, end: int) -> np.ndarray:
    """A row for each of the texts ``at..end``: square roots of the shares of its words of each kind."""
    w = Words(texts, at, end)
    kinds = (mix(w.hash) & np.uint64(TERMS - 1)).astype(np.int64)
    counts = np.bincount(w.text_of_word() * TERMS + kinds, minlength=(end - at) * TERMS).reshape(end - at, TERMS)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))


def looks(text: str) -> np.ndarray:
    """What a text looks like; 0 throughout for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(12 + len(_PUNCTUATION))
    if not len(raw):
        return out
    n = np.bincount(raw, minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    upper, lower, digits, high = n[65:91].sum(), n[97:123].sum(), n[48:58].sum(), n[128:].sum()
    n_words = max(1, len(words))
    out[:12] = (
        np.log(n_words),
        len(raw) / n_words / 10,
        (lower + upper + high) / len(raw),
        upper / max(1, upper + lower),
        digits / len(raw),
        high / len(raw),
        len(set(words)) / n_words,
        len(set(words)) / np.sqrt(n_words) / 10,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n_words / max(1, len(lines))),
        n[10] / n_words,
        sum(map(len, lines[:-1])) / max(1, len(text)),
    )
    out[12:] = np.sqrt(n[_PUNCTUATION] / n_words)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(SOURCES + LANGUAGES + 2)
    out[zlib.crc32(b"s" + (source or "\0").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(b"l" + (lang or "\0").encode()) % LANGUAGES] = 1
    out[-2] = np.log1p(max(0, n_chars or 0)) / 5
    out[-1] = n_chars is None
    return out


class View:
    """A logistic regression on standardised features, then Platt's calibration."""

    def __init__(self) -> None:
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean = x.mean(0)
        self.scale = 1 / np.maximum(x.std(0), 1e-3)
        balance = np.where(y > 0, len(y) / 2 / max(1, y.sum()), len(y) / 2 / max(1, (1 - y).sum()))
        self.w = logistic((x - self.mean) * self.scale, y, strength=3.0, weight=balance)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = 1.0, 0.0
        self.slope, self.shift = logistic(self.logit(x)[:, None], y, strength=0.1, prior=np.array([1.0, 0.0]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(((x - self.mean) * self.scale) @ self.w[:-1] + self.w[-1], -15, 15)
        return np.clip(self.slope * z + self.shift, -15, 15)


class QualityModel:
    def __init__(self, text: View | None = None, meta: View | None = None, join: np.ndarray | None = None) -> None:
        self.text, self.meta, self.join = text, meta, join

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: of both views together, of the text, of the metadata."""
        if self.join is None:
            one = np.ones(len(text))
            return one, one, one
        a, b = self.text.logit(text), self.meta.logit(meta)
        return predict(np.column_stack([a, b]), self.join), sigmoid(a), sigmoid(b)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> QualityModel:
    """Rows in a fixed order; every fourth is kept for calibration."""
    if len(set(y.tolist())) < 2:
        return QualityModel()
    kept = np.arange(len(y)) % 4 == 3
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(y), bool)
    train = ~kept
    views = {"text": (text, pool_text), "meta": (meta, pool_meta)}
    own = {v: (x[train], y[train]) for v, (x, _) in views.items()}
    free = np.ones(len(pool_text), bool)
    rest = kept if kept.any() else train
    for _ in range(rounds):
        models = {v: View().fit(*own[v]) for v in views}
        for v, (x, _) in views.items():  # a view that knows little is sure of nothing
            models[v].calibrate(x[rest], y[rest])
        for giver, taker in (("text", "meta"), ("meta", "text")):
            if not free.any():
                break
            p = sigmoid(models[giver].logit(views[giver][1]))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.flatnonzero(free & (sure >= SURE))
                best = best[np.argsort(-sure[best], kind="stable")][:PER_ROUND]
                if len(best):
                    free[best] = False
                    x, old = own[taker]
                    own[taker] = np.vstack([x, views[taker][1][best]]), np.concatenate([old, np.full(len(best), label)])
    models = {v: View().fit(*own[v]) for v in views}
    for v, (x, _) in views.items():
        models[v].calibrate(x[rest], y[rest])
    both = np.column_stack([models[v].logit(views[v][0][rest]) for v in ("text", "meta")])
    return QualityModel(models["text"], models["meta"], logistic(both, y[rest], strength=1.0, prior=np.array([1.0, 0.0, 0.0])))


def _features(batch: pa.RecordBatch, text: int, source: int, lang: int, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
    texts = filled(batch.column(text))
    x = [np.empty((0, WIDTH))]
    for a, b in slices(texts):
        shape = np.array([looks(t) for t in texts[a:b].to_pylist()])
        x.append(np.hstack([shape, content(texts, a, b)]))
    meta = zip(*(batch.column(c).to_pylist() for c in (source, lang, n_chars)), strict=True)
    m = [meta_features(*row) for row in meta]
    return np.concatenate(x), np.array(m).reshape(len(m), SOURCES + LANGUAGES + 2)


def _columns(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("key"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))


def _gather(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of a bounded number of rows, in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _features(batch, 1, 2, 3, 4)
            both = pa.array(np.hstack([x, m]).tolist() if len(x) else [], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(5), both], ["key", "label", "x"])

    got = sorted(rows.mapInArrow(run, "key string, label int, x array<double>").collect(), key=lambda r: (zlib.crc32((r["key"] or "").encode()), r["key"] or "", r["x"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), WIDTH + SOURCES + LANGUAGES + 2)
    return x[:, :WIDTH], x[:, WIDTH:], np.array([float(r["label"] or 0) for r in got])


def train(docs: DataFrame, labels: DataFrame, wanted: int = 1500, pool: int = 3000, label: str = "quality", key: str = "doc_id", rounds: int = ROUNDS) -> QualityModel:
    """``rounds``: how often the views exchange labels (0: not at all)."""
    known = training_rows(docs.select(key, "text", "source", "lang", "n_chars"), labels, label, wanted, key)
    text, meta, y = _gather(known.select(F.col(key).alias("key"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "label"))
    free = _columns(docs, key).filter(~held_out("key") & share("key", docs.count(), pool))
    free = free.join(labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("key")), "key", "left_anti")
    free = free.select("*", F.lit(0).alias("label")).orderBy(F.xxhash64("key", "text")).limit(2 * pool)
    pool_text, pool_meta, _ = _gather(free)
    return co_train(text, meta, y, pool_text, pool_meta, rounds)


def quality(docs: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """``key``, score (0 to 1; higher: better), text_score, meta_score, keep (score >= 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(*_features(batch, 1, 2, 3, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.float64()) for s in scores)], ["key", "score", "text_score", "meta_score"])

    rows = _columns(docs, key)
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, score double, text_score double, meta_score double")
    return out.withColumnRenamed("key", key).withColumn("keep", F.col("score") >= 0.5)


def without_poor(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows scored 0.5 or more, with the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    places = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]
    return keep_rows(docs, lambda batch: shared.value.score(*_features(batch, *places))[0] >= 0.5)
