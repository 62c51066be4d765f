"""Toxicity: a learned lexicon, misspellings of it, and the words around a hit.

The lexicon is learned from labelled texts: words, and beginnings of words,
that stand in toxic texts too often for chance. It is kept as a trie. A word
of a text is matched by running its Levenshtein automaton along the trie, so
one walk finds all entries within their number of edits (none for short
entries, then one, then two; see ``edits_for``). An approximate match of a
word that clean training texts use is dropped.

Each hit is looked at in a window: hits between an opening and a closing quotation
mark of one kind, at most ``QUOTED`` characters apart and in one line, count
apart from direct ones (marks without a partner there mean nothing, nor do
apostrophes and signs of inches), and hits near each other count more. A logistic
regression on these sums gives the score; its prior expects direct hits to
weigh most, misspelled ones less, quoted ones little.

Training takes about ``wanted`` texts of either label, fewer by chance if they are
more than ``common.TRAIN_BYTES`` bytes in all (documented bounds); each is
learned from as a whole, whatever its length.

Defined results: null and empty texts get the score of a text without a hit;
with no usable label every score is 0; repeated rows get equal scores; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import filled, slices
from edgeloom.llm.common import keep_rows, kept, training_rows, within_bytes
from edgeloom.llm.linear import logistic, predict

WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"'“”„‘’‚«»‹›]")
#: Marks that open, each with those that close it; straight ones go by what stands beside them.
CLOSED_BY = {'"': '"', "'": "'", "“": "”", "„": "“”", "‘": "’", "‚": "‘’", "«": "»", "»": "«", "‹": "›", "›": "‹"}
QUOTED = 300
WINDOW = 8
SHORTEST_STEM, LONGEST_STEM = 4, 8
#: Longer words are matched each time and not remembered.
REMEMBERED = 40
#: An entry is telling if clean texts have it at most this often for each toxic text that has it.
TELLING = 0.02
#: Prior weights of the features (see ``features``) and the bias.
PRIOR = np.array([2.5, 1.0, 1.0, 0.3, 1.5, 0.3, -3.5])


def edits_for(entry: str, stem: bool) -> int:
    n = len(entry)
    if stem:
        return 0
    return 2 if n >= 9 else 1 if n >= 5 else 0


class LevenshteinAutomaton:
    """States are the sparse rows of the edit table: (place in the word, edits)."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most

    def start(self) -> list[tuple[int, int]]:
        return [(i, i) for i in range(min(self.most, len(self.word)) + 1)]

    def step(self, state: list[tuple[int, int]], char: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        word, most = self.word, self.most
        before = dict(state)
        if state and state[0][0] == 0 and state[0][1] < most:
            out.append((0, state[0][1] + 1))
        for j, (i, d) in enumerate(state):
            if i == len(word):
                break
            best = d if word[i] == char else d + 1
            if out and out[-1][0] == i:
                best = min(best, out[-1][1] + 1)
            if j + 1 < len(state) and state[j + 1][0] == i + 1:
                best = min(best, before[i + 1] + 1)
            if best <= most:
                out.append((i + 1, best))
            # a place that only an insertion reaches
            k = i + 1
            while out and out[-1][0] == k and out[-1][1] < most and k < len(word) and k not in before:
                out.append((k + 1, out[-1][1] + 1))
                k += 1
        return out


class Lexicon:
    """Entries (text, whether it is a stem, weight) in a trie. A weight is the logarithm
    of how much more frequent it is in toxic texts, negative if it is not telling."""

    def __init__(self, entries: list[tuple[str, bool, float]], clean: frozenset[str] = frozenset()) -> None:
        self.entries, self.clean = entries, clean
        self.trie: dict = {}
        self.most = 0
        #: With n edits, one of n + 1 parts of an entry stands in the word unchanged and
        #: at most n places away. By the word's length (0: any): place, end, parts.
        places: dict[int, dict[tuple[int, int], set[str]]] = {}
        for k, (text, stem, _) in enumerate(entries):
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(k)
            edits = edits_for(text, stem)
            self.most = max(self.most, edits)
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                for shift in range(-edits, edits + 1):
                    if a + shift >= 0:
                        for n in [0] if stem else range(len(text) - edits, len(text) + edits + 1):
                            places.setdefault(n, {}).setdefault((a + shift, b + shift), set()).add(text[a:b])
        self.sieve = {n: [(*at, frozenset(parts)) for at, parts in x.items()] for n, x in places.items()}
        self.known: dict[str, tuple[float, bool] | None] = {}

    def near(self, word: str) -> bool:
        """False for a word that can't match; true for few others."""
        for a, b, parts in self.sieve.get(len(word), ()):
            if word[a:b] in parts:
                return True
        for a, b, parts in self.sieve.get(0, ()):
            if word[a:b] in parts:
                return True
        return False

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, misspelled) of the best entry for a word."""
        if not self.near(word):
            return None
        best: tuple[int, float] | None = None
        automaton = LevenshteinAutomaton(word, self.most)
        stack = [(self.trie, automaton.start())]
        while stack:
            node, state = stack.pop()
            for k in node.get("", ()):
                text, stem, weight = self.entries[k]
                edits = min(d for _, d in state) if stem else next((d for i, d in state if i == len(word)), 99)
                if edits <= edits_for(text, stem) and (best is None or (edits, -abs(weight)) < (best[0], -abs(best[1]))):
                    best = (edits, weight)
            for c, after in node.items():
                if c and (on := automaton.step(state, c)):
                    stack.append((after, on))
        if best is None or (best[0] and word in self.clean):
            return None
        return best[1], best[0] > 0

    def hits(self, text: str) -> tuple[list[tuple[int, int, float, bool, bool]], int]:
        """(place among the words, character, weight, misspelled, quoted) of each hit; number of words."""
        if not self.entries:
            return [], 0
        low = text.lower()
        every = WORD.findall(low)
        words = set(every)
        if len(self.known) > 500_000:
            self.known = {}
        known = self.known
        far = {}
        for w in words:
            if w not in known:
                if len(w) > REMEMBERED:
                    far[w] = self.match(w)
                else:
                    known[w] = self.match(w)
        if far:
            known = {w: known[w] for w in words if w not in far} | far
        if not any(map(known.__getitem__, words)):
            return [], len(every)
        quoted = quotations(low)
        out, q = [], 0
        for place, m in enumerate(WORD.finditer(low)):
            if found := known[m[0]]:
                while q < len(quoted) and quoted[q][1] < m.start():
                    q += 1
                out.append((place, m.start(), *found, q < len(quoted) and quoted[q][0] < m.start()))
        return out, len(every)


def quotations(text: str) -> list[tuple[int, int]]:
    """Places of opening and closing marks of quotations that lie within one line and ``QUOTED`` characters; none overlap."""
    out: list[tuple[int, int]] = []
    open_at: list[int] = []
    for m in QUOTES.finditer(text):
        at, mark = m.start(), m[0]
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        inner, outer = after.strip() != "", before == "" or not before.isalnum()
        opens = mark in CLOSED_BY and inner and outer and (mark not in "\"'" or before.strip() == "" or before in "([{-–—:")
        closes = before.strip() != "" and not after.isalnum()
        while open_at and (at - open_at[0] > QUOTED or "\n" in text[open_at[0] : at]):
            open_at.pop(0)
        first = next((a for a in open_at if mark in CLOSED_BY[text[a]]), None) if closes else None
        if first is not None and at > first + 1:
            out.append((first, at))
            open_at.clear()
        elif opens:
            open_at.append(at)
    return out


def features(hits: list[tuple[int, int, float, bool, bool]], n_words: int) -> tuple[float, ...]:
    """Logarithms of the weights' sums: of telling direct hits; of other direct hits,
    and the same for 100 words; of quoted hits; of misspelled ones; and of the
    number of hits near others."""
    direct = sum(w for _, _, w, wrong, quoted in hits if w > 0 and not wrong and not quoted)
    other = sum(-w for _, _, w, wrong, quoted in hits if w < 0 and not wrong and not quoted)
    quoted = sum(abs(w) for _, _, w, _, quoted in hits if quoted)
    wrong = sum(abs(w) for _, _, w, wrong, quoted in hits if wrong and not quoted)
    near = sum(1 for a, b in zip(hits, hits[1:]) if b[0] - a[0] <= WINDOW and not b[4])
    return math.log1p(direct), math.log1p(other), math.log1p(100 * other / max(1, n_words)), math.log1p(quoted), math.log1p(wrong), math.log1p(near)


def learn_lexicon(toxic: list[set[str]], clean: list[set[str]]) -> list[tuple[str, bool, float]]:
    """Entries from the texts' sets of words, each more frequent in toxic texts
    than chance allows for as many candidates (by a Chernoff bound, half a chance entry in all)."""
    word_in: tuple[Counter, Counter] = (Counter(), Counter())
    stem_in: tuple[Counter, Counter] = (Counter(), Counter())
    mass: Counter = Counter()  # of a stem: words in toxic texts that begin with it
    clean_mass: Counter = Counter()
    n_words = [0, 0]
    for side, texts in enumerate((toxic, clean)):
        for words in texts:
            word_in[side].update(words)
            stems_of = [w[:n] for w in words for n in range(SHORTEST_STEM, min(LONGEST_STEM, len(w)) + 1)]
            stem_in[side].update(set(stems_of))
            (clean_mass if side else mass).update(stems_of)
            n_words[side] += len(words)
    base = len(toxic) / max(1, len(toxic) + len(clean))
    candidates = sum(1 for c in word_in[0].values() if c > 1) + sum(1 for c in stem_in[0].values() if c > 1)

    def gain(a: int, b: int, base: float = base) -> float:
        """Nats by which the share of toxic texts (or words) differs from chance; 0 if it is not far above."""
        share = a / (a + b)
        if share < base + 0.2 * (1 - base):
            return 0.0
        kl = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0.0)
        return (a + b) * kl

    least = math.log(max(2, candidates)) + math.log(2)
    of_words = n_words[0] / max(1, sum(n_words))

    def telling(s: str, a: int, b: int) -> bool:
        """By the texts, or by the different words that begin with it; these come
        several to a text, so they need twice the evidence."""
        return gain(a, b) >= least or gain(mass[s], clean_mass[s], of_words) >= 2 * least

    def weight(a: int, b: int) -> float:
        w = max(0.1, math.log((a + 0.5) / (len(toxic) + 1)) - math.log((b + 0.5) / (len(clean) + 1)))
        return w if b <= TELLING * a else -w

    longer: dict[str, int] = {}
    full: dict[str, int] = {}
    for s, n in mass.items():
        longer[s[:-1]] = max(longer.get(s[:-1], 0), n)
    for w, n in word_in[0].items():
        for k in range(SHORTEST_STEM, min(LONGEST_STEM, len(w)) + 1):
            full[w[:k]] = max(full.get(w[:k], 0), n)
    stems: dict[str, float] = {}
    words: dict[str, float] = {}
    for s, a in sorted(stem_in[0].items(), key=lambda x: (len(x[0]), x[0])):
        b = stem_in[1][s]
        if a < 2 or not telling(s, a, b) or any(s[:n] in stems for n in range(SHORTEST_STEM, len(s))):
            continue
        if longer.get(s, 0) >= 0.95 * mass[s]:  # a longer stem says as much
            continue
        if full.get(s, 0) < 0.8 * mass[s]:
            stems[s] = weight(a, b)
    for w, a in word_in[0].items():
        b = word_in[1][w]
        if a > 1 and gain(a, b) >= least and not any(w[:n] in stems for n in range(SHORTEST_STEM, len(w) + 1)):
            words[w] = weight(a, b)
    entries = [(s, True, x) for s, x in stems.items()] + [(w, False, x) for w, x in words.items()]
    return sorted(entries, key=lambda e: (-abs(e[2]), e[0]))


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None) -> None:
        self.lexicon, self.weights = lexicon, weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([features(*self.lexicon.hits(t or "")) for t in texts]).reshape(len(texts), len(PRIOR) - 1)
        return predict(x, self.weights)


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of each group of equal or near-equal texts: else the words of a text
    that is copied often would look telling. Two of three minima of hashed long
    words in common make a copy."""
    seen: set[tuple[int, str, int]] = set()
    out = []
    for text, y in sorted(set(rows)):
        words = set(WORD.findall(text.lower()))
        long = [w for w in words if len(w) >= 7] or list(words)
        keys = {(i, min(long, key=lambda w: zlib.crc32(w.encode(), i), default=""), y) for i in range(3)}
        if len(keys & seen) < 2:
            out.append((text, y))
        seen |= keys
    return out


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """From (text, label) pairs."""
    rows = without_copies(rows)
    sets = [(set(WORD.findall(t.lower())), y) for t, y in rows]
    if len({y for _, y in sets}) < 2:
        return ToxicityModel(Lexicon([]), None)
    clean = [w for w, y in sets if not y]
    entries = learn_lexicon([w for w, y in sets if y], clean)
    seen = Counter(w for words in clean for w in words)
    lexicon = Lexicon(entries)
    wrong = frozenset(w for w in seen if (m := lexicon.match(w)) and m[1])
    lexicon = Lexicon(entries, wrong)
    x = np.array([features(*lexicon.hits(t)) for t, _ in rows])
    y = np.array([float(y) for _, y in rows])
    return ToxicityModel(lexicon, logistic(x, y, strength=2.0, prior=PRIOR))


def train(docs: DataFrame, labels: DataFrame, wanted: int = 1500, label: str = "toxic", key: str = "doc_id") -> ToxicityModel:
    rows = within_bytes(training_rows(docs.select(key, "text"), labels, label, wanted, key).select("text", "label"), "text")
    return fit([(r["text"] or "", r["label"]) for r in rows.collect()])


def _model(name: str, shared) -> ToxicityModel:
    """The model of a worker, built once for all its tasks."""

    def make() -> ToxicityModel:
        entries, clean, weights = shared.value
        return ToxicityModel(Lexicon(entries, clean), weights)

    return kept(name, make)


def _scorer(spark: SparkSession, model: ToxicityModel):
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((model.lexicon.entries, model.lexicon.clean, model.weights))

    def score(texts: pa.Array) -> np.ndarray:
        own, texts = _model(name, shared), filled(texts)
        parts = [own.score(texts[a:b].to_pylist()) for a, b in slices(texts, 4 << 20)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return score


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, score (0 to 1), predicted (1 if score >= 0.5) of every row, from the text alone."""
    score = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows scored below 0.5, with the columns of ``docs``."""
    score = _scorer(docs.sparkSession, model)
    place = docs.columns.index(text)
    return keep_rows(docs, lambda batch: score(batch.column(place)) < 0.5)
