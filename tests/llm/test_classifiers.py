import random
import zlib

import numpy as np
import pytest

from edgeloom.llm import language_id, quality, toxicity
from edgeloom.llm.common import training_rows, within_bytes


def spans(text):
    return [text[a : b + 1] for a, b in toxicity.quotations(text)]


def test_quotations():
    assert spans('he said "you idiot" and left') == ['"you idiot"']
    assert spans('5" pipe, you idiot, "hello" there') == ['"hello"']
    assert spans("it's a 'poor clown' who can't") == ["'poor clown'"]
    assert spans("»ein Wort« und „noch eins“, « un autre »") == ["»ein Wort«", "„noch eins“"]
    assert spans('"no end\nin this line"') == [] and spans('one " mark') == [] and spans('"') == []
    assert spans('"' + "x" * 400 + '"') == [] and spans('"a" "b"') == ['"a"', '"b"']
    assert spans("“outer ‘inner’ end”") in (["“outer ‘inner’ end”"], ["‘inner’"])


def toy():
    lexicon = toxicity.Lexicon([("idiot", False, 3.0), ("clown", False, 3.0), ("disgusting", False, 3.0), ("scumm", True, 3.0)])
    return toxicity.ToxicityModel(lexicon, toxicity.PRIOR.copy())


def test_quoted_and_direct_hits():
    m = toy()
    direct, stray, quoted, wrong, clean = m.score(["you idiot, you clown", '5" pipe, you idiot, you clown, "hello"', 'they wrote "idiot" and "clown" there', "you idi0t, you cl0wn", "hello"])
    assert direct == stray > 0.5 and direct > wrong > clean and quoted < 0.5


def test_long_words_and_empty_texts():
    m = toy()
    assert m.lexicon.match("scumm" + "x" * 500) == (3.0, False)
    low = m.score(["", None, "..."])
    assert low[0] == low[1] == low[2] < 0.5 and m.score(["a " + "scumm" + "y" * 300])[0] > low[0]


def test_match_against_all_entries():
    rng = random.Random(4)
    entries = [("".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))), rng.random() < 0.2, 1.0 + k / 100) for k in range(60)]
    entries = list({e[0]: e for e in entries}.values())
    lexicon = toxicity.Lexicon(entries)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(1500):
        word = list(rng.choice(entries)[0])
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word))] = rng.choice(["", "a", "b", "xy"])
        word = "".join(word) or "a"
        found = [(0 if word.startswith(t) else 99, -w) if stem else (distance(t, word), -w) for t, stem, w in entries]
        found = [(d, w) for (d, w), (t, stem, _) in zip(found, entries) if d <= toxicity.edits_for(t, stem)]
        want = (-min(found)[1], min(found)[0] > 0) if found else None
        assert lexicon.match(word) == want, word


def test_few_texts_with_many_words_of_a_stem():
    rng = random.Random(1)
    other = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9))) for _ in range(80))
    rows = [(other() + " " + " ".join(f"vrokk{c}{k}" for c in "abcdefgh"), 1) for k in range(3)] + [(other(), 0) for _ in range(120)]
    m = toxicity.fit(rows)
    assert m.score([other() + " vrokkzz vrokkzy vrokkxx vrokkq vrokkr"])[0] > 0.5 and (m.score([other() for _ in range(20)]) < 0.5).all()


@pytest.fixture(scope="module")
def labelled(spark):
    """60 documents of two kinds; the labels of held-out ones are all wrong."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(60):
        bad = i % 2
        word = lambda: "".join(rng.choice("xyzwq" if bad else "aeiolmnst") for _ in range(5))  # noqa: B023, E731
        docs.append((i, " ".join(word() for _ in range(40)), "xx" if bad else "aa", "s", 1))
        wrong = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, 1 - bad if not wrong else bad, bad if not wrong else 1 - bad))
    docs += [(i, None, "xx", None, None) for i in (60, 61)] + [(1, docs[1][1], "xx", "s", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_not_learned_from(labelled):
    docs, labels = labelled
    used = {r.doc_id for r in training_rows(docs, labels, "toxic", 100).collect()}
    assert used and all(zlib.crc32(str(i).encode()) % 5 for i in used)
    some = training_rows(docs.filter("doc_id < 60").dropDuplicates(["doc_id"]), labels, "toxic", 100)
    assert within_bytes(some, "text", 1 << 30).count() == some.count() and 0 < within_bytes(some, "text", 4000).count() < some.count()
    got = {r.doc_id: r.keep for r in quality.quality(docs, quality.train(docs, labels)).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(60)) and 60 in got
    kept = quality.without_poor(docs, quality.train(docs, labels, rounds=0))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {60, 61} == set(range(0, 60, 2))


def test_languages(labelled):
    docs, _ = labelled
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == 63 and all(r.lang_pred == ("und" if r.doc_id > 59 else "xx" if r.doc_id % 2 else "aa") and 0 <= r.score <= 1 for r in got)
    many = docs.selectExpr("doc_id", "text", "concat('l', doc_id % 20) AS lang")
    assert len(language_id.train(many, per_language=1).languages) == 20  # each language is learned, whatever the bound


def test_kernel_against_sets():
    """The matrix product equals the kernel of sets of n-grams (places)."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc de") for _ in range(60)) for _ in range(30)]
    rows = [(language_id.presence(t, 3), "a" if k % 2 else "b") for k, t in enumerate(texts)]
    model = language_id.fit(rows, 3, 10, 1.0)
    chosen = [p for p, _ in rows[:10]]
    kernel = lambda x, y: len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))
    k = np.array([[kernel(p, q) for q in chosen] for p, _ in rows])
    y = np.array([[1.0, -1.0] if lang == "a" else [-1.0, 1.0] for _, lang in rows])
    gram = np.array([[kernel(p, q) for q in chosen] for p in chosen])
    alpha = np.linalg.solve(k.T @ k + gram + 1e-6 * np.eye(10), k.T @ y)
    want = (k @ alpha).argmax(1)
    names, _ = model.predict(texts)
    assert [model.languages[w] for w in want] == names


def test_exchange_teaches_the_other_view():
    """Few labels, a metadata view that knows well, a text view that needs many examples."""
    rng = np.random.default_rng(0)

    def rows(n):
        y = rng.integers(0, 2, n).astype(float)
        return rng.normal(0, 1, (n, 60)) + 0.15 * (2 * y[:, None] - 1), np.column_stack([y + rng.normal(0, 0.1, n), rng.normal(0, 1, n)]), y

    (x, m, y), (px, pm, _), (tx, tm, ty) = rows(40), rows(2000), rows(2000)
    right = {}
    for rounds in (0, quality.ROUNDS):
        model = quality.co_train(x, m, y, px, pm, rounds)
        right[rounds] = ((model.score(tx, tm)[1] >= 0.5) == ty).mean()
    assert right[quality.ROUNDS] > right[0] + 0.01, right
    # a metadata view that knows nothing gives no labels away
    noise = [rng.normal(0, 1, (len(a), 2)) for a in (x, px)]
    with_noise = quality.co_train(x, noise[0], y, px, noise[1])
    assert (((with_noise.score(tx, rng.normal(0, 1, (len(tx), 2)))[1]) >= 0.5) == ty).mean() > right[0] - 0.03
