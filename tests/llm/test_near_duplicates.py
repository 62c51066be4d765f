import random

import numpy as np
import pyarrow as pa
import pytest

from edgeloom.llm import near_duplicates as N
from edgeloom.llm.bytewords import Words
from edgeloom.llm.components import components

WEIRD = [(1, None), (2, ""), (3, "!!"), (4, "One two three"), (4, "One two three"), (5, "word " * 30_000), (6, "héllo wörld 日本")]


def classes(df):
    return {r.doc_id: r.class_id for r in N.near_duplicate_classes(df).collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sketched(texts):
    return N.Sketched(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_defined_results(spark):
    base = [f"w{i}" for i in range(100)]
    near = base[:50] + ["other"] + base[51:]
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (13, " ".join(f"z{i}" for i in range(100)))]
    docs = table(spark, WEIRD + rows).selectExpr("*", "'x' AS class_id", "1 AS keep", "2 AS t")  # names that clash
    assert classes(docs) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 10: 10, 11: 10, 12: 10, 13: 13}
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 10, 13]
    assert [tuple(r) for r in N.near_duplicate_links(docs).collect()] == [(10, 11)]
    assert N.near_duplicate_classes(docs.limit(0)).collect() == [] and N.one_of_each(docs.limit(0)).collect() == []


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (None, c), (None, c), (None, a), (4, None), (5, "")]
    df = table(spark, rows)
    got = sorted(((r.doc_id or 0, r.class_id, r.keep) for r in N.near_duplicate_classes(df).collect()), key=str)
    assert [x[:2] for x in got] == [(0, 1), (0, None), (0, None), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert sum(k for *_, k in got) == 4  # one row each of a, b, c and the empty text
    kept = sorted((r.doc_id or 0, r.text or "") for r in N.one_of_each(df).collect())
    assert kept == [(0, c), (1, a), (1, b), (4, "")]


def test_one_side_repeats_a_k_mer():
    base = [f"w{i}" for i in range(200)]
    s = sketched([np.array([hash(w) & (1 << 63) - 1 for w in x], np.uint64) for x in (base, base + base[:5])])
    assert len(np.intersect1d(*s.keys)) > 40


def test_order_of_the_text_counts():
    words = np.random.default_rng(0).integers(0, 1 << 63, 200).astype(np.uint64)
    parts = words.reshape(10, 20)
    s = sketched([words, parts[::-1].reshape(-1)])  # nearly the same k-mers, other order
    assert len(np.intersect1d(*s.keys)) < N.SKETCHES // 2


@pytest.mark.parametrize("n", range(5, 20))
def test_short_texts_that_are_near_always_meet(n):
    rng = random.Random(n)
    for _ in range(100):
        a = [rng.randrange(1 << 32) for _ in range(n)]
        b, most = list(a), n // 5
        for _ in range(most):
            kind, at = rng.randrange(3), rng.randrange(len(b))
            if kind == 0:
                b[at] = rng.randrange(1 << 32)
            elif kind == 1 or len(b) == N.short_limit(0.8):
                del b[at]
            else:
                b.insert(at, rng.randrange(1 << 32))
        if distance(a, b) <= max(len(a), len(b)) // 5:
            assert len(np.intersect1d(*(N.short_keys(np.array(t, "uint64"), 0.8) for t in (a, b))))


def test_sketches_do_not_depend_on_the_neighbours():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n).astype(np.uint64) for n in (0, 1, 4, 30, 0, 74, 75, 300)]
    whole = sketched(texts)
    for k, t in enumerate(texts):
        one = sketched([t])
        assert (one.keys[0] == whole.keys[k]).all() and (one.signature[0] == whole.signature[k]).all()


def test_every_link_of_a_table(spark):
    """Against all pairs of sf0.01: same components; and the tests before alignment pass every near pair."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    w = Words(pa.array(list(first)), 0, len(first))
    ids, own = list(first.values()), [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
    s = N.Sketched(w.hash, w.first)
    up = {i: i for i in ids}

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if most and abs(len(a) - len(b)) <= most and N._bag_distance(a, b) <= most and N.banded_distance(a.tolist(), b.tolist(), most) is not None:
                x, y = (z[: N.PARITIES].view(np.uint64) for z in (s.signature[i], s.signature[j]))
                assert int(np.bitwise_count(x ^ y).sum()) <= 2 * most
                x, y = find(ids[i]), find(ids[j])
                up[max(x, y)] = min(x, y)
    assert classes(docs) == {i: find(first[t]) for i, t in rows}


def test_a_source_and_its_edited_copies(spark):
    """Copies of 0.88 likeness to a source; most are not near to each other."""
    rng = random.Random(5)
    source = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(source))]
    for i in range(1, 1001):
        words = list(source)
        for j in rng.sample(range(200), 24):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    # a template with two blanks of 30 words in 120: near only where one blank is equal
    fill = {b: [f"{b}y{j}" for j in range(30)] for b in range(40)}
    common = [f"t{i}" for i in range(70)]
    for i in range(20):
        for k in (0, 1):
            text = common[:35] + fill[i] + common[35:] + [f"o{i}{k}y{j}" for j in range(5)]
            rows.append((2000 + 2 * i + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(docs).collect()}
    assert {got[i] for i in range(1001)} == {0}
    assert all(got[i] == i // 2 * 2 for i in range(2000, 2040))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in edges:
        if a != b:
            up[find(a)] = find(b)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node for r in rows} == set(up) and len(rows) == len(up)
    assert len({(find(r.node), r.label) for r in rows}) == len({find(x) for x in up}) == len({r.label for r in rows})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_counts_tell_apart_what_parities_do_not(spark):
    """Words that one text has three times and the other once, or twice and not at all."""
    shared, p, q = ([f"{x}{i}" for i in range(n)] for x, n in (("s", 60), ("p", 40), ("q", 40)))
    near = shared + p * 3
    texts = [" ".join(t) for t in (near, shared + p + q * 2, near[:-30], near[:-37])]
    w = Words(pa.array(texts), 0, len(texts))
    s = N.Sketched(w.hash, w.first)
    rows = [(i, int(n), [int(x) for x in sig]) for i, (n, sig) in enumerate(zip(s.n_words, s.signature, strict=True))]
    df = spark.createDataFrame(rows, "i int, n_words int, signature array<long>")
    of = lambda c: df.select(N.F.col("i").alias(f"{c}_i"), N.F.struct(*N.traits()).alias(c))
    passed = {(r.a_i, r.b_i) for r in of("a").crossJoin(of("b")).filter("a_i < b_i").filter(N.may_be_near("a", "b", 0.8)).collect()}
    assert passed == {(0, 2), (2, 3)}  # 30 and 7 of at most 36 and 30; 37 are too many


def test_a_line_that_fills_many_texts(spark, monkeypatch):
    """Texts that are mostly one line: many buckets in common, few near pairs, all of which come from the second round."""
    rng = random.Random(3)
    texts = ["is onhe " * 90 + " ".join(f"o{rng.randrange(400)}" for _ in range(rng.randrange(36, 60))) for _ in range(60)]
    texts += [" ".join(t.split()[:-4] + ["z", "y"]) for t in texts[:5]]
    own = [t.split() for t in texts]
    up = list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if N.banded_distance(a, b, most) is not None:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(texts))}
    monkeypatch.setattr(N._Found, "_pivot_pairs", staticmethod(lambda met, texts, similarity: texts.sparkSession.createDataFrame([], "a long, b long")))  # all is left to the second round
    assert classes(table(spark, list(enumerate(texts)))) == want and len(set(want.values())) < len(texts)


def test_components_end_in_one_task(spark):
    """By rounds, after some rounds and at once: the same groups."""
    rng = random.Random(4)
    edges = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(400)]
    df = spark.createDataFrame(edges, "a long, b long")
    told = []
    for most in (0, 100, 10_000):
        groups = {}
        for r in components(df, one_task=most).collect():
            groups.setdefault(r.label, set()).add(r.node)
        assert all(label in group for label, group in groups.items())
        told.append(sorted(map(sorted, groups.values())))
    assert told[0] == told[1] == told[2]
