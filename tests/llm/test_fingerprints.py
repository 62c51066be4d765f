import hashlib
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from edgeloom.llm import fingerprints as P


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(values):
    """Spark's xxhash64 of strings, longs and (as a tuple) ints, one after another."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little") if isinstance(v, tuple) else (v & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def hexed(x, digits):
    return f"{x & (1 << 64) - 1:016x}"[-digits:]


def terms(text):
    return list(dict.fromkeys(xx([w]) for w in re.split(r"[\W_]+", text.lower()) if w))


def fingerprint(text, lexicon):
    every = terms(text)
    own = sorted(t for t in every if t in lexicon) or sorted(every)
    out = [hexed(xx(own) if every else xx(["text", text]), 16)]
    numbers = [[xx([t, (r,)]) for t in own] for r in range(1, P.SUBSETS + 1)]
    for d in P.DENSITIES:
        subsets = [[n for n in row if n & (1 << d) - 1 == 0] for row in numbers]
        out += [f"{xx(s) & 0xFFFF or 1:04x}" if s else "0000" for s in subsets]
    return "".join(out)


def likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for k in range(len(P.DENSITIES)):
        at = [16 + 4 * (k * P.SUBSETS + r) for r in range(P.SUBSETS)]
        pairs = [(a[i : i + 4], b[i : i + 4]) for i in at if a[i : i + 4] + b[i : i + 4] != "0" * 8]
        if len(pairs) >= (P.SUBSETS // 2 if k else 1):
            best = max(best, sum(p == q for p, q in pairs) / len(pairs))
    return best


def test_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    found = Counter(t for _, text in rows for t in terms(text))
    n = len(rows)
    lexicon = {t for t, c in found.items() if max(2.0, 0.002 * n) <= c <= max(2.0, 0.1 * n)}
    got = {r.doc_id: r for r in P.edited_fingerprints(docs).collect()}
    assert len(got) == n
    nearer = 0
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % n][1]
        take = len(text) // 4
        edited = text[: len(text) - take] + following[:take]
        own, other = fingerprint(text, lexicon), fingerprint(edited, lexicon)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, other), i
        assert abs(r.near_edited - likeness(own, other)) < 1e-12 and abs(r.near_next - likeness(own, fingerprint(following, lexicon))) < 1e-12
        nearer += r.near_edited > r.near_next
    assert nearer >= 0.97 * n


def test_long_texts_use_all_their_terms(spark):
    """One term of 3000 changed: another fingerprint, but nearly the same hashes."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["z0"])), (3, " ".join(f"z{i}" for i in range(3000))), (4, "w2999 y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b, c, _ = (r.fingerprint for r in P.fingerprints(df).orderBy("doc_id").collect())
    assert a != b and a[:16] != b[:16]
    near = spark.range(1).select(P.likeness(F.unhex(F.lit(a)), F.unhex(F.lit(b))).alias("x"), P.likeness(F.unhex(F.lit(a)), F.unhex(F.lit(c))).alias("y")).first()
    assert near.x > 0.9 and near.y < 0.1


def test_edits_deal_out_texts_and_beginnings_once(spark):
    """Texts for each of their two joins and the beginnings are dealt out, nothing twice; null and repeated keys keep their rows."""
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "i j k l"), (None, "m n o p q"), (2, None)]
    got = P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)
    assert len(dealt) == 2, plan  # beginnings and texts; the small tables are broadcast
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda r: (r[0], r[1], signed(xxhash.xxh64_intdigest(r[2].encode(), 42))))
    want = []
    for i, t in rows:
        text = t or ""
        following = order[(order.index((i is not None, i or 0, text)) + 1) % len(order)][2]
        take = len(text) // 4
        want.append((i, hashlib.sha256((text[: len(text) - take] + following[:take]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.edited_sha256) for r in got.collect()) == Counter(want)
