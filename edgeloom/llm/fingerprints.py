"""Document fingerprints (I-Match), DataFrame operations only.

A lexicon keeps the terms within a band of document frequency (that is, of
inverse document frequency). A document's distinct terms in the lexicon are
sorted and hashed to one value; so are those in each of ``SUBSETS`` times
``len(DENSITIES)`` random subsets of the lexicon. The subsets overlap; one of density d has each term of
the lexicon with probability 2^-d, by a hash of the term and the subset's number, and
is part of the sparser ones' next denser one. The subsets are the same for every document, and each of a
document's terms in the lexicon is hashed, however many they are: a short document has something in the
dense subsets, a long one still has few terms, which may outlast an edit, in the sparse ones.

A fingerprint is 8 bytes of the hash of all terms, then 2 of each subset's hash (0 for an empty subset,
never for another), shown in hexadecimal digits; between the steps it is kept as bytes.

Two documents are as alike as the share of equal hashes among the subsets of one
density that are not empty in both, at that density where it is greatest; only densities count at which
at least half of the subsets are not empty, and always the greatest density.

How many terms can have a frequency of ``low`` times the documents is bounded
by the mean number of distinct terms of a document divided by ``low``: the
lexicon does not grow with the corpus and is part of the plan as a table.

Defined results: a null text is empty; a text without terms of the lexicon is
fingerprinted by all its terms, and one without terms by itself; equal texts
have equal fingerprints; repeated rows get the same result each; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import cut, ranked
from edgeloom.plans.materialize import free_shuffles

SUBSETS = 16
DENSITIES = (1, 3, 5, 7, 9, 11)
BYTES = 2


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


class Lexicon:
    """Hashes of the band's terms as a table of buckets with ``PLACES`` places each."""

    PLACES = 8

    def __init__(self, hashes: list[int]) -> None:
        self.size = len(hashes)
        self.buckets = 1024
        while True:
            full = [[] for _ in range(self.buckets)]
            for h in hashes:
                full[self._bucket(h)].append(self._value(h))
            if max(map(len, full)) <= self.PLACES:
                break
            self.buckets *= 2
        self.table = ",".join(str(v) for b in full for v in (sorted(set(b)) + [0] * self.PLACES)[: self.PLACES])

    def _bucket(self, h: int) -> int:
        return (h & (1 << 64) - 1) >> 40 & self.buckets - 1

    @staticmethod
    def _value(h: int) -> int:
        low = h & 0xFFFFFFFF
        return (low - (1 << 32) if low >> 31 else low) or 1

    def has(self, h: Column) -> Column:
        """Whether a hash is in the table (by its place and low 32 bits)."""
        places = F.split(F.lit(self.table), ",").cast("array<int>")
        at = (F.shiftrightunsigned(h, 40).bitwiseAND(self.buckets - 1) * self.PLACES + 1).cast("int")
        low = h.bitwiseAND(0xFFFFFFFF)
        value = F.when(low == 0, F.lit(1)).when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low).cast("int")
        return F.array_contains(F.slice(places, at, self.PLACES), value)


def fit_lexicon(docs: DataFrame, low: float = 0.002, high: float = 0.1, text: str = "text") -> Lexicon:
    """Terms found in at least ``low`` (and two) and at most ``high`` (but not under two) of the documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("h")).groupBy("h").count()
    band = counts.filter((F.col("count") >= max(2.0, low * n)) & (F.col("count") <= max(2.0, high * n)))
    return Lexicon([r["h"] for r in band.select("h").collect()])


def _hex(x: Column, digits: int) -> Column:
    return F.right(F.concat(F.lit("0" * digits), F.hex(x)), F.lit(digits))


def shown(fingerprint: Column) -> Column:
    return F.lower(F.hex(fingerprint))


def with_fingerprint(docs: DataFrame, lexicon: Lexicon, text: str, out: str) -> DataFrame:
    """Adds ``out``, the fingerprint of ``text`` (not null) as bytes."""
    rows = docs.withColumn("_all", terms(F.col(text)))
    rows = rows.withColumn("_own", F.filter("_all", lexicon.has))
    rows = rows.withColumn("_own", F.sort_array(F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_all"))))
    # a number for each term and subset, whose low bits say up to which density it is in
    numbers = lambda r: F.transform("_own", lambda h: F.xxhash64(h, r))
    rows = rows.withColumn("_in", F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), lambda r: F.filter(numbers(r), lambda g: g.bitwiseAND((1 << DENSITIES[0]) - 1) == 0)))
    digits = 2 * BYTES
    short = lambda a: F.greatest(F.xxhash64(a).bitwiseAND((1 << 8 * BYTES) - 1), F.lit(1))
    for k, d in enumerate(DENSITIES):
        if k:
            keep = (1 << d) - 1
            rows = rows.withColumn("_in", F.transform("_in", lambda a: F.filter(a, lambda g: g.bitwiseAND(keep) == 0)))  # noqa: B023
        rows = rows.withColumn(f"_{d}", F.array_join(F.transform("_in", lambda a: F.when(F.size(a) == 0, F.lit("0" * digits)).otherwise(_hex(short(a), digits))), ""))
    whole = F.when(F.size("_all") > 0, F.xxhash64("_own")).otherwise(F.xxhash64(F.lit("text"), F.col(text)))
    made = F.unhex(F.concat(_hex(whole, 16), *(f"_{d}" for d in DENSITIES)))
    # a generated column is evaluated once and never put into the functions that read it
    return rows.select(*docs.columns, F.explode(F.array(made)).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The greatest share of equal subset hashes at one density; 1 for equal fingerprints (as bytes)."""
    digits, none = 2 * BYTES, "0" * (2 * BYTES)
    parts = lambda x: F.regexp_extract_all(F.hex(x), F.lit("." * digits), F.lit(0))
    zipped = F.arrays_zip(parts(a).alias("l"), parts(b).alias("r"))

    def share(i: int) -> Column:
        pairs = F.slice(zipped, 16 // digits + 1 + i * SUBSETS, SUBSETS)
        some = F.filter(pairs, lambda z: (z["l"] != none) | (z["r"] != none))
        same = F.size(F.filter(some, lambda z: z["l"] == z["r"]))
        return F.when(F.size(some) >= (SUBSETS // 2 if i else 1), same / F.size(some)).otherwise(F.lit(0.0))

    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*(share(i) for i in range(len(DENSITIES)))))


def fingerprints(docs: DataFrame, lexicon: Lexicon | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, fingerprint of every row."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_fingerprint(rows, lexicon or fit_lexicon(rows), "text", "_f").select(key, shown(F.col("_f")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """How fingerprints stand an edit: in each text the last quarter is replaced
    by the beginning of the next document's (ascending ``key``, then text hash).

    Only keys, lengths and fingerprints are put in order; texts are dealt out
    once by their key, and the beginnings once more. Rows equal in key and
    text count as one document in the order; null keys are equal and a key of
    their own: within a struct they can be joined and grouped by alike, so that what is grouped need not be dealt out again.
    """
    base = docs.select(F.struct(F.col(key).alias("key")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lexicon = fit_lexicon(base)
    base = base.withColumn("h", F.xxhash64("text"))
    own = with_fingerprint(base, lexicon, "text", "fingerprint")
    own = cut(own.groupBy("id", "h").agg(F.max(F.length("text")).alias("n"), F.max("fingerprint").alias("fingerprint")), "fingerprints")
    free_shuffles(docs.sparkSession)  # the terms' and the fingerprints', before the texts are dealt out
    order = ranked(own.select("id", "h", "n"), ["id", "h"], "fingerprint-order")
    n = own.count()
    if n:
        before = order.select(F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("take"), F.pmod(F.col("rank") + 1, F.lit(n)).alias("rank"))
        links = order.join(before, "rank").join(own.select("id", "h", "fingerprint"), ["id", "h"])
    else:
        links = own.selectExpr("id", "h", "fingerprint", "id AS to_id", "h AS to_h", "0 AS take")
    links = cut(links.select("id", "h", "to_id", "to_h", "take", F.col("fingerprint").alias("next_fingerprint")), "fingerprint-links")
    heads = (
        base.join(links, ["id", "h"])
        .groupBy(F.col("to_id").alias("id"), F.col("to_h").alias("h"))
        .agg(F.max(F.substr("text", F.lit(1), F.col("take"))).alias("head"), F.max("next_fingerprint").alias("next_fingerprint"))
    )
    rows = base.join(own, ["id", "h"]).join(heads, ["id", "h"])
    kept = (F.col("n") - F.floor(F.col("n") / 4)).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), kept), "head"))
    rows = with_fingerprint(rows, lexicon, "edited", "edited_fingerprint")
    return rows.select(
        F.col("id.key").alias(key),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("fingerprint")).alias("fingerprint"),
        shown(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
