import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import bytewords, common
from edgeloom.llm import packed_ids as P
from edgeloom.llm import sentencepieces, toxicity, word_cache
from edgeloom.llm.sentencepieces import PieceCache, Pieces
from edgeloom.llm.token_counts import token_counts
from edgeloom.llm.word_cache import WordCache

TEXTS = [
    None, "", " ", "a", "a  b", " a b ", "don't stop.\nNow, it's  fine\n\n x", "x<|endoftext|>y <|endoftext|> z",
    "tab\tand space   wide", "Étion dans, çouelle!!\nun éonierç...", "\n\nA\n b \n", "日本語 テスト 123 45a6 _x_ __",
    "word, " * 3000, "ab\x1c c \x85 d", "!!! *** &&& a*** b&&&\n*** c", "The and. " * 40 + "\n" + "x" * 5000, "the\n\nthe \nof",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(4)


def library(name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_equal_the_library(spark, docs):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = sorted((i * 3, len(library(name).encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)) + [(3, 0)]
        got = token_counts(docs, public_tokenizers.path(name), 512).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(want)
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    sized = {r.doc_id: r.n_bytes for r in got}
    assert all(sized[i * 3] == len((t or "").encode()) for i, t in enumerate(TEXTS))


def test_counts_of_an_empty_table_and_sentencepiece(spark, docs):
    assert token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 1).collect() == []
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), 1).collect()}
    assert got == {i * 3: len(model.encode(t or "")) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32, 33, 40])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        data = P.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (P.unpack(data, n, bits) == ids).all()


def test_files_round_trip(spark, docs):
    got = P.token_file_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    tok, at, want = library(), 0, []
    for i, t in sorted([(i * 3, t or "") for i, t in enumerate(TEXTS)] + [(3, "")]):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    empty = P.token_file_round_trip(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert empty.collect() == []


def test_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_257, n, dtype=np.uint32) for n in (5, 0, 70_000, 3, 140_000, 1)]
    with open(tmp_path / "x.tok", "wb") as out:
        w = P.ShardWriter(out, 16)
        for k, ids in enumerate(docs):
            w.add(k * 7, ids)
        w.close()
    r = P.ShardReader(f"file://{tmp_path}/x.tok")
    every = np.concatenate(docs)
    assert (r.ids(65_000, 66_000) == every[65_000:66_000]).all()
    for k, ids in enumerate(docs):
        assert (r.document(k) == ids).all()
    assert [(k, s, list(x[:3])) for k, s, x in r.documents(1000)] == [(k * 7, sum(map(len, docs[:k])), list(x[:3])) for k, x in enumerate(docs)]


def test_whole_table(spark):
    from edgeloom.llm.queries import op2_token_output, op6_token_counts

    d = "/root/testdata/sf0.001"
    tok = library()
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    n = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    assert {r.doc_id: r.n_tokens for r in op6_token_counts(spark, d).collect()} == n
    out = op2_token_output(spark, d)
    assert {r.doc_id: r.n_tokens - 1 for r in out.collect()} == n
    assert out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(n.values()) + len(n)


def odd_texts(n, seed):
    rng = random.Random(seed)
    chars = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", " ", "​", "a", "B", "é", "à", "ß", "日", "本", "😀", "'", "'s", "1", "23", ".", "_", "▁", "<|endoftext|>", "the", "The", "word"]
    return ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [" ".join(rng.choice(["the", "word", "café", "x\ny"]) for _ in range(2000))]


def test_parts_equal_the_library_on_odd_texts():
    texts = odd_texts(4000, 1)
    array = pa.array(texts)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = [x.ids for x in library(name).encode_batch_fast(texts, add_special_tokens=False)]
        cache, counts = (WordCache(public_tokenizers.path(name), count) for count in (False, True))
        for at, end in ((0, 1500), (1500, len(texts)), (0, len(texts))):  # cold, then known
            ids, offsets = cache.encode(array, at, end)
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[at:end]
            assert counts.counts(array, at, end).tolist() == list(map(len, want[at:end]))


def test_a_small_memory_gives_the_same(monkeypatch):
    for name, value in (("PLACE_BITS", 2), ("POOL", 64), ("CHUNK", 50), ("LONGEST", 6)):
        monkeypatch.setattr(word_cache, name, value)
    texts = odd_texts(500, 2)
    want = [x.ids for x in library().encode_batch_fast(texts, add_special_tokens=False)]
    cache = WordCache(public_tokenizers.path("byte_bpe_50k.json"), False)
    ids, offsets = cache.encode(pa.array(texts), 0, len(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_null_keys_come_first_and_ids_must_fit(spark, tmp_path):
    df = spark.createDataFrame([(5, "b c"), (None, "a"), (None, None), (-3, "d")], "doc_id long, text string")
    got = P.token_file_round_trip(df, public_tokenizers.path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 5] and sorted(r.n_tokens for r in got[:2]) == [1, 2]
    with open(tmp_path / "x", "wb") as out, pytest.raises(ValueError):
        P.ShardWriter(out, 4).add(1, np.array([16], np.uint32))


def handmade(kind, byte_fallback):
    """A model made up by hand: pieces with scores, no training."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = byte_fallback
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256) if byte_fallback]
    rng = random.Random(kind)
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "▁▁", "cab", "é", "▁b"]
    rows += [(w, -float(i) if kind == 2 else round(-rng.uniform(1, 9), 2), 1) for i, w in enumerate(words)]
    for piece, score, of in rows:
        p = model.pieces.add()
        p.piece, p.score, p.type = piece, score, of
    return model.SerializeToString()


@pytest.mark.parametrize("kind, fallback", [(1, False), (1, True), (2, False), (2, True)])
def test_handmade_models_equal_the_library(kind, fallback):
    import sentencepiece

    data = handmade(kind, fallback)
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    cache = PieceCache(Pieces(data=data))
    rng = random.Random(9)
    texts = ["".join(rng.choice("aaabbbccc  é日xy\n") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    ids, offsets = cache.encode(pa.array(texts), 0, len(texts))
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == lib.encode(t), t
        assert cache.pieces.decode(ids[a:b]) == lib.decode(lib.encode(t)), t


def test_pieces_of_odd_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, cache = sentencepiece.SentencePieceProcessor(model_file=path), PieceCache(Pieces(path))
    texts = odd_texts(3000, 4)
    ids, offsets = cache.encode(pa.array(texts), 0, len(texts))
    same = cache.pieces.restored(ids, offsets, pa.array(texts), 0)
    for t, a, b, s in zip(texts, offsets, offsets[1:], same):
        assert ids[a:b].tolist() == lib.encode(t), t
        assert s == (cache.pieces.decode(ids[a:b]) == t), t


def test_a_worker_keeps_one_model_and_needs_little_beside_it():
    import tracemalloc

    class Shared:
        value = ([("bad", False, 1.0)], frozenset(), np.zeros(7))

    path = public_tokenizers.path("piece_bpe_32k.model")
    first = toxicity._model("one", Shared)
    assert toxicity._model("one", Shared) is first
    gone = weakref.ref(first)
    del first
    model = sentencepieces.load(path)
    assert gone() is None and sentencepieces.load(path) is model
    texts = pa.array([f"{i} " + "some words of a text " * 500 for i in range(400)])  # about 4 MB
    model.encode(texts, 0, 1)
    tracemalloc.start()
    n = sum(batch.num_rows for batch in sentencepieces.encoded(model, pa.array(range(400)), texts, True))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 and most < 60e6


def test_token_files_take_little_memory_and_leave_no_encoder():
    import tracemalloc

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.array([f"{i} " + "some words of a text " * 500 for i in range(400)])  # about 4 MB
    P._encode(path, texts, 0, 1)
    gone = weakref.ref(next(iter(common._kept.values())))
    tracemalloc.start()
    n = sum(len(P._encode(path, texts, at, end)[1]) - 1 for at, end in bytewords.slices(texts, P.ENCODED))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 and most < 40e6
    common.kept("another", lambda: None)  # as a reader's task does
    assert gone() is None
