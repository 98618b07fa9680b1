"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from pqledger.llm import pieces

DOCS = "doc_id long, text string, ids string, decoded string, n_differ string"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "\x00", "▁", "▁ ▁a▁", "<s>", "<0x41>", "</s> <unk>", "日本 😀 x́", "    def f(x):\n        return 1", "ab" * 3000, "  \xa0", "é" * 50, "x" * 40000,
]


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_segments_match_library_alone(own):
    """The agenda by itself, not what encode() returns after its check."""
    rng = random.Random(3)
    some = [" " * rng.randrange(4) + "".join(rng.choice("abcdeinrst.,'-ßé日1 2\n") for _ in range(rng.randrange(40))) for _ in range(3000)]
    some = [s for s in some if s]
    assert [own.segment(s) for s in some] == own.bare.encode(some)


def test_texts_match_library(own, library):
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice(" ▁aeo\nßé日<>012\t") for _ in range(rng.randrange(200))) for _ in range(400))]
    ids, differ = own.encode(pa.array(texts, pa.string()))
    assert not differ.any()
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    assert [x.tolist() for x in ids] == want
    assert [own.decode(x) for x in want] == [library.decode(x) for x in want]


def test_any_ids_decode_like_library(own, library):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259), 28705, 259]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_a_full_cache_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    texts = pa.array([f"some words {i} and more of {i % 7}" for i in range(60)])
    one = [own.encode(texts.slice(i, 4))[0] for i in range(0, 60, 4)]
    assert [x.tolist() for part in one for x in part] == own.library.encode(texts.to_pylist(), add_bos=True, add_eos=True)


def test_digest(spark, library):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(None, "same text", "x", "y", "z")] * 2
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, pieces.piece_digest(df).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), 0))
    assert got == sorted(want, key=str)
    full = {r.doc_id: r for r in pieces.encoded(df.where("doc_id < 16")).collect()}
    assert full[4].ids == library.encode("a", add_bos=True, add_eos=True) and full[4].decoded == "a" and full[0].ids == [1, 2]
    assert pieces.piece_digest(df.limit(0)).count() == 0


def test_query_on_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op12_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, t in docs:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(pieces.default_model(), "rb").read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    (tmp_path / "u.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "u.model"))
