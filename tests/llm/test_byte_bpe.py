import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from knowloom.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    import numpy as np

    return np.frombuffer(encoder.encode([text])[0], "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text("ab'st .,!\n\t\x1c\x85 ​ é漢1", max_size=60)))
def test_equals_the_ranks_own_library(bpe, own, text):
    encoder = byte_bpe.Encoder(bpe.ranks, bpe.model, bpe.pattern)
    assert ids(encoder, text) == own.encode_ordinary(text)


def test_rows_round_trip(bpe, own, docs_of, words):
    texts = [None, "", " ", "<|endoftext|> is text", "x" * 3000, words(4000), "same", "same", "naïve 🙂 \r\n\x00 ok"]
    docs = docs_of([(k, t) for k, t in enumerate(texts)], ", ids long, IDS_1 long")
    made = bpe.encode(docs)
    assert made.columns == [*docs.columns, "ids_2"]
    rows = {r.doc_id: r for r in bpe.decode(made, ids="ids_2").collect()}
    for k, text in enumerate(texts):
        assert rows[k].ids_2 == own.encode_ordinary(text or "")
        assert bytes(rows[k].decoded) == (text or "").encode()
        assert rows[k].text == text and rows[k].ids == 7


def test_digests_and_empty_table(bpe, own, docs_of):
    row = byte_bpe.digests(bpe.decode(bpe.encode(docs_of([(3, "the end of it")])))).first()
    want = own.encode_ordinary("the end of it")
    assert (row.n_tokens, row.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
    assert row.decoded_sha256 == hashlib.sha256(b"the end of it").hexdigest()
    empty = byte_bpe.digests(bpe.decode(bpe.encode(docs_of([(4, "")])))).first()
    assert empty.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.decode(bpe.encode(docs_of([]))).count() == 0


def test_memory_of_pretokens_changes_nothing(bpe, own, words, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    encoder = byte_bpe.Encoder(bpe.ranks, bpe.model, bpe.pattern)
    for text in (words(50), words(50), words(50)):
        assert ids(encoder, text) == own.encode_ordinary(text)


def test_round_trip_equals_encoding_and_decoding(spark, docs_of):
    from pyspark.sql import functions as F

    bpe = byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    docs = docs_of([(1, "Hello  wörld\n\n東京"), (1, "Hello  wörld\n\n東京"), (2, None), (3, ""), (None, "x" * 9000)], ", ids long, decoded_sha256 string")
    two = bpe.decode(bpe.encode(docs), "ids_1").select(*docs.columns, "ids_1", F.sha2("decoded", 256).alias("decoded_sha256_1"))
    assert sorted(bpe.round_trip(docs).collect(), key=str) == sorted(two.collect(), key=str)
    assert bpe.round_trip(docs_of([])).count() == 0
