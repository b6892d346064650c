import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from knowloom.llm import wavelet_shards as ws

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_rank_select_access(n):
    x = np.random.default_rng(n).integers(0, 300, n)
    w = ws.WaveletMatrix.build(x, 9)
    assert (w.ids() == x).all() and [w.access(i) for i in range(0, n, 17)] == x[::17].tolist()
    for t in (0, 5, 77, 299, 511, 512, -1):
        places = np.flatnonzero(x == t)
        assert w.count(t) == len(places) and w.count(t, n // 2) == (places < n // 2).sum()
        assert [w.select(t, k) for k in range(len(places))] == places.tolist()
        with pytest.raises(IndexError):
            w.select(t, len(places))
    with pytest.raises(IndexError):
        w.access(n)


def test_chunks_encode_as_whole_texts(tokenizer, words):
    encoder = ws.ChunkEncoder(PATH)
    odd = ["A. b,c!? It's  can't. x\x1cy z\x85w", "É́ é ́a İstanbul ΑΣ. ΑΣ, <|endoftext|> a<|startoftext|>b", "!!a!! b.!, c.. 12. 3,4 é. it's. 's. don't, we'll!", "", " ", "a 　b", "Ünïcödé straße ŉ Ǆ ÅNGSTRÖM. ﬁ ß. İx. ı", "x. x", ". . ,", "ab! ab? Ab",  words(3000), words(500) + "."]
    for text in odd:
        assert np.frombuffer(encoder.encode(pa.array([text]))[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("abAB'sé. ,!?\n\x1c\x85\xa0\u0130\u0301ΣσςßǅŉD12", max_size=50)))
def test_any_text_encodes_as_the_library_does(tokenizer, text):
    encoder = ws.ChunkEncoder(PATH)
    for _ in range(2):
        assert np.frombuffer(encoder.encode(pa.array([text]))[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("way", ["ids", "texts"])
def test_files_give_back_every_document(spark, docs_of, tokenizer, words, tmp_path, monkeypatch, way):
    monkeypatch.setattr(ws, "RANGE_TOKENS", 1500)
    rows = [(k * 3, words(40)) for k in range(60)] + [(7, None), (8, ""), (10, words(4000)), (11, "same"), (11, "same"), (None, "no id")]
    docs = docs_of(rows, ", ids long")
    if way == "ids":
        ws.write(ws.encoded(docs, PATH, end=1, vocabulary=49_408), str(tmp_path / "shards"), 49_408, shard_tokens=700)
    else:
        ws.write_texts(docs, str(tmp_path / "shards"), PATH, end=1, vocabulary=49_408, shard_tokens=700)
    found = ws.shards(spark, str(tmp_path / "shards"))
    assert found.count() > 5
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in order]
    want, at = [], 0
    for (doc, _), own in zip(order, ids):
        want.append((doc, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(map(tuple, ws.documents(found).collect()), key=lambda r: r[1]) == want
    whole = np.concatenate(ids)
    hits = ws.occurrences(found, [1, int(whole[0]), 40_000]).collect()
    for token in (1, int(whole[0]), 40_000):
        own = [r for r in hits if r.token == token]
        assert sum(r.n for r in own) == (whole == token).sum()
        assert min((r.first for r in own if r.n), default=None) == next(iter(np.flatnonzero(whole == token).tolist()), None)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == found.count()


def test_empty_table(spark, docs_of, tmp_path):
    ws.write(ws.encoded(docs_of([]), PATH, end=1, vocabulary=49_408), str(tmp_path / "none"), 49_408)
    assert ws.documents(ws.shards(spark, str(tmp_path / "none"))).count() == 0
    ws.write_texts(docs_of([]), str(tmp_path / "no-texts"), PATH, end=1, vocabulary=49_408)
    assert ws.documents(ws.shards(spark, str(tmp_path / "no-texts"))).count() == 0
