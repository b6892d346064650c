"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from a table of ranks.

The vocabulary is never trained: every byte becomes one printable character, every rank one piece with
score ``-rank``, and normalisation is the identity, so sentencepiece merges what the ranks say, lowest
rank first and leftmost first. Texts are cut by the tokenizer's pattern and every pre-token is encoded
by itself. Decoding is the inverse table from id to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowloom.llm.shared import free_name, slices

#: Pre-tokens a worker remembers in each of two generations; bounds its memory and changes no result.
REMEMBERED = 200_000
#: Characters of text that are cut into pre-tokens at a time.
TOGETHER = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a public tokenizer: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@functools.cache
def byte_letters() -> list[str]:
    """One letter for each byte; none is white space or sentencepiece's own space mark."""
    return [chr(0x4E00 + b) for b in range(256)]


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece BPE model of ``ranks``; piece 0 is the unknown one, piece ``k`` the k-th lowest rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = 0, -1, -1, -1
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


def split_pattern(pattern: str):
    """``pattern`` compiled with Unicode's White_Space property for ``\\s`` and ``\\S``, as the rank files' own library reads them."""
    import regex

    out, k = [], 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in (r"\s", r"\S"):
            out.append(r"\p{White_Space}" if two == r"\s" else r"\P{White_Space}")
            k += 2
        elif pattern[k] == "\\":
            out.append(two)
            k += 2
        else:
            out.append(pattern[k])
            k += 1
    return regex.compile("".join(out))


class Encoder:
    """Encodes whole texts on a worker; built from the plain parts of a :class:`ByteBpe`."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import sentencepiece

        self.ranks, self.find = ranks, split_pattern(pattern).findall
        self.ids = np.array(sorted(ranks.values()), np.int64)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = dict(zip(range(256), byte_letters()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as packed little-endian 32-bit numbers. New pre-tokens of all texts are encoded in one call."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        parts = [self.find(x) for x in texts]
        hard, raws = [], []
        for p in set(chain.from_iterable(parts)).difference(known):
            if p in older:
                known[p] = older[p]
                continue
            raw = p.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                hard.append(p)
                raws.append(raw.decode("latin-1").translate(self.table))
            else:
                known[p] = rank.to_bytes(4, "little")
        if hard:
            found = self.pieces.encode(raws, out_type=int, num_threads=1)
            ends = list(accumulate(map(len, found), initial=0))
            packed = self.ids[np.fromiter(chain.from_iterable(found), np.int64, count=ends[-1]) - 1].astype("<i4").tobytes()
            for p, begin, end in zip(hard, ends, ends[1:]):
                known[p] = packed[4 * begin : 4 * end]
        return [b"".join(map(known.__getitem__, own)) for own in parts]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """As :meth:`encode`, for any number of texts, about ``TOGETHER`` characters at a time."""
        wait, size = [], 0
        for text in texts:
            wait.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self.encode(wait)
                wait, size = [], 0
        yield from self.encode(wait)


class ByteBpe:
    """Encoder and decoder of one rank file. The file is read once, on the driver; its size is that of a vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        self.ranks = read_ranks(path)
        self.model = model_bytes(self.ranks)

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``docs`` with ``ids`` (array of int): the ids of the whole text, without special tokens.

        A null text encodes as the empty one, to an empty array. Each row is encoded by itself, so repeated
        rows, long texts and empty tables need nothing special. All other columns stay; if one is already
        named ``ids`` the new column gets the first free name ``ids_1``, ``ids_2`` and so on.
        """
        ids = free_name(docs, ids)
        at = docs.columns.index(text)
        sent = docs.sparkSession.sparkContext.broadcast((self.ranks, self.model, self.pattern))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = Encoder(*sent.value)
            for batch in slices(batches):
                rows = list(encoder.encode_all(x.as_py() or "" for x in batch.column(at)))
                ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
                flat = np.frombuffer(b"".join(rows), "<i4")
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, ids])

        return docs.mapInArrow(run, _with(docs, ids, "array<int>"))

    def decode(self, encoded: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``encoded`` with ``decoded`` (binary): the bytes of ``ids``; null ids decode to no bytes. An id outside the vocabulary is an error."""
        out = free_name(encoded, out)
        at = encoded.columns.index(ids)
        sent = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in self.ranks.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            token = sent.value.__getitem__
            for batch in slices(batches):
                column = batch.column(at)
                flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                none = column.is_null().to_numpy(zero_copy_only=False)
                rows = [b"" if none[k] else b"".join(map(token, flat[ends[k] : ends[k + 1]].tolist())) for k in range(len(column))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, out])

        return encoded.mapInArrow(run, _with(encoded, out, "binary"))

    def round_trip(self, docs: DataFrame, text: str = "text", ids: str = "ids", digest: str = "decoded_sha256") -> DataFrame:
        """``docs`` with ``ids`` as by :meth:`encode` and ``digest``, the SHA-256 of the bytes that :meth:`decode` makes of them, in one pass.

        Texts go to the Python workers once and come back once, and the decoded bytes stay there.
        """
        ids, digest = free_name(docs, ids), free_name(docs, digest)
        at = docs.columns.index(text)
        sent = docs.sparkSession.sparkContext.broadcast((self.ranks, self.model, self.pattern))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = Encoder(*sent.value)
            token = {rank: raw for raw, rank in encoder.ranks.items()}.__getitem__
            for batch in slices(batches):
                rows = [np.frombuffer(r, "<i4") for r in encoder.encode_all(x.as_py() or "" for x in batch.column(at))]
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
                digests = [hashlib.sha256(b"".join(map(token, r.tolist()))).hexdigest() for r in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, made, pa.array(digests, pa.string())], names=[*batch.schema.names, ids, digest])

        return docs.mapInArrow(run, _with(docs, ids, "array<int>").add(digest, "string"))


def _with(df: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*df.schema.fields]).add(name, _parse_datatype_string(kind))


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of encoded and decoded rows."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
