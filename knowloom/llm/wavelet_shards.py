"""Token ids as wavelet matrices, one compressed file per shard.

A shard is a run of whole documents in ascending ``doc_id`` order. Its ids are stored as bit-planes, highest
bit first; under each plane the positions are stably parted by that bit. A directory of one-counts per block
gives rank and select, so a token, the count of a token and the place of its k-th occurrence are read from the
planes without unpacking the shard. Files are Parquet with one shard each, so any storage Spark reads will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from knowloom.llm.shared import slices

#: Tokens after which a shard is closed; a document is never cut, so a longer one is a shard of its own.
SHARD_TOKENS = 2_000_000
#: Tokens of a range partition, on average.
RANGE_TOKENS = 4_000_000
#: Characters of a token, for the number of ranges only.
CHARACTERS = 2
#: Bytes of a plane that share one entry of the rank directory.
BLOCK = 64
#: Chunks a worker remembers in each of two generations, over all its tasks; bounds its memory and changes no result.
REMEMBERED = 350_000


@dataclass
class WaveletMatrix:
    """Rank and select over a sequence of ids; positions count from 0."""

    n: int
    planes: list[np.ndarray]  # packed bits, highest bit of the ids first
    ranks: list[np.ndarray]  # ones before each block
    zeros: list[int]  # zeros of each plane

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks, zeros, row = [], [], [], np.asarray(ids).astype(np.uint16 if bits <= 16 else np.uint32)
        for k in reversed(range(bits)):
            one = row & row.dtype.type(1 << k) != 0
            plane = np.packbits(one, bitorder="little")
            plane = np.concatenate([plane, np.zeros(-len(plane) % BLOCK, np.uint8)])
            ones = np.bitwise_count(plane).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]))
            ones_at = np.flatnonzero(one)  # far faster than masks on mixed bits
            row = np.concatenate([row[np.flatnonzero(~one)], row[ones_at]])
            zeros.append(len(row) - len(ones_at))
        return cls(len(row), planes, ranks, zeros)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        block = i // (8 * BLOCK)
        part = self.planes[level][block * BLOCK : i // 8 + 1].copy()
        if i // 8 < len(self.planes[level]):
            part[-1] &= (1 << i % 8) - 1
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8]) >> i % 8 & 1
            out = out << 1 | bit
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where, under the last plane, the occurrences of ``token`` before ``stop`` lie."""
        low, high, bits = 0, min(stop, self.n), len(self.planes)
        if token < 0 or token >> bits:
            return 0, 0
        for level in range(bits):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, stop: int | None = None) -> int:
        """Occurrences of ``token`` before position ``stop``."""
        low, high = self._range(token, self.n if stop is None else stop)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The position of occurrence ``k`` of ``token``, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self._find(level, i - self.zeros[level] if bit else i, bit)
        return i

    def _find(self, level: int, k: int, bit: int) -> int:
        """The position of the k-th one or zero of a plane."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * 8 * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK : (block + 1) * BLOCK], bitorder="little")
        return block * 8 * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def ids(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        row = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~one)] = row[: self.zeros[level]]
            up[np.flatnonzero(one)] = row[self.zeros[level] :] | row.dtype.type(1 << (len(self.planes) - 1 - level))
            row = up
        return row


#: White space for the cutter and for Python, but not for the tokenizer.
SEPARATORS = "[\x1c-\x1f]"
#: One word of Latin letters, and a mark that may follow. These letters keep their class and case in every version of
#: Unicode, each lower case is one of them (the dotted capital I is left out), and none of them composes.
PLAIN = "([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,!?]?)"
MARKS = ".,!?"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class ChunkEncoder:
    """Whole texts to packed ids (little-endian, unsigned) with the tokenizers library.

    The tokenizer drops white space and no token spans it, so chunks between white space are encoded by themselves and
    remembered. A chunk of plain Latin letters is one word for the tokenizer: it goes lower-cased, as byte letters, to the
    library's BPE model at once. All other chunks take the library's whole way, and so do, in one piece, texts with a
    separator control that only Python takes for white space.
    """

    def __init__(self, path: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.packed = [np.array(k, kind).tobytes() for k in range(self.tokenizer.get_vocab_size())]
        self.marks = [self._whole(x) for x in MARKS]
        model = self.tokenizer.model
        model._resize_cache(0)  # what is remembered here never gets there twice
        self.merge, self.letters = model.tokenize, byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, low: str) -> bytes:
        """The ids of a plain word in lower case from the model."""
        shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.merge(shown)])

    def _ids(self, names: pa.Array, fresh) -> list[bytes]:
        """The ids of distinct words or chunks, remembered or ``fresh``; words and other chunks never read alike."""
        names = names.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.known.get, names)]
        for k in [k for k, x in enumerate(found) if x is None]:
            found[k] = self.known[names[k]] = self.older.get(names[k]) or fresh(names[k])
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: empty). The texts are cut together; each distinct word or other chunk is looked up or encoded once, and ids are put in place by number."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, SEPARATORS)
        odd = {k: texts[k].as_py() for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()}
        chunks = pc.utf8_split_whitespace(pc.if_else(whole, "", texts) if odd else texts)
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary
        plain = pc.match_substring_regex(names, "^" + PLAIN + "$")
        words = pc.utf8_lower(pc.utf8_rtrim(names.filter(plain), characters=MARKS)).dictionary_encode()
        others = self._ids(names.filter(pc.invert(plain)), self._whole)
        # What stands for a chunk: its word, or the chunk itself, and the mark that follows a word.
        table = [b"", *self.marks, *self._ids(words.dictionary, self._word), *others]
        is_plain = plain.to_numpy(zero_copy_only=False)
        pieces = np.zeros((len(names), 2), np.int64)
        pieces[is_plain, 0] = 1 + len(MARKS) + words.indices.to_numpy()
        pieces[~is_plain, 0] = 1 + len(MARKS) + len(words.dictionary) + np.arange(len(others))
        mark = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(names, -1), pa.array([*MARKS])), -1).to_numpy(zero_copy_only=False) + 1
        pieces[is_plain, 1] = mark[is_plain]
        ids = np.frombuffer(b"".join(table), self.kind)
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // np.dtype(self.kind).itemsize
        at = pieces[coded.indices.to_numpy()].ravel()
        many = sizes[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], many) + np.arange(ends[-1])]
        offsets = chunks.offsets.to_numpy()
        bounds = ends[2 * (offsets - offsets[0])].tolist()
        return [self._whole(odd[k]) if k in odd else flat[a:b].tobytes() for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, kind: str) -> ChunkEncoder:
    """The encoder of this worker, so that its tasks one after another share what it remembers."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kind] = ChunkEncoder(path, kind)
    return _ENCODERS[path, kind]


def kind_of(vocabulary: int) -> str:
    """How an id of the vocabulary is packed: two bytes if they do, else four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end: int, vocabulary: int) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (packed by :func:`kind_of`) of every row; a null text is the empty one, ``end`` is appended to each."""
    kind = kind_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(path, kind), np.array([end], kind).tobytes()
        for batch in slices(batches):
            rows = [ids + last for ids in own.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // len(last) for r in rows], pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


_SHARD = "part int, shard int, n long, n_docs long, bits int, doc_ids array<long>, ends array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


def write(tokens: DataFrame, folder: str, vocabulary: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write rows of :func:`encoded` to ``folder``, in ascending ``doc_id`` order (nulls first, equal ids by their token bytes).

    Partitions are ranges of ``doc_id``; a task closes a shard whenever it has enough tokens, so a range with long
    documents or one id in many rows makes more shards, not larger ones.
    """
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    _write(tokens.select("doc_id", "ids"), -(-total // RANGE_TOKENS), folder, vocabulary, shard_tokens, lambda: lambda ids: ids.to_pylist())


def write_texts(docs: DataFrame, folder: str, path: str, end: int, vocabulary: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """As :func:`write` of :func:`encoded`, in one go: texts move to their range of ``doc_id``, and what is encoded there goes straight into a shard.

    Rows that share a ``doc_id`` follow each other by text. Ranges are sized by characters.
    """
    kind = kind_of(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def encode():
        own, last = encoder(path, kind), np.array([end], kind).tobytes()
        return lambda texts: [ids + last for ids in own.encode(texts)]

    _write(rows, -(-total // (RANGE_TOKENS * CHARACTERS)), folder, vocabulary, shard_tokens, encode)


def _write(rows: DataFrame, ranges: int, folder: str, vocabulary: int, shard_tokens: int, ready) -> None:
    """Sort two columns, ``doc_id`` and what ``ready()`` makes packed ids of, into ranges and write their shards."""
    bits = max(1, int(vocabulary - 1).bit_length())
    kind = np.dtype(kind_of(vocabulary))
    size = kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, docs, rows, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(rows), kind), bits)
            ends = np.cumsum([len(r) // size for r in rows]).tolist()
            row = {"part": part, "shard": shard, "n": matrix.n, "n_docs": len(docs), "bits": bits, "doc_ids": docs, "ends": ends, "zeros": matrix.zeros, "planes": [p.tobytes() for p in matrix.planes], "ranks": [r.astype("<u4").tobytes() for r in matrix.ranks]}
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        packed = ready()
        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), packed(batch.column(1))):
                if rows and held + len(ids) // size > shard_tokens:
                    yield close()
                    shard, docs, rows, held = shard + 1, [], [], 0
                docs.append(doc)
                rows.append(ids)
                held += len(ids) // size
        if rows:
            yield close()

    ordered = rows.repartitionByRange(max(1, ranges), "doc_id").sortWithinPartitions(*rows.columns)
    ordered.mapInArrow(run, _SHARD).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def _arrow_schema() -> pa.Schema:
    longs, blobs = pa.list_(pa.int64()), pa.list_(pa.binary())
    return pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("n_docs", pa.int64()), ("bits", pa.int32()), ("doc_ids", longs), ("ends", longs), ("zeros", longs), ("planes", blobs), ("ranks", blobs)])


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in ``folder``, one row each."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    return spark.read.schema(StructType(_parse_datatype_string(_SHARD).fields)).parquet(folder)


def starts(found: DataFrame) -> DataFrame:
    """``part``, ``shard``, ``start``: the tokens of all shards before a shard, in file order. Only sizes are read."""
    sizes = found.select("part", "shard", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # One small row per range of several million tokens; the order within a range is summed in parallel.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = sizes.select("part", "shard", (F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("inside"))
    return within.join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))


def matrix(row: dict) -> WaveletMatrix:
    """The wavelet matrix of a shard row."""
    return WaveletMatrix(row["n"], [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(r, "<u4") for r in row["ranks"]], list(row["zeros"]))


def documents(found: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the bit-planes of :func:`shards`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = memoryview(matrix(row).ids().astype("<u4").tobytes())
            ends = np.array(row["ends"], np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            place = [pa.array(np.full(len(ends), row[k]), pa.int32()) for k in ("part", "shard")]
            yield pa.RecordBatch.from_arrays([*place, pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "begin", "n_tokens", "ids_crc32"])

    read = found.mapInArrow(run, "part int, shard int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return read.join(starts(found), ["part", "shard"]).select("doc_id", (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Shard rows one at a time, so that a task unpacks one shard at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def occurrences(found: DataFrame, tokens: list[int]) -> DataFrame:
    """``part``, ``shard``, ``token``, ``n`` and ``first`` (global position or null) of each asked token in each shard, by rank and select alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            own = matrix(row)
            n = [own.count(t) for t in tokens]
            first = [own.select(t, 0) if c else None for t, c in zip(tokens, n)]
            place = [pa.array([row[k]] * len(n), pa.int32()) for k in ("part", "shard")]
            yield pa.RecordBatch.from_arrays([*place, pa.array(tokens, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], names=["part", "shard", "token", "n", "at"])

    read = found.mapInArrow(run, "part int, shard int, token long, n long, at long")
    return read.join(starts(found), ["part", "shard"]).select("part", "shard", "token", "n", (F.col("start") + F.col("at")).alias("first"))
