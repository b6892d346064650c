"""Substring dedup by hashing normalised lines and paragraphs.

Lines tile the text, and paragraphs, which end at an empty line, are runs of lines; so what is removed and what is kept is
known by offset. A unit's digest is taken over its lower-cased words. Of all units with one digest the earliest ranked
stays: the lowest ``doc_id``, and within a document the first. A repeated paragraph goes whole, with its short lines;
elsewhere repeated lines go. Only digests and offsets are shuffled to find repeats; counting combines before it moves, and
the join against the keepers has one row per digest on one side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from knowloom.llm.shared import free_name, slices, staged

#: A line ends after this; with an empty line in it, so does a paragraph.
BREAK = re.compile(r"\n\s*")
#: Units of fewer words say too little to be a repeat of anything and stay, unless a larger unit takes them along.
LEAST_WORDS = 20
#: Longer words than this count as one word for every two characters, as scripts without spaces have them.
LONG_WORD = 16
#: Bits of the map of texts that lose something; two megabytes are sent to every task.
BITS = 1 << 24


def _size(words: list[str]) -> int:
    return sum([1 if len(w) <= LONG_WORD else len(w) // 2 for w in words])


def units(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """``(start, end, digest)`` of each line and each paragraph of several lines that has enough words; offsets count code points."""
    import xxhash

    breaks = [(m.end(), "\n" in text[m.start() + 1 : m.end()]) for m in BREAK.finditer(text)]
    if not breaks or breaks[-1][0] < len(text):
        breaks.append((len(text), True))
    start, opened, lines = 0, 0, []
    for k, (end, closes) in enumerate(breaks):
        words = text[start:end].lower().split()
        lines.append(words)
        if _size(words) >= least_words:
            yield start, end, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
        if closes or k == len(breaks) - 1:
            if len(lines) > 1 and sum(map(_size, lines)) >= least_words:
                yield opened, end, xxhash.xxh3_128_digest(" ".join([w for x in lines for w in x]).encode("utf-8", "surrogatepass"))
            opened, lines = end, []
        start = end


_UNIT = "d1 long, d2 long, doc_id long, version long, span long, again boolean"


def _unit_rows(docs: DataFrame, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, owners, spans, again = bytearray(), [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                seen = set()
                for start, end, digest in units(text or "", least_words):
                    digests += digest
                    owners.append(k)
                    spans.append(start << 32 | end)
                    again.append(digest in seen)
                    seen.add(digest)
            halves = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            own = pa.array(owners, pa.int64())
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(own), batch.column(1).take(own), pa.array(spans, pa.int64()), pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "doc_id", "version", "span", "again"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string")).mapInArrow(run, _UNIT)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id``, ``version`` (hash of the text) and ``removed``: the spans, in order and none within another, that repeat an earlier ranked unit."""
    found = staged(_unit_rows(docs, least_words), "units")
    keepers = found.where("not again").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.where("not again").join(keepers, ["d1", "d2"]).where("doc_id > first or (doc_id is null and first is not null)")
    gone = later.select("doc_id", "version", "span").unionAll(found.where("again").select("doc_id", "version", "span")).distinct()
    # A paragraph comes before its lines: by start, then by end, last first.
    start, end = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(start.alias("start"), (-end).alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    outer = F.aggregate(ordered, none, lambda out, x: F.when(F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1)) >= -x["end"], out).otherwise(F.concat(out, F.array(F.struct(x["start"].alias("start"), (-x["end"]).alias("end"))))))
    return gone.groupBy("doc_id", "version").agg(outer.alias("removed"))


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, removed: str = "removed") -> DataFrame:
    """``docs`` with every repeated line and paragraph cut out of ``text``, and ``removed``: array of the original ``start``, ``end`` offsets.

    Units of fewer than ``least_words`` words (a word of more than LONG_WORD characters counts for more) go only within a
    repeated paragraph; a text without an empty line is one paragraph, so a whole copy of short lines goes, too.

    Every row stays, also one whose text is all repeats (its text becomes empty). A null text stays null and an empty
    one empty, with no spans. Within a text the first occurrence of a unit stays. Between texts the lowest ``doc_id``
    keeps it; rows that share a ``doc_id`` are versions of one document and are not held against each other, so equal
    rows stay equal; rows without a ``doc_id`` rank after all others and are not held against each other either.
    ``n_chars``, where there is one, follows the new text. Other columns stay; a clash of names moves ``removed`` to
    ``removed_1`` and so on.
    """
    removed = free_name(docs, removed)
    version, own, key, mark = (free_name(docs, n) for n in ("version_of_text", "own_doc_id", "key_doc_id", "mark_of_text"))
    gone = staged(repeats(docs, least_words), "spans").select(F.col("doc_id").alias(own), F.col("version").alias("_version"), F.col("removed").alias(removed))
    keyed = docs.withColumns({version: F.xxhash64("text"), key: F.col("doc_id").cast("long")})
    # Only texts that lose something move. They are told apart by a bitmap of fixed size, so that the others stay where they
    # are read; where it says so of too many, these move as well and meet no spans.
    bits = _bitmap(gone, F.col(own), F.col("_version"))
    marked = keyed.withColumn(mark, _place(F.col(key), F.col(version))).join(F.broadcast(bits), F.bitmap_bucket_number(mark) == F.col("_bucket"), "left")
    at_bit = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at_bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("_touched", F.coalesce(F.getbit(byte, (at_bit % 8).cast("int")) == 1, F.lit(False)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    met = marked.where("_touched").join(gone.hint("merge"), marked[key].eqNullSafe(gone[own]) & (marked[version] == gone["_version"]), "left")
    joined = met.select(*docs.columns, F.coalesce(removed, none).alias(removed))
    same = marked.where("not _touched").select(*docs.columns, none.alias(removed))
    if "n_chars" in docs.columns:
        same = same.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [_cut(x, spans) for x, spans in zip(batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist())]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([None if x is None else len(x) for x in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = T.StructType([*docs.schema.fields, *joined.schema.fields[-1:]])
    return joined.mapInArrow(cut, schema).unionByName(same)


def _place(doc_id: Column, version: Column) -> Column:
    """Where a text stands in the bitmap, from 1."""
    return F.pmod(F.xxhash64(doc_id, version), F.lit(BITS)) + 1


def _bitmap(gone: DataFrame, doc_id: Column, version: Column) -> DataFrame:
    """Bits of the texts in ``gone``: at most BITS / 32768 rows of 4 KiB, whatever their number."""
    placed = gone.select(_place(doc_id, version).alias("p"))
    return placed.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))


def _cut(text: str | None, spans: list[dict]) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for span in spans:
        out.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*out, text[at:]])
