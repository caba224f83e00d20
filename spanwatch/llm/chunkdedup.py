"""Substring deduplication by content-defined chunking.

A gear rolling hash over the bytes of a text cuts it where the hash has ``bits`` zero bits, so cuts
depend on the 16 bytes before them only and fall into step again after an insertion. A chunk is a
repeat if its digest occurs earlier in the corpus (by doc_id, then row, then position). Runs of neighbouring
repeats that together have at least ``min_words`` words are dropped; the first occurrence stays.

A digest has 96 bits: among 10^12 chunks (some 30 TB of text) two different ones share a digest with a
probability of about 10^-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import cut, fresh_name, fresh_path, scratch, small_batches

_WINDOW = 16


def gear_table(seed: int = 42) -> np.ndarray:
    """256 random words from a seed."""
    return np.random.default_rng(seed).integers(0, 2**32, 256, np.uint32)


_GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of the table words of the last 16 bytes, the byte i places
    back shifted left by i. Built by doubling: 1, 2, 4, 8, 16 bytes."""
    h = _GEAR[data]
    span = 1
    while span < _WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    return h


def cuts(data: np.ndarray, bits: int = 5, least: int = 8, most: int = 256) -> np.ndarray:
    """Ends of chunks: after bytes where bits 11 to 15 of the hash are zero (``bits`` of them up from
    16 - bits), no chunk under ``least`` bytes but the last, none over ``most``. Cuts fall between
    UTF-8 characters."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    mask = np.uint32(((1 << bits) - 1) << (16 - bits))
    boundary = np.ones(n, bool)
    boundary[:-1] = (data[1:] & 0xC0) != 0x80
    out, last = [], 0
    for c in (np.flatnonzero(((gear_hash(data) & mask) == 0) & boundary) + 1).tolist():
        while c - last > most:
            last += most
            while not boundary[last - 1]:
                last -= 1
            out.append(last)
        if c - last >= least:
            out.append(c)
            last = c
    while n - last > most:
        last += most
        while not boundary[last - 1]:
            last -= 1
        out.append(last)
    if last < n:
        out.append(n)
    return np.array(out, np.int64)


def _digests(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 64 and the next 32 bits of each chunk's digest."""
    digest, ends = xxhash.xxh3_128_digest, ends.tolist()
    words = np.frombuffer(b"".join(digest(raw[a:e]) for a, e in zip([0, *ends], ends)), np.int64).reshape(-1, 2)
    return words[:, 0], words[:, 1].astype(np.int32)


_CHUNKED = "row long, id long, d1 array<long>, d2 array<int>, chars array<smallint>, words array<smallint>"


def chunked(docs: DataFrame, bits: int = 5) -> DataFrame:
    """``docs(row, id, text)`` as arrays over the chunks of each text: d1 and d2 (digest), chars and words (code points
    and begun words in each chunk). Every text is chunked once, in the task that reads it."""

    def lists(values, lengths, kind):
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))

    def run(batches):
        for b in small_batches(batches):
            found, lengths = ([], [], [], []), []
            for t in b.column(2).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                ends = cuts(data, bits)
                blank = (data == 32) | ((data >= 9) & (data <= 13))
                begins = ~blank
                begins[1:] &= blank[:-1]
                totals = (np.cumsum((data & 0xC0) != 0x80), np.cumsum(begins))
                for into, x in zip(found, (*_digests(raw, ends), *(np.diff(c[ends - 1], prepend=0) for c in totals))):
                    into.append(x)
                lengths.append(len(ends))
            kinds = (pa.int64(), pa.int32(), pa.int16(), pa.int16())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(lists(x, lengths, k) for x, k in zip(found, kinds))], ["row", "id", "d1", "d2", "chars", "words"])

    return docs.mapInArrow(run, _CHUNKED)


def repeats(table: DataFrame) -> DataFrame:
    """(row, seq, first_id) for each chunk of a :func:`chunked` table whose digest occurs earlier, by (id, row, seq) with null
    ids first.

    The first occurrence is a ``min`` per digest, combined before the shuffle. Digests with so many chunks that
    at most 20 000 of them exist are joined by a broadcast where the chunks are, so that a passage that very many
    documents hold is not the key of one task."""
    every = table.select("row", "id", F.posexplode(F.arrays_zip("d1", "d2"))).select("row", "id", F.col("pos").alias("seq"), "col.d1", "col.d2")
    hub = max(1000, (table.agg(F.sum(F.size("d1"))).first()[0] or 0) // 20_000)
    first = every.groupBy("d1", "d2").agg(F.min(F.struct("id", "row", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = F.broadcast(first.where(F.col("n") > hub).select("d1", "d2", F.col("first").alias("hot")))
    told = every.join(hot, ["d1", "d2"], "left").select("row", "seq", "hot", F.when(F.col("hot").isNull(), F.col("d1")).otherwise(F.xxhash64("row", "seq")).alias("d1"), F.when(F.col("hot").isNull(), F.col("d2")).alias("d2"))
    hit = told.join(first.select("d1", "d2", "first"), ["d1", "d2"], "left").withColumn("first", F.coalesce("hot", "first"))
    return hit.where("first is not null and (row <> first.row or seq <> first.seq)").select("row", "seq", F.col("first.id").alias("first_id"))


def runs_of(seqs: np.ndarray, chars: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(start, end, words, chunks, numbers of the chunks) of each run of two or more neighbouring repeats with ``min_words``
    words; ``chars`` and ``words`` are counted up to each chunk's end."""
    out = []
    for run in np.split(seqs, np.flatnonzero(np.diff(seqs) > 1) + 1):
        a, e = run[0] - 1, run[-1]
        start, before = (int(chars[a]), int(words[a])) if a >= 0 else (0, 0)
        if len(run) > 1 and words[e] - before >= min_words:
            out.append((start, int(chars[e]), int(words[e]) - before, len(run), run))
    return out


def _spans(numbered: DataFrame, bits: int, min_words: int) -> DataFrame:
    """row, doc_id, span_start, span_end, n_words, n_chunks, first_doc_ids of the passages to cut from ``numbered(row, id, text)``."""
    spark = numbered.sparkSession
    path = fresh_path(spark, "chunk-spans")
    with scratch(spark):  # the chunks go once the spans are written
        return cut(_found(cut(chunked(numbered, bits), "chunks"), min_words), "chunk-spans", path)


def _found(table: DataFrame, min_words: int) -> DataFrame:
    marks = repeats(table).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "first_id"))).alias("marks"))
    joined = table.select("row", "id", "chars", "words").join(marks.where(F.size("marks") > 1), "row")

    def run(batches):
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                marks = b.column("marks")[k].values
                number = lambda c: b.column(c)[k].values.to_numpy()
                seqs, firsts = marks.field("seq").to_numpy(), marks.field("first_id").to_pylist()
                first = dict(zip(seqs.tolist(), firsts))
                for a, e, n, chunks, run in runs_of(seqs, np.cumsum(number("chars"), dtype=np.int64), np.cumsum(number("words"), dtype=np.int64), min_words):
                    held = {first[s] for s in run.tolist()}
                    rows.append((b.column("row")[k].as_py(), b.column("id")[k].as_py(), a, e, n, chunks, [None] * (None in held) + sorted(held - {None})))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", "doc_id", "span_start", "span_end", "n_words", "n_chunks", "first_doc_ids"])

    return joined.mapInArrow(run, "row long, doc_id long, span_start int, span_end int, n_words int, n_chunks int, first_doc_ids array<long>")


def dedup_text(docs: DataFrame, text_col: str = "text", bits: int = 5, min_words: int = 20) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text_col``; all rows and columns stay, whatever their names.

    The first occurrence by (doc_id, row, position) stays, also inside one document; null doc_ids come first,
    and rows that share a doc_id (or have none) in the order in which they are read, so of equal rows one keeps its text.
    Null texts stay null, texts without repeats stay as they are, a text that repeats
    from end to end becomes empty. The order of a text's remaining parts is kept. Very long texts are
    chunked whole. An empty table stays empty.
    """
    row = fresh_name(docs, "row")
    base = cut(docs.withColumn(row, F.monotonically_increasing_id()), "chunk-texts")  # written, so that a row keeps its number
    spans = _spans(base.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), bits, min_words)
    gone = spans.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias(fresh_name(base, "gone")))

    def run(batches):
        for b in small_batches(batches):
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            for k, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if spans:
                    edges = [0, *(x for s in spans for x in (s["span_start"], s["span_end"])), len(texts[k])]
                    texts[k] = "".join(texts[k][a:e] for a, e in zip(edges[::2], edges[1::2]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns[:-1])], names=b.schema.names[:-1])

    return base.join(gone, row, "left").drop(row).mapInArrow(run, docs.schema)


def repeated_spans(docs: DataFrame, text_col: str = "text", bits: int = 5, min_words: int = 20) -> DataFrame:
    """One row per passage that :func:`dedup_text` cuts out: doc_id, span_start and span_end (code
    points), n_words, n_chunks, first_doc_ids (sorted ids, null first, of the documents that hold the chunks first).
    Null and empty texts have none; an empty table gives an empty result; further columns are ignored."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return _spans(numbered, bits, min_words).drop("row")
