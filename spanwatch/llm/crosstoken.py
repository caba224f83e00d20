"""Alignment of two tokenizers over a corpus: byte groups, links and how often each pair of ids is linked.

Two vocabularies cut the same bytes differently. Offsets where tokens of both end cut a text into groups, and the
last tokens of a group are linked. Most groups hold one token of each side with the same bytes. For these an array
from A's id to the B id of the same bytes is made once, and their links are counted in vectors of the length
of A's vocabulary, one a task. Only links of the other groups are counted as pairs of ids by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import cut, fresh_path, scratch, small_batches
from spanwatch.llm.prefixcounts import byte_of_symbol

_SPACE = "▁"
# From a space to before the next one that follows something else than white space: neither vocabulary joins across these.
_UNITS = r" (?:[^ ]++|(?<=\s) ++)*+"
_B_BITS = 24


class Aligner:
    """Tokenizer A (JSON of the tokenizers library, byte-level) beside B (model of sentencepiece), and the identity map.

    ``cache_bytes`` bounds what is kept of units seen before (about); units of more than 64 characters are never kept.
    """

    def __init__(self, a_content: bytes, b_content: bytes, cache_bytes: int = 192 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_content.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_content)
        spec, symbol = json.loads(a_content), byte_of_symbol()
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("tokenizer A is to be byte-level")
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in spec["model"]["vocab"].items():
            self.bytes_a[i] = bytes(map(symbol.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        # of ids with the same bytes a piece comes before a bare byte
        normal = {self.bytes_b[i]: i for i in range(len(pieces) - 1, -1, -1) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        bare = {self.bytes_b[i]: i for i in range(len(pieces)) if self.b.is_byte(i)}
        known = bare | normal
        self.same = np.array([known.get(t, -1) if t else -1 for t in self.bytes_a], np.int64)
        self.length_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.length_b = np.array(list(map(len, self.bytes_b)), np.int64)
        # ids as text with what follows them: a comma, or the end of their side of a group
        self.told_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))], object)
        self.told_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))], object)
        apart = not any(regex.search(rf"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        self.split = regex.compile(_UNITS if apart else r"(?s).+").findall
        self.recent: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.cache_bytes, self.kept = cache_bytes, 0

    def align(self, units: list[str]) -> list[tuple | None]:
        """For each unit (it begins with a space): number of A's tokens, of B's, of groups, the groups as text with a semicolon after each,
        A's ids in groups of one token each with the same bytes (int32 bytes), links of other groups (int64 bytes: A's id, then B's).
        None where the bytes of the tokens are not those of the unit."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.b.encode([u[1:] for u in units], num_threads=1)
        ids_b = [b if len(u) > 1 else self._blank() for u, b in zip(units, ids_b)]
        data = [u.encode() for u in units]
        right = list(range(len(units)))
        if not (self._spelt(ids_a, data, self.bytes_a, self.length_a) and self._spelt(ids_b, data, self.bytes_b, self.length_b)):
            same = lambda ids, told, d: b"".join(map(told.__getitem__, ids)) == d
            right = [k for k in right if same(ids_a[k], self.bytes_a, data[k]) and same(ids_b[k], self.bytes_b, data[k])]
            ids_a, ids_b = [ids_a[k] for k in right], [ids_b[k] for k in right]
        out: list[tuple | None] = [None] * len(units)
        if not right:
            return out
        a, b = np.array(list(chain.from_iterable(ids_a)), np.int64), np.array(list(chain.from_iterable(ids_b)), np.int64)
        # all units stand one after another, so their ends are ends of groups
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        is_last_a = np.isin(ends_a, ends_b, assume_unique=True)
        last_a = np.flatnonzero(is_last_a)
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        is_last_b = np.zeros(len(b), bool)
        is_last_b[last_b] = True
        plain = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1) & (self.same[a[last_a]] == b[last_b])
        # in the text of the groups A's tokens of a group come after B's of the groups before, B's after A's of their group
        groups_before_a, groups_before_b = np.cumsum(is_last_a) - is_last_a, np.cumsum(is_last_b) - is_last_b
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.r_[0, last_b + 1][groups_before_a]] = self.told_a[a + len(self.bytes_a) * is_last_a]
        text[np.arange(len(b)) + (last_a + 1)[groups_before_b]] = self.told_b[b + len(self.bytes_b) * is_last_b]
        text = text.tolist()
        same, links = a[last_a][plain].astype(np.int32).tobytes(), (a[last_a] << _B_BITS | b[last_b])[~plain].tobytes()
        to_a, to_b = np.cumsum(list(map(len, ids_a))), np.cumsum(list(map(len, ids_b)))
        to = np.searchsorted(last_a, to_a - 1) + 1
        to_plain = np.cumsum(plain)[to - 1]
        at_a = at_b = at = at_plain = 0
        for k, next_a, next_b, next_, next_plain in zip(right, to_a.tolist(), to_b.tolist(), to.tolist(), to_plain.tolist()):
            out[k] = (
                next_a - at_a,
                next_b - at_b,
                next_ - at,
                "".join(text[at_a + at_b : next_a + next_b]),
                same[4 * at_plain : 4 * next_plain],
                links[8 * (at - at_plain) : 8 * (next_ - next_plain)],
            )
            at_a, at_b, at, at_plain = next_a, next_b, next_, next_plain
        return out

    def _spelt(self, ids: list[list[int]], data: list[bytes], told: list[bytes], length: np.ndarray) -> bool:
        """Whether the bytes of the tokens are those of the units, in all of them."""
        flat = list(chain.from_iterable(ids))
        if b"".join(map(told.__getitem__, flat)) != b"".join(data):
            return False
        ends = np.cumsum(np.r_[0, length[np.array(flat, np.int64)]])[np.cumsum(list(map(len, ids)))]
        return bool((ends == np.cumsum(list(map(len, data)))).all())

    def _blank(self) -> list[int]:
        """B's tokens of a single space at the end of a text; for an empty text the library gives none, not even the added space."""
        i = self.b.piece_to_id(_SPACE)
        return [] if self.b.is_unknown(i) else [i]

    def documents(self, texts: list[str]) -> list[tuple | None]:
        """Like :meth:`align` for a space and each text; None also for an empty one."""
        split = [self.split(f" {t}") if t else [] for t in texts]
        distinct = set().union(*split) if split else set()
        if self.kept > self.cache_bytes // 2:
            self.older, self.recent, self.kept = self.recent, {}, 0
        missing = distinct.difference(self.recent)
        for u in missing.intersection(self.older):
            self.recent[u] = self.older[u]
        fresh = list(missing.difference(self.older))
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            self.recent.update(zip(part, self.align(part)))
        out = []
        for units in split:
            records = list(map(self.recent.__getitem__, units))
            if not records or None in records:
                out.append(None)
                continue
            n_a, n_b, n, groups, same, links = zip(*records)
            out.append((sum(n_a), sum(n_b), sum(n), "".join(groups)[:-1], b"".join(same), b"".join(links)))
        for u in missing:
            if len(u) <= 64:
                self.kept += 400 + 8 * len(u)
            else:
                del self.recent[u]
        return out


_LOADED: dict[bytes, Aligner] = {}


def _aligner(a_content: bytes, b_content: bytes) -> Aligner:
    """One per Python worker."""
    key = hashlib.sha256(hashlib.sha256(a_content).digest() + b_content).digest()
    if key not in _LOADED:
        _LOADED[key] = Aligner(a_content, b_content)
    return _LOADED[key]


def _portions(texts: list[str], most: int = 200_000):
    """Runs of texts of about ``most`` characters; a longer text is alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind))


_GROUPED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "same_ids array<int>, same_n array<long>, links array<long>, links_n array<long>"
)


def grouped(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its counts, the digest of its groups, its ids in groups of equal tokens and its other links, each
    distinct with a number of times (a link is A's id times 2^24 plus B's). Each task adds one row without ``row`` that
    holds the vector of its groups of equal tokens, where it is not zero."""
    spark = docs.sparkSession
    a, b = (spark.sparkContext.broadcast(Path(f).read_bytes()) for f in (a_file, b_file))

    def run(batches):
        aligner = _aligner(a.value, b.value)
        vector = np.zeros(len(aligner.bytes_a), np.int64)
        nothing = np.zeros(0, np.int64)
        schema = pa.schema(
            [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
            + [("same_ids", pa.list_(pa.int32())), ("same_n", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())), ("links_n", pa.list_(pa.int64()))]
        )
        for batch in small_batches(batches, 512):
            sums, digests, lists = [], [], ([], [], [], [])
            for texts in _portions([t or "" for t in batch.column(2).to_pylist()]):
                for record in aligner.documents(texts):
                    if record is None:
                        sums.append((0, 0, 0))
                        digests.append("")
                        for column in lists:
                            column.append(nothing)
                        continue
                    *numbers, groups, same, links = record
                    sums.append(numbers)
                    digests.append(hashlib.sha256(groups.encode()).hexdigest())
                    same, same_n = np.unique(np.frombuffer(same, np.int32), return_counts=True)
                    vector[same] += same_n
                    for column, values in zip(lists, (same, same_n, *np.unique(np.frombuffer(links, np.int64), return_counts=True))):
                        column.append(values)
            arrays = [pa.array([s[k] for s in sums], pa.int64()) for k in range(3)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays, pa.array(digests, pa.string()), *map(_lists, lists, kinds)], schema=schema
            )
        ids = np.flatnonzero(vector)
        if len(ids):
            none = [pa.array([None], f.type) for f in schema]
            none[6], none[7] = _lists([ids], pa.int32()), _lists([vector[ids]], pa.int64())
            yield pa.RecordBatch.from_arrays(none, schema=schema)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")
    )
    return rows.mapInArrow(run, _GROUPED)


def same_vector(table: DataFrame) -> DataFrame:
    """(id, n): the vectors of all tasks of :func:`grouped` added; as many rows as A has ids at most."""
    rows = table.where("row is null").select(F.inline(F.arrays_zip("same_ids", "same_n")))
    return rows.groupBy(F.col("same_ids").alias("id")).agg(F.sum("same_n").alias("n"))


def link_counts(table: DataFrame) -> DataFrame:
    """(link, n) of all links that are in no vector, added before the shuffle."""
    rows = table.where("row is not null").select(F.inline(F.arrays_zip("links", "links_n")))
    return rows.groupBy(F.col("links").alias("link")).agg(F.sum("links_n").alias("n"))


def pair_counts(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold each pair of ids."""
    same = Aligner(Path(a_file).read_bytes(), Path(b_file).read_bytes(), 0).same
    to_b = F.broadcast(docs.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(same) if b >= 0], "id int, b_id int"))
    table = cut(grouped(docs, a_file, b_file, id_col, text_col), "crosstoken-groups")
    exact = same_vector(table).join(to_b, "id").select(F.col("id").alias("a_id"), "b_id", "n")
    parts = (F.shiftright("link", _B_BITS).cast("int").alias("a_id"), F.col("link").bitwiseAND((1 << _B_BITS) - 1).cast("int").alias("b_id"))
    return exact.unionByName(link_counts(table).select(*parts, "n"))


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a and n_b (tokens), n_groups, n_links (one a group: its last tokens end together), n_best (links
    whose count over the corpus is the highest of their B id), count_sum (counts over its links), groups_sha256.

    A encodes a space and the text, B the text (it adds the space); special strings are ordinary text. Texts that are null, empty
    or not given back by the bytes of either's tokens have zeros and an empty digest. Null and repeated ids and
    repeated rows stay and count each; further columns are ignored; an empty table gives an empty result.

    What goes through the driver is bounded by the vocabularies and a constant: A's vector, the highest count of each B id, and the
    at most 20 000 links that make up more than 1/20 000 of all. These are counted where the documents are;
    the rarer ones are joined by a shuffle in which no key is hot.
    """
    spark = docs.sparkSession
    result = fresh_path(spark, "crosstoken")
    with scratch(spark):
        table = cut(grouped(docs, a_file, b_file, id_col, text_col), "crosstoken-groups")
        counted = cut(link_counts(table), "crosstoken-links")
        aligner = Aligner(Path(a_file).read_bytes(), Path(b_file).read_bytes(), 0)
        vector = np.zeros(len(aligner.bytes_a), np.int64)
        for r in same_vector(table).collect():
            vector[r.id] = r.n
        best = np.zeros(len(aligner.bytes_b), np.int64)
        np.maximum.at(best, aligner.same[vector > 0], vector[vector > 0])
        b_id = F.col("link").bitwiseAND((1 << _B_BITS) - 1).cast("int")
        for r in counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("n")).collect():
            best[r.b] = max(best[r.b], r.n)
        common = (counted.agg(F.sum("n")).first()[0] or 0) // 20_000
        hot = counted.where(F.col("n") > common).orderBy("link").collect()
        hot_links, hot_n = np.array([r.link for r in hot], np.int64), np.array([r.n for r in hot], np.int64)
        told = spark.sparkContext.broadcast((vector, vector == best[aligner.same], hot_links, hot_n, hot_n == best[hot_links & ((1 << _B_BITS) - 1)]))

        def known(batches):
            vector, vector_best, links, n, links_best = told.value
            for batch in batches:
                same, same_n = batch.column(6), batch.column(7)
                own, own_n = batch.column(8), batch.column(9)
                ids, times = same.flatten().to_numpy(), same_n.flatten().to_numpy()
                sums, tops = _added(same, vector[ids] * times), _added(same, vector_best[ids] * times)
                keys, times = own.flatten().to_numpy(), own_n.flatten().to_numpy()
                if len(links):
                    at = np.minimum(np.searchsorted(links, keys), len(links) - 1)
                    hit = links[at] == keys
                    sums += _added(own, np.where(hit, n[at] * times, 0))
                    tops += _added(own, np.where(hit & links_best[at], times, 0))
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(tops), pa.array(sums)], names=[*batch.schema.names[:6], "n_best", "count_sum"])

        schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"
        rows = table.where("row is not null")
        near = rows.mapInArrow(known, schema)
        top = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(best)], "b int, top long"))
        rare = counted.where(F.col("n") <= common).withColumn("b", b_id).join(top, "b")
        rare = rare.select("link", "n", (F.col("n") == F.col("top")).cast("long").alias("is_top"))
        frequent = F.broadcast(counted.where(F.col("n") > common).select("link"))
        rest = rows.select("row", F.inline(F.arrays_zip(F.col("links").alias("link"), F.col("links_n").alias("times")))).join(frequent, "link", "left_anti")
        far = rest.join(rare, "link").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("is_top")).alias("more_best"))
        out = near.join(far, "row", "left").select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            F.col("n_groups").alias("n_links"),
            (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
            "groups_sha256",
        )
        return cut(out, "crosstoken", result)


def _added(lists, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each list of a batch."""
    ends = np.cumsum(np.r_[0, values.astype(np.int64)])
    sizes = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
    return ends[sizes[1:]] - ends[sizes[:-1]]
