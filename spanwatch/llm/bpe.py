"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

Each piece of text is a row of byte positions. A leaf of its segment tree holds the rank of the
pair that starts at that position, inner nodes hold the leftmost minimum of their leaves. A merge
takes the root's pair, joins it with its live right neighbour and updates the two leaves that
changed and the one that died, each a walk of logarithmic length to the root. Pieces of like length
are merged in step, one numpy operation for all of them.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import fresh_name, small_batches

_NONE = np.int64(1) << np.int64(62)


class Tokenizer:
    """Ranks of a byte-level BPE (lines of base64 token and rank) with a splitting pattern."""

    def __init__(self, rank_lines: bytes, pattern: str, cache_size: int = 150_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines()) if a}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.numerals = {r: str(r) for r in self.tokens}
        self.text_of: dict[str, str] = {}  # piece: its ids joined by one space
        self.old: dict[str, str] = {}
        ends = np.cumsum([0] + [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)])
        self.starts, self.lengths = ends[:-1], np.diff(ends)
        self.all_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)), np.uint8)
        self.cache_size = cache_size
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, made = [], [], []
        for token, r in self.ranks.items():
            for at in range(1, len(token)):
                a, b = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        self.width = np.int64(max(self.tokens) + 1)
        keys, made = np.array(left, np.int64) * self.width + np.array(right, np.int64), np.array(made, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        # an open hash table: a pair is looked up with a few gathers
        self.bits = max(4, int(2 * len(keys) - 1).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        todo, probe = np.arange(len(keys)), 0
        while len(todo):
            at = (self._home(self.keys[todo]) + probe) & ((1 << self.bits) - 1)
            free = self.slots[at] < 0
            _, firsts = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            firsts = firsts[free[firsts]]
            self.slots[at[firsts]], self.values[at[firsts]] = self.keys[todo[firsts]], self.made[todo[firsts]]
            todo, probe = np.delete(todo, firsts), probe + 1
        self.probes = probe

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make; _NONE where they make none (or an id is negative)."""
        key = left * self.width + right
        key[(left < 0) | (right < 0)] = -2
        at, mask = self._home(key), (1 << self.bits) - 1
        out = np.where(self.slots[at] == key, self.values[at], _NONE)
        open_ = np.flatnonzero((self.slots[at] != key) & (self.slots[at] >= 0) & (key >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            where = (at[open_] + probe) & mask
            hit = self.slots[where] == key[open_]
            out[open_[hit]] = self.values[where[hit]]
            open_ = open_[~hit & (self.slots[where] >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of pieces that need trees of one size; see :meth:`encode_pieces`."""
        n, longest = len(pieces), max(map(len, pieces))
        depth = max(1, (longest - 1).bit_length())
        leaves = 1 << depth
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((n, leaves + 1), -1, np.int64)
        ids[row, col] = self.byte_ids[data]
        after = np.broadcast_to(np.arange(1, leaves + 2), (n, leaves + 1)).copy()
        before = np.broadcast_to(np.arange(-1, leaves), (n, leaves + 1)).copy()
        # leaves hold rank * leaves + position, so the smallest is the leftmost of the least rank
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, leaves)
        place = np.arange(leaves)
        tree[:, leaves:] = np.where(rank < _NONE, rank * leaves + place, _NONE)
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            below = tree[:, 2 * a : 4 * a]
            tree[:, a : 2 * a] = np.minimum(below[:, 0::2], below[:, 1::2])
        live = np.flatnonzero(tree[:, 1] < _NONE)

        def put(rows, at, value):
            node = at + leaves
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(live):
            top = tree[live, 1]
            at, made = top & (leaves - 1), top >> depth
            gone = after[live, at]
            nxt, prev = after[live, gone], before[live, at]
            ids[live, at], ids[live, gone] = made, -1
            after[live, at] = nxt
            inside = nxt <= leaves
            before[live[inside], nxt[inside]] = at[inside]
            put(live, gone, np.full(len(live), _NONE))
            right = np.where(inside, ids[live, np.minimum(nxt, leaves)], -1)
            rank = self.pair_ranks(made, right)
            put(live, at, np.where(rank < _NONE, rank * leaves + at, _NONE))
            has = np.flatnonzero(prev >= 0)
            if len(has):
                r, p = live[has], prev[has]
                rank = self.pair_ranks(ids[r, p], made[has])
                put(r, p, np.where(rank < _NONE, rank * leaves + p, _NONE))
            live = live[tree[live, 1] < _NONE]
        alive = ids >= 0
        flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A piece that is a token is that token; others are merged, grouped by the
        power of two that holds them, at most about a million leaves at once.

        One piece is never split, since merges may cross any place in it: its tree takes about 40 bytes for each leaf,
        so a piece of 16 MB without a place to split (one run of letters) takes some 700 MB of a worker."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[i] = [r]
            elif not p:
                out[i] = []
            else:
                groups.setdefault((len(p) - 1).bit_length(), []).append(i)
        for depth, members in groups.items():
            step = max(1, (1 << 20) >> depth)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self.merge([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of token ids, gathered from the concatenated vocabulary."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.all_bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()

    def encoded(self, texts: list[str]) -> list[str]:
        """For each text its ids, joined by one space.

        Pieces seen before come from two generations of caches of ``cache_size`` pieces each; pieces of more than 64 characters are
        never kept, so a cache holds some 100 MB at most."""
        split = [self.split(t) if t else [] for t in texts]
        missing = set().union(*split).difference(self.text_of)
        if len(self.text_of) + len(missing) > self.cache_size:
            self.old, self.text_of = self.text_of, {}
            missing = set().union(*split)
        for m in missing.intersection(self.old):
            self.text_of[m] = self.old[m]
        missing = list(missing.difference(self.text_of))
        numeral = self.numerals.__getitem__
        for m, ids in zip(missing, self.encode_pieces([m.encode("utf-8", "surrogatepass") for m in missing])):
            self.text_of[m] = " ".join(map(numeral, ids))
        out = [" ".join(map(self.text_of.__getitem__, pieces)) for pieces in split]
        for m in missing:
            if len(m) > 64:
                del self.text_of[m]
        return out


def _numbers(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32)


_LOADED: dict[tuple[bytes, str], Tokenizer] = {}


def _tokenizer(rank_lines: bytes, pattern: str) -> Tokenizer:
    """One tokenizer per Python worker."""
    key = (hashlib.sha256(rank_lines).digest(), pattern)
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(rank_lines, pattern)
    return _LOADED[key]


def _portions(texts: list[str], most: int = 500_000):
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


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with an array<int> of token ids (a column of that name is replaced).

    Each match of ``pattern`` is encoded separately, without special tokens. Null and empty texts
    give an empty array. The rank file is read once by the driver; its fixed content goes along.
    """
    lines = docs.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())
    keep = [c for c in docs.columns if c != out_col]

    def run(batches):
        tok = _tokenizer(lines.value, pattern)
        for b in small_batches(batches):
            out = []
            for texts in _portions([t or "" for t in b.column(b.num_columns - 1).to_pylist()]):
                out += [_numbers(joined) for joined in tok.encoded(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], out_col])

    schema = docs.select(*keep).withColumn(out_col, F.expr("cast(array() as array<int>)")).schema
    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh_name(docs, "text"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its token ids; null ids give empty bytes."""
    lines = encoded.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())
    keep = [c for c in encoded.columns if c != out_col]

    def run(batches):
        tok = _tokenizer(lines.value, "")
        for b in batches:
            out = [tok.decode(np.array(ids or [], np.int32)) for ids in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], out_col])

    schema = encoded.select(*keep).withColumn(out_col, F.lit(b"")).schema
    return encoded.select(*keep, F.col(ids_col).alias(fresh_name(encoded, "ids"))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens long, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the bytes that the ids decode to).

    Encodes and decodes in one pass; the ids never leave the worker. Null texts are empty: no
    tokens, digests of nothing. Repeated rows are repeated; an empty table gives an empty result; further columns are
    ignored. Very long texts are encoded alone, a piece at a time (see :meth:`Tokenizer.encode_pieces` for single long pieces).
    """
    lines = docs.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())

    def run(batches):
        tok = _tokenizer(lines.value, pattern)
        for b in small_batches(batches):
            n, ids, back = [], [], []
            for texts in _portions([t or "" for t in b.column(1).to_pylist()]):
                for joined in tok.encoded(texts):
                    numbers = _numbers(joined)
                    n.append(len(numbers))
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(tok.decode(numbers)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
