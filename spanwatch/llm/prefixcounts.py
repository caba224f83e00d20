"""Token counts at every prefix of a text, by dynamic programming.

A byte-level BPE encodes any prefix of a piece so that its last token is the only token t with two properties: the
prefix ends with t, and t stays beside the last token of the prefix before it (no merge ever crosses the place where they
meet). So the last token and the count of each prefix follow from shorter prefixes, and one pass over a piece tells
the count of all of them. The table of a text then answers how many tokens its first n characters have, which
prefix is the longest within a budget, and how many tokens the text has, without encoding anything again.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from operator import sub
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import fresh_name, small_batches

_NEVER = 1 << 62
# The split of byte-level vocabularies (fixed values).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Runs of those pieces whose prefixes don't depend on what stands around them: white space of two and more goes with the piece after it.
UNITS = (
    r"""'s|'t|'re|'ve|'m|'ll|'d|\s+ (?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s\s+(?:'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)?"""
    r"""| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
)
_BLANK = regex.compile(r"\s*")
_STAND_INS = ("a", "1", "\t", "-")


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the others are numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class PrefixCounter:
    """Counts of all prefixes under a byte-level BPE as the JSON file of the tokenizers library states it.

    Tokens are numbered in the order in which merges make them, bytes first. ``cache_bytes`` bounds what is kept
    of runs seen before (about); runs of more than 64 characters are never kept.
    """

    def __init__(self, content: bytes, cache_bytes: int = 96 << 20):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        bare = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        if not (model["type"] == "BPE" and plain and byte_level and bare and spec["normalizer"] is None):
            raise ValueError("a byte-level BPE without a normalizer and with bare special tokens is asked for")
        byte = byte_of_symbol()
        number = {bytes([b]): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            one, two = bytes(map(byte.__getitem__, a)), bytes(map(byte.__getitem__, b))
            made = number.setdefault(one + two, len(self.left))
            if made == len(self.left):
                self.left.append(number[one])
                self.right.append(number[two])
            self.pairs.setdefault((number[one], number[two]), made)
        # a token that a merge across its own halves would break up never ends a prefix
        self.tokens = ahocorasick.Automaton()
        for t, n in number.items():
            if n < 256 or self._apart(self.left[n], self.right[n], halves=True):
                self.tokens.add_word(t.decode("latin-1"), (n, len(t)))
        self.tokens.make_automaton()
        self.beside: dict[int, bool] = {}
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.library = Tokenizer.from_str(content.decode()).pre_tokenizer
        self.pieces, self.units = regex.compile(PIECES).findall, regex.compile(UNITS).findall
        self.known, self.stand_in = set(map(chr, range(128))), {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_bytes, self.kept = cache_bytes, 0

    def _apart(self, a: int, b: int, halves: bool = False) -> bool:
        """Whether no merge crosses the place between tokens a and b, at whatever time of their making. ``halves``:
        but for the merge of a and b themselves."""
        until_a = until_b = _NEVER
        while True:
            made = self.pairs.get((a, b), _NEVER)
            # of equal merges the left one comes first
            if made < until_a and made <= until_b and not halves:
                return False
            if a < 256 and b < 256:
                return True
            if halves:
                until_a = until_b = made
                halves = False
            if a > b:
                until_a, a = min(a, until_a), self.right[a]
            else:
                until_b, b = min(b, until_b), self.left[b]

    def piece(self, data: bytes) -> list[int]:
        """Tokens of each prefix of a piece, by bytes; the first entry is that of the empty prefix."""
        last, count, beside, told = [-1] * (len(data) + 1), [0] * (len(data) + 1), self.beside, -1
        for end, (token, length) in self.tokens.iter(data.decode("latin-1")):  # all tokens that end at each byte
            if end == told:
                continue
            start = end + 1 - length
            if start:
                pair = last[start] << 20 | token
                stays = beside.get(pair)
                if stays is None:
                    stays = beside[pair] = self._apart(last[start], token)
                if not stays:
                    continue
            last[end + 1], count[end + 1], told = token, count[start] + 1, end
        if len(beside) > 500_000:
            beside.clear()
        return count

    def characters(self, text: str) -> list[int]:
        """Like :meth:`piece`, but at the ends of characters."""
        data = text.encode("utf-8")
        count = self.piece(data)
        return count if len(data) == len(text) else [c for c, b in zip(count, data + b"a") if b & 0xC0 != 0x80]

    def unit(self, text: str, shape: str) -> bytes:
        """What each character of a run adds to the count (int32). ``shape`` is the run as it is split."""
        if not shape[:2].isspace() and shape not in ("'re", "'ve", "'ll"):  # one piece
            counts = self.characters(text)
        else:
            run, counts, at = _BLANK.match(shape).end(), [0], 0
            for part in self.pieces(shape):
                before, inside = counts[-1], self.characters(text[at : at + len(part)])
                if part in ("'re", "'ve", "'ll"):
                    inside[2] = 2  # cut there it is an apostrophe and a letter
                counts += [before + n for n in inside[1:]]
                at += len(part)
            counts[: run + 1] = self.characters(text[:run])  # white space at the end of a text is one piece
        return array("i", map(sub, counts[1:], counts)).tobytes()

    def shape(self, text: str) -> str:
        """The text for the split: characters that this module's expressions take for another class than the library
        does (they know another Unicode version) are replaced by one of the library's class."""
        if text.isascii():
            return text
        fresh = set(text) - self.known
        for c in fresh:
            self.known.add(c)
            probe = f"a{c}1{c}-{c}{c} b {c}"
            told = [probe[a:b] for _, (a, b) in self.library.pre_tokenize_str(probe)]
            if told != self.pieces(probe):
                for s in _STAND_INS:
                    same = probe.replace(c, s)
                    if [same[a:b] for _, (a, b) in self.library.pre_tokenize_str(same)] == [p.replace(c, s) for p in told]:
                        self.stand_in[ord(c)] = s
                        break
        return text.translate(self.stand_in) if self.stand_in else text

    def _plain(self, text: str) -> np.ndarray:
        shape = self.shape(text)
        units = self.units(shape)
        if shape is text or shape == text:
            get, out = self.recent.get, []
            for u in units:
                d = get(u)
                out.append(self._kept(u) if d is None else d)
        else:
            out, at = [], 0
            for u in units:
                out.append(self.unit(text[at : at + len(u)], u))
                at += len(u)
        return np.frombuffer(b"".join(out), np.int32)

    def _kept(self, unit: str) -> bytes:
        out = self.older.get(unit)
        if out is None:
            out = self.unit(unit, unit)
        if len(unit) <= 64:
            self.kept += 150 + 8 * len(unit)
            if self.kept > self.cache_bytes // 2:
                self.older, self.recent, self.kept = self.recent, {}, 0
            self.recent[unit] = out
        return out

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:1], text[:2] and so on to the whole text, int64."""
        if not text:
            return np.zeros(0, np.int64)
        found = list(self.specials.finditer(text)) if self.specials else []
        out, start, before = [], 0, 0
        for m in found:
            # until its last character a special token is ordinary text
            part = before + np.cumsum(self._plain(text[start : m.end() - 1]), dtype=np.int64)
            at = m.start() - start
            before = (int(part[at - 1]) if at else before) + 1
            out += [part, np.array([before], np.int64)]
            start = m.end()
        if start < len(text):
            out.append(before + np.cumsum(self._plain(text[start:]), dtype=np.int64))
        return np.concatenate(out)


_LOADED: dict[bytes, PrefixCounter] = {}


def _counter(content: bytes) -> PrefixCounter:
    """One per Python worker."""
    key = hashlib.sha256(content).digest()
    if key not in _LOADED:
        _LOADED[key] = PrefixCounter(content)
    return _LOADED[key]


def prefix_counts(docs: DataFrame, vocab_file: str, text_col: str = "text", out_col: str = "prefix_tokens") -> DataFrame:
    """``docs`` with ``out_col`` array<int>: entry n is the number of tokens of the first n + 1 characters (code points).

    Counts are those of the tokenizers library for the vocabulary file without added begin or end tokens; a special token's
    string is one token where it is whole, ordinary text where a prefix ends inside it. Null and empty texts have an empty
    array; repeated rows are counted each; a column named ``out_col`` is replaced; other columns ride along; an empty table
    stays empty. One pass without a shuffle; memory grows with one text, never with the table.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(vocab_file).read_bytes())
    keep = [c for c in docs.columns if c != out_col]

    def run(batches):
        counter = _counter(content.value)
        for b in small_batches(batches, 64):
            told = [counter.counts(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, told)])
            values = pa.array(np.concatenate([*told, np.zeros(0, np.int64)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], out_col])

    schema = docs.select(*keep).withColumn(out_col, F.expr("cast(array() as array<int>)")).schema
    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh_name(docs, "text"))).mapInArrow(run, schema)


def tokens_of(prefix_tokens: str, characters: Column) -> Column:
    """Tokens of the first ``characters`` characters, from a column that :func:`prefix_counts` made; beyond the end: of all of them."""
    n = F.least(characters, F.size(prefix_tokens))
    return F.when(n > 0, F.get(prefix_tokens, (n - 1).cast("int"))).otherwise(0)


def longest_within(prefix_tokens: str, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from a column that :func:`prefix_counts` made. A longer
    prefix may have fewer tokens than a shorter one, so all are looked at."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))


def truncate(docs: DataFrame, vocab_file: str, budget: int, text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens. Null texts stay null."""
    name = fresh_name(docs, "prefix_tokens")
    counted = prefix_counts(docs, vocab_file, text_col, name)
    cut = F.when(F.col(text_col).isNotNull(), F.substring(F.col(text_col), F.lit(1), longest_within(name, F.lit(budget))))
    return counted.withColumn(text_col, cut).drop(name)


def report(docs: DataFrame, vocab_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens), fits_chars (characters of the
    longest prefix within the limit).

    The prefix table of a text is made, asked and dropped in the worker. Null texts are empty: no bytes, no tokens.
    Null and repeated ids stay as they are; further columns are ignored; an empty table gives an empty result.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(vocab_file).read_bytes())

    def run(batches):
        counter = _counter(content.value)
        for b in small_batches(batches):
            size, total, fits = [], [], []
            for t in b.column(1).to_pylist():
                counts = counter.counts(t or "")
                size.append(len(t.encode()) if t else 0)
                total.append(int(counts[-1]) if len(counts) else 0)
                within = np.flatnonzero(counts <= limit)
                fits.append(int(within[-1]) + 1 if len(within) else 0)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, long), pa.array(total, long), pa.array([n > limit for n in total], pa.bool_()), pa.array(fits, long)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")
