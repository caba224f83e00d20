"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, learned by boosting shallow trees on one
feature after the other in turn; the strongest pairs then get two-dimensional tables, learned in
the same way on what the single features leave over. A score is the sigmoid of a sum of table
entries, added for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import fresh_name, small_batches

#: What is measured in a text; shares are of its bytes, words or lines.
FEATURES = (
    "log_words", "word_length", "longest_word", "upper", "digits", "spaces", "newlines", "sentence_marks", "marks", "symbols",
    "pipes", "exclaims", "beyond_ascii", "distinct_words", "top_word", "short_words", "marked_words", "repeated_lines", "line_words", "links",
)
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(text: str | None) -> list[float]:
    """The measures named in FEATURES, over the whole text; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    last = np.frombuffer(b"".join([w[-1:] for w in words]) or b" ", np.uint8)
    of = lambda chars: float(sum(count[c] for c in chars)) / n
    return [
        float(np.log1p(len(words))), float(lengths.mean()), float(lengths.max()), float(count[_UPPER].sum()) / n, float(count[_DIGIT].sum()) / n,
        of(b" \t"), of(b"\n"), of(b".,;:?"), float(count[_MARK].sum()) / n, of(b"#$%&*@^~=+"), of(b"|"), of(b"!"), float(count[128:].sum()) / n,
        len(seen) / m, max(seen.values(), default=0) / m, float((lengths <= 3).mean()), float(_MARK[last].mean()),
        1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), (raw.count(b"http") + raw.count(b"www.")) / m,
    ]


@dataclass
class Gam:
    """edges: bin limits per feature; tables: one value per bin; pairs: (i, j, coarse edges of both, table)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, ei, ej, table in self.pairs:
            z += table[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-z))


def _limits(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin limits between distinct values, at even shares of the rows."""
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return cuts[cuts > x.min()]


def _split(g: np.ndarray, h: np.ndarray, lam: float):
    """Best cut of a run of bins into two: (gain, position)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - g.sum() ** 2 / (h.sum() + lam)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float, leaves: int) -> np.ndarray:
    """Values per bin of a tree with up to ``leaves`` leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, p = max(((*_split(g[a:b], h[a:b], lam), k) for k, (a, b) in enumerate(parts)), key=lambda t: t[0])
        if gain <= 1e-9:
            break
        a, b = parts[p]
        parts[p : p + 1] = [(a, a + at), (a + at, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, lam: float):
    """Best pair of cuts of a grid of bins, one on each axis: (gain, row, column, values per cell)."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, 0, 0, np.zeros_like(g)
    corner = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gain = sum(a**2 / (b + lam) for a, b in zip(corner(gc), corner(hc))) - gc[-1, -1] ** 2 / (hc[-1, -1] + lam)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows in (slice(0, r + 1), slice(r + 1, None)):
        for cols in (slice(0, c + 1), slice(c + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + lam)
    return float(gain[r, c]), r, c, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.15, lam: float = 2.0, leaves: int = 3, n_pairs: int = 8, pair_bins: int = 8) -> Gam:
    """Cyclic boosting on the logistic loss. Without rows, or with one class, the model is a constant."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Gam(base, [np.zeros(0)] * k, [np.zeros(1)] * k, [])
    edges = [_limits(x[:, i], bins) for i in range(k)]
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(n, base)
    for _ in range(rounds):
        for i in range(k):
            p = 1 / (1 + np.exp(-z))
            size = len(tables[i])
            step = rate * _tree(np.bincount(at[i], y - p, size), np.bincount(at[i], p * (1 - p), size), lam, leaves)
            tables[i] += step
            z += step[at[i]]
    coarse = [_limits(x[:, i], pair_bins) for i in range(k)]
    cell = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(coarse)]

    def grid(i, j):
        p = 1 / (1 + np.exp(-z))
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cell[i] * shape[1] + cell[j]
        total = shape[0] * shape[1]
        return np.bincount(flat, y - p, total).reshape(shape), np.bincount(flat, p * (1 - p), total).reshape(shape)

    ranked = sorted(((-_quadrants(*grid(i, j), lam)[0], i, j) for i in range(k) for j in range(i)))[:n_pairs]
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked if gain < -1e-9]
    for _ in range(rounds // 2):
        for i, j, table in chosen:
            step = rate * _quadrants(*grid(i, j), lam)[3]
            table += step
            z += step[cell[i], cell[j]]
    return Gam(base, edges, tables, [(i, j, coarse[i], coarse[j], t) for i, j, t in chosen])


def held_out(doc_id):
    """True for rows whose labels are never learned: crc32(doc_id as text) mod 3 is 1 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> Gam:
    """Fit on the labelled rows outside the held-out third; of more than ``max_rows`` ids those with the
    smallest hashes. An id counts once: with its smaller label and the text of the smallest hash, if it has several. The
    sample bounds what is broadcast and what the driver gets."""
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches):
        for b in batches:
            x = pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), x], ["doc_id", "y", "h", "x"])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")).join(F.broadcast(sample), "doc_id")
    each = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text", "h").mapInArrow(run, "doc_id long, y int, h long, x array<double>")
    got = each.groupBy("doc_id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("r.y", "r.x").toArrow()  # at most max_rows rows
    x = np.array(got.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column(0).to_pylist(), float) > 0.5
    order = np.lexsort([*x.T, y])  # the order of arrival does not matter
    return fit(x[order], y[order].astype(float), **options)


def score(docs: DataFrame, model: Gam, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the model's score, 0 to 1, higher for quality; null and empty texts have one too, very long
    ones are measured whole. A column named ``out_col`` is replaced; repeated rows are repeated; empty tables stay empty."""
    keep = [c for c in docs.columns if c != out_col]

    def run(batches):
        for b in small_batches(batches):
            x = np.array([features(t) for t in b.column(b.num_columns - 1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], names=[*b.schema.names[:-1], out_col])

    schema = docs.select(*keep).withColumn(out_col, F.lit(0.0)).schema
    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh_name(docs, "text"))).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 if score >= ``threshold``)."""
    model = train(docs, labels, **options)
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier does not reject, columns as they were, whatever their names."""
    model, name = train(docs, labels, **options), fresh_name(docs, "score")
    return score(docs, model, out_col=name).where(F.col(name) >= threshold).select(*docs.columns)
