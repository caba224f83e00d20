"""Approximate nearest neighbours by additive quantisation, for the inner product.

A vector is its norm and a direction; the direction is a sum of one word from each of several
codebooks, all of full dimension. Codebooks start as k-means of successive residuals and are then
fitted together by least squares; codes are found by beam search. A query meets each codebook once
(its lookup table); the score of a stored vector is its norm times a sum of table entries. The best
of a query by that score are scored again exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.llm.common import cut, tasks_for
from spanwatch.llm.vectors import group_means, kmeans, matrix, usable


class Codebooks:
    def __init__(self, sample: np.ndarray, books: int = 24, words: int = 256, beam: int = 4, rounds: int = 1, sweeps: int = 4):
        """Fit on ``sample`` rows; with few rows the codebooks have fewer words."""
        x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
        words = int(np.clip(len(x) // 16, 1, words))
        self.beam, self.words, residual = beam, words, x.copy()
        found = []
        for m in range(books):
            c = kmeans(residual, words, seed=m + 1)
            residual -= c[np.argmin((c**2).sum(1) - 2 * residual @ c.T, axis=1)]
            found.append(np.pad(c, ((0, words - len(c)), (0, 0))))
        self.books = np.stack(found).astype(np.float32)
        for _ in range(rounds if len(x) > words else 0):
            codes = self.encode(x)
            whole = sum(c[codes[:, m]] for m, c in enumerate(self.books))
            for _ in range(sweeps):  # least squares, one codebook at a time
                for m, c in enumerate(self.books):
                    rest = x - whole + c[codes[:, m]]
                    better = group_means(rest, codes[:, m], c)
                    whole += better[codes[:, m]] - c[codes[:, m]]
                    self.books[m] = better

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x books) of unit vectors: at each codebook the ``beam`` best sums go on."""
        n, books = len(x), len(self.books)
        residual, codes = x.astype(np.float32)[:, None], np.zeros((n, 1, 0), np.int64)
        for c in self.books:
            cost = (residual**2).sum(2)[:, :, None] - 2 * residual @ c.T + (c**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
            parent, word = best // len(c), best % len(c)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, parent], word[:, :, None]], axis=2)
            residual = residual[rows, parent] - c[word]
        return codes[np.arange(n), np.argmin((residual**2).sum(2), axis=1)]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Lookup tables: (books x words) rows, one column per query."""
        return self.books.reshape(-1, self.books.shape[2]) @ queries.astype(np.float32).T


def looked_up(tables: np.ndarray, words: int, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Scores of all rows for all queries (columns of ``tables``): the norm times a sum of table entries."""
    places = codes.astype(np.int64) + np.arange(codes.shape[1]) * words
    s = tables[places[:, 0]].copy()
    for m in range(1, places.shape[1]):
        s += tables[places[:, m]]
    return s * norms[:, None]


class Shortlist:
    """For each query the ``size`` rows with the largest looked-up scores among the blocks seen so far; of equal
    scores at the end of a list any may stay."""

    def __init__(self, size: int):
        self.size, self.scores, self.rows = size, None, []

    def add(self, scores: np.ndarray, *columns: np.ndarray) -> None:
        """Scores (rows x queries) and the columns that name the rows."""
        s = scores.T
        rows = [np.broadcast_to(c, s.shape) for c in columns]
        if self.scores is not None:
            s, rows = np.concatenate([self.scores, s], axis=1), [np.concatenate(x, axis=1) for x in zip(self.rows, rows)]
        if s.shape[1] > self.size:
            top = np.argpartition(-s, self.size - 1, axis=1)[:, : self.size]
            s, rows = np.take_along_axis(s, top, 1), [np.take_along_axis(x, top, 1) for x in rows]
        self.scores, self.rows = s, rows


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = 8_192,
    books: int = 24, words: int = 256, beam: int = 4, target_recall: float = 0.99, probes: int = 64, query_rows: int = 512, block_rows: int = 65_536,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products for each row of ``queries`` (the same
    columns): query_id, rank (from 1), vec_id, score (in double precision on the original vectors).

    All candidates if there are fewer; ties go to the smaller id; a query never finds its own id.
    Rows whose id is null, or whose vector is null, zero or holds null or non-finite components, take
    no part on either side; vectors of other lengths than the query's are no candidates. Repeated
    rows (same id and vector) count once. An id with several vectors is one candidate with its best score, and as
    a query asks with the vector of the smallest hash. Empty tables give an empty result; columns beside the two
    named ones are ignored, whatever their names.

    The codebooks are fitted on at most ``train_rows`` rows (smallest hashes); all rows are
    encoded. Of equal vectors only the k + 1 smallest ids can be among a query's k best, so only
    these are searched: that loses nothing and keeps groups of copies small. How many rows of each
    query are scored exactly is measured, see :func:`_needed`, so it grows with the table where it must.
    """
    spark = vectors.sparkSession
    tidy = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    named = lambda df: df.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")).withColumn("dim", F.size("v"))
    rows = named(tidy(vectors)).dropDuplicates(["h1", "h2", "vec_id"])
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    rows = cut(rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r"), "additive-rows")
    one = named(tidy(queries)).groupBy("vec_id").agg(F.min_by(F.struct("v", "dim"), F.struct("h1", "h2")).alias("x"))
    asked = cut(one.select("vec_id", "x.*"), "additive-queries")
    found = None
    for dim, count in asked.groupBy("dim").count().collect():  # one row per length of vector
        part = _search_dim(spark, rows.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), count, k, train_rows, books, words, beam, target_recall, probes, query_rows, block_rows)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _needed(index: DataFrame, asked: DataFrame, model, k: int, target_recall: float, probes: int) -> int:
    """How long a shortlist must be to hold the share ``target_recall`` of the true k best, measured on ``probes`` of
    the queries (smallest hashes) against all rows: first their true k best, then how many rows look better
    than each of these. Never under 20 k rows. Two passes over the index, both combined in the tasks."""
    few = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).toArrow()
    ids, q = few.column("vec_id").to_numpy(), matrix(few.column("v"))
    tables = np.ascontiguousarray(model.value.tables(q))
    share = index.sparkSession.sparkContext.broadcast((ids, q, tables))  # at most ``probes`` queries

    def guessed(part):
        codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint16).reshape(part.num_rows, -1)
        return looked_up(share.value[2], model.value.words, codes, part.column("norm").to_numpy())

    def parts(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                yield b.slice(at, 4096)

    def best(batches):
        kept = Shortlist(k)
        for b in parts(batches):
            ids, q, _ = share.value
            exact = matrix(b.column("v")) @ q.T
            own = b.column("vec_id").to_numpy()[:, None] == ids[None]
            exact[own] = -np.inf
            scores, guess = kept.scores, guessed(b)
            s = exact.T if scores is None else np.concatenate([scores, exact.T], axis=1)
            g = guess.T if scores is None else np.concatenate([kept.rows[0], guess.T], axis=1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            kept.scores, kept.rows = np.take_along_axis(s, top, 1), [np.take_along_axis(g, top, 1)]
        if kept.scores is not None:
            n = kept.scores.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), n)), pa.array(kept.scores.ravel()), pa.array(kept.rows[0].ravel().astype(np.float64))], ["q", "score", "guess"])

    w = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("guess"))
    true = index.mapInArrow(best, "q long, score double, guess double").where("score > double('-inf')")
    true = true.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "guess").toArrow()  # probes x k rows
    if not true.num_rows:
        return k
    who, guess = true.column("q").to_numpy(), true.column("guess").to_numpy()

    def better(batches):
        count = np.zeros(len(who), np.int64)
        for b in parts(batches):
            s = np.sort(guessed(b).astype(np.float64), axis=0)
            for j in np.unique(who):
                at = who == j
                count[at] += len(s) - np.searchsorted(s[:, j], guess[at], side="left")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(who))), pa.array(count)], ["n", "rank"])

    ranks = index.mapInArrow(better, "n long, rank long").groupBy("n").agg(F.sum("rank").alias("rank")).toArrow().column("rank").to_numpy()
    return max(20 * k, int(np.quantile(ranks, target_recall, method="higher")) + 1)


def _search_dim(spark, rows, asked, n_queries, k, train_rows, books, words, beam, target_recall, probes, query_rows, block_rows):
    sample = rows.orderBy(F.xxhash64("vec_id", "h1"), "vec_id", "h1").select("v").limit(train_rows).toArrow()
    if sample.num_rows == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(Codebooks(matrix(sample.column(0)), books, words, beam))  # books x words centres

    def encode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = matrix(part.column("v"))
                norms = np.linalg.norm(x, axis=1)
                codes = model.value.encode(x / norms[:, None]).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))], [*part.schema.names, "code", "norm"])

    count = rows.count()
    plain = rows.select("vec_id", "h1", "h2", "v").repartition(tasks_for(spark, -(-count // 2048), 32))
    index = cut(plain.mapInArrow(encode, plain.withColumn("code", F.lit(b"")).withColumn("norm", F.lit(0.0).cast("float")).schema), "additive-index")
    short = _needed(index, asked, model, k, target_recall, probes)
    n_groups = max(1, -(-n_queries // query_rows))
    n_blocks = max(-(-count // block_rows), tasks_for(spark, -(-count // 4096), block_rows // 4096))
    # blocks that one task reads for a group of queries, so that its shortlist covers them all: with few groups, few blocks
    n_runs = min(n_blocks, -(-4 * spark.sparkContext.defaultParallelism // n_groups))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    stored = index.groupBy(deal(n_blocks).alias("block")).agg(*[F.collect_list(c).alias(c) for c in ("vec_id", "h1", "h2", "code", "norm")])
    groups = asked.groupBy(deal(n_groups).alias("g")).agg(F.collect_list("vec_id").alias("qids"), F.collect_list("v").alias("qv"))
    # a stated query set against all rows, block by block
    spread = stored.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("g")).join(groups, "g")
    spread = spread.withColumn("run", F.pmod("block", F.lit(n_runs))).repartition(n_groups * n_runs, "g", "run").sortWithinPartitions("g", "run")

    def scan(batches):
        now, kept, qids = None, None, None

        def done():
            width = kept.scores.shape[1]
            ids, h1, h2 = (x.ravel() for x in kept.rows)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, width)), pa.array(ids), pa.array(h1), pa.array(h2), pa.array(kept.scores.ravel().astype(np.float32))], ["query_id", "vec_id", "h1", "h2", "guess"])

        for b in batches:
            for i in range(b.num_rows):
                number = lambda c: b.column(c)[i].values.to_numpy()
                key = (b.column("g")[i].as_py(), b.column("run")[i].as_py())
                if key != now:
                    if now is not None:
                        yield done()
                    now, kept, qids = key, Shortlist(short + 1), number("qids")
                    tables = np.ascontiguousarray(model.value.tables(matrix(b.column("qv")[i].values)))
                columns, norms = [number(c) for c in ("vec_id", "h1", "h2")], number("norm")
                codes = np.frombuffer(b"".join(b.column("code")[i].values.to_pylist()), np.uint16).reshape(len(norms), -1)
                for at in range(0, len(norms), 4096):
                    part = slice(at, at + 4096)
                    kept.add(looked_up(tables, model.value.words, codes[part], norms[part]), *(c[part] for c in columns))
        if now is not None:
            yield done()

    guesses = spread.mapInArrow(scan, "query_id long, vec_id long, h1 long, h2 long, guess float").where("query_id <> vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("guess"), "vec_id", "h1")
    few = guesses.withColumn("r", F.row_number().over(best)).where(F.col("r") <= short).select("query_id", "vec_id", "h1", "h2")
    listed = few.join(index.select("vec_id", "h1", "h2", "v"), ["vec_id", "h1", "h2"]).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
    pairs = listed.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def rerank(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, q = b.column("ids")[i].values.to_numpy(), matrix(b.column("q").slice(i, 1))[0]
                s = (matrix(b.column("vs")[i].values) * q).sum(axis=1)
                order = np.lexsort((ids, -s))
                top = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]  # an id counts once
                qid = b.column("query_id")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * len(top), pa.int64()), pa.array(np.arange(1, len(top) + 1, dtype=np.int32)), pa.array(ids[top]), pa.array(s[top])], ["query_id", "rank", "vec_id", "score"]
                )

    return pairs.mapInArrow(rerank, "query_id long, rank int, vec_id long, score double")
