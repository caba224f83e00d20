"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one per half of the vectors, form a product grid of cells. A vector visits cells from
the nearest on, by the multi-sequence order over its two lists of distances, until the distance that
holds the target recall; the vectors of visited cells are then verified by their cosine in double
precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import connected_components, cut
from spanwatch.llm.simhash import _hook
from spanwatch.llm.vectors import kmeans, matrix, usable


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Grid:
    """Codebooks of both halves, and the distance up to which cells are visited.

    The distance of a vector to a cell is the sum over the halves of the squared distance to the plane
    that parts the cell's centre from the vector's own centre: what a partner has to cover at least to
    lie in that cell. It never exceeds the squared distance of two vectors, so a reach of 2 - 2 x threshold
    loses nothing; the reach is the share ``target_recall`` of the distances to cells of partners at
    exactly the threshold, in random directions, or of the links inside the sample if those are farther."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, target_recall: float, draws: int = 4):
        x = _unit(sample)
        self.half = x.shape[1] // 2
        self.books = kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k, seed=8)
        # a row at a time: k x k distances, never k x k differences
        self.gaps = [np.stack([np.sqrt(np.maximum(((c - one) ** 2).sum(1), 1e-300)) for one in c]) for c in self.books]
        self.reach = limit = 2 - 2 * threshold
        if target_recall < 1 and x.shape[1] > 1:
            own, one, two = self.distances(x)
            far, r = [], np.random.default_rng(9)
            for _ in range(draws):
                other = r.normal(size=x.shape)
                other -= (other * x).sum(1, keepdims=True) * x
                cells = self.cells(threshold * x + np.sqrt(1 - threshold**2) * _unit(other))
                far.append(one[np.arange(len(x)), cells[:, 0]] + two[np.arange(len(x)), cells[:, 1]])
            found = []
            for at in range(0, len(x), 1024):
                i, j = np.nonzero(x[at : at + 1024] @ x.T >= threshold)
                found.append(one[i + at, own[j, 0]] + two[i + at, own[j, 1]])
            reach = max(np.quantile(np.concatenate(f), target_recall, method="higher") for f in (far, found))
            self.reach = float(min(limit, reach)) + 1e-12

    def distances(self, x: np.ndarray):
        """(cells of the rows, distances to the first centres, to the second centres)."""
        own, out = [], []
        for y, c, gap in zip((x[:, : self.half], x[:, self.half :]), self.books, self.gaps):
            d = (c**2).sum(1) - 2 * y @ c.T
            near = np.argmin(d, axis=1)
            beyond = (d - d[np.arange(len(y)), near][:, None]) / (2 * gap[near])
            beyond[np.arange(len(y)), near] = 0
            own.append(near)
            out.append(beyond**2)
        return np.stack(own, axis=1), *out

    def cells(self, x: np.ndarray) -> np.ndarray:
        halves = zip((x[:, : self.half], x[:, self.half :]), self.books)
        return np.stack([np.argmin((c**2).sum(1) - 2 * y @ c.T, axis=1) for y, c in halves], axis=1)

    def traverse(self, one: np.ndarray, two: np.ndarray):
        """Cells (distance, i, j) of one vector from the nearest on: the multi-sequence algorithm over its
        two lists of distances."""
        a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        heap, seen = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}
        while heap:
            d, i, j = heapq.heappop(heap)
            yield d, int(a[i]), int(b[j])
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < len(b) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (one[a[p]] + two[b[q]], p, q))

    def visits(self, one: np.ndarray, two: np.ndarray):
        """(row, i, j) of the cells that :meth:`traverse` meets, for many vectors in step, each from its nearest cell on until the next one lies
        beyond the reach (the distance that holds the target recall).

        A vector's open cells are, for each first centre that it has come to, the next second centre; a step takes the nearest of
        them, moves that first centre on, and opens the next first centre when one is taken for the first time."""
        a, b = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        d1, d2 = np.take_along_axis(one, a, 1), np.take_along_axis(two, b, 1)
        live, width = np.arange(len(one)), two.shape[1]
        at = np.zeros(one.shape, np.int64)
        ahead = np.full(one.shape, np.inf)
        ahead[:, 0] = d1[:, 0] + d2[:, 0]
        rows, first, second, opened = [], [], [], 1
        while True:
            p = np.argmin(ahead[live, :opened], axis=1)
            on = ahead[live, p] <= self.reach
            live, p = live[on], p[on]
            if not len(live):
                break
            q = at[live, p]
            rows.append(live)
            first.append(a[live, p])
            second.append(b[live, q])
            fresh = (q == 0) & (p + 1 < one.shape[1])
            ahead[live[fresh], p[fresh] + 1] = d1[live[fresh], p[fresh] + 1] + d2[live[fresh], 0]
            opened = max(opened, int(p[fresh].max()) + 2) if fresh.any() else opened
            at[live, p] = q + 1
            ahead[live, p] = np.where(q + 1 < width, d1[live, p] + d2[live, np.minimum(q + 1, width - 1)], np.inf)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, first, second))


def compare(grid: Grid, x: np.ndarray, x_nodes, x_copies, y: np.ndarray, y_nodes, y_copies, threshold: float):
    """Links between the visitors ``x`` and the stored vectors ``y`` of the cells that they visit.

    A visitor looks into its own cell (at larger nodes only) and into later ones, so a pair is compared
    once. Returns links per visitor, links per stored vector, labels that join linked rows (rows of y
    follow those of x), and the number of pairs compared."""
    x, y = _unit(x), _unit(y)
    own, one, two = grid.distances(x)
    k = len(grid.books[1])
    place_x, cells_y = own[:, 0] * k + own[:, 1], grid.cells(y)
    place_y = cells_y[:, 0] * k + cells_y[:, 1]
    row, i, j = grid.visits(one, two)
    to = i * k + j
    stored = np.unique(place_y)
    keep = (to >= place_x[row]) & (stored[np.minimum(np.searchsorted(stored, to), len(stored) - 1)] == to)
    row, to = row[keep], to[keep]
    by_cell, by_y = np.argsort(to, kind="stable"), np.argsort(place_y, kind="stable")
    row, to = row[by_cell], to[by_cell]
    links_x, links_y, label, pairs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.arange(len(x) + len(y)), 0
    cells, starts = np.unique(to, return_index=True)
    edges = np.append(starts, len(to))
    low, high = np.searchsorted(place_y[by_y], cells), np.searchsorted(place_y[by_y], cells, side="right")
    for n, cell in enumerate(cells.tolist()):
        p, s = row[edges[n] : edges[n + 1]], by_y[low[n] : high[n]]
        close = x[p] @ y[s].T >= threshold
        at_home = place_x[p] == cell
        if at_home.any():
            close[at_home] &= x_nodes[p[at_home]][:, None] < y_nodes[s][None]
        pairs += close.size
        u, v = np.nonzero(close)
        if len(u):
            np.add.at(links_x, p[u], y_copies[s[v]])
            np.add.at(links_y, s[v], x_copies[p[u]])
            _hook(label, p[u], s[v] + len(x))
    return links_x, links_y, label, pairs


def centres(largest: int) -> int:
    """Centres of each half for labels of up to ``largest`` vectors: the power 0.4 of it, so cells hold about its
    power 0.2 and their number has no cap (1 only for a handful of vectors)."""
    return max(1, round(largest**0.4))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, target_recall: float = 0.9999, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", train_rows: int = 8192, block_rows: int = 2048,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors with equal, non-null labels and equal lengths are compared. Null, empty and zero
    vectors and such with null or non-finite components link with nothing. Equal vectors are one
    node with a count, so copies are never expanded into pairs; n_links counts the copies (links have no
    ties to break). Rows with a null id link but never name a component; repeated ids are rows of their own.
    An empty table gives an empty result; columns beside the three named ones are ignored, whatever their names.

    The codebooks are fitted on at most ``train_rows`` rows (smallest hashes); every row is indexed. A label's cells
    are dealt into groups of about ``block_rows`` vectors, by their first centre and, where groups outnumber the centres, the
    second one too, and a vector is sent once to
    each group that holds a cell within reach, so what is shuffled grows with the groups it visits, not with
    the cells. Larger groups (many vectors at one centre) are cut into blocks of ``block_rows``, all of
    which meet the group's visitors.
    """
    spark = vectors.sparkSession
    found, rows, distinct = links(vectors, threshold, target_recall, id_col, vector_col, label_col, train_rows, block_rows)
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "multi-index-components")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = distinct.select("node", "low", "n").join(linked, "node", "left").join(roots, "node", "left")
    lows = info.where("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    info = info.join(lows, "root", "left").selectExpr("node", "coalesce(links, 0) + n - 1 as n_links", "coalesce(least, low) as component_id")
    return (
        rows.select("vec_id", "node").join(info, "node", "left")
        .selectExpr("vec_id", "coalesce(n_links, 0) as n_links", "if(node is null, vec_id, component_id) as component_id")
        .selectExpr("vec_id", "n_links", "component_id", "coalesce(vec_id = component_id, false) as kept")
    )


def links(vectors, threshold, target_recall, id_col="vec_id", vector_col="embedding", label_col="label", train_rows=8192, block_rows=2048):
    """(found, rows, distinct): found(node, links, root, pairs) has a row for each node (distinct vector of a label)
    and pair of blocks that it was linked in, and one without a node that holds the number of pairs compared there."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    takes_part = usable(F.col("v")) & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(takes_part, F.xxhash64("label", "v")))
    distinct = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
    distinct = cut(distinct.withColumn("dim", F.size("v")), "multi-index-nodes")
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("size"))
    grids = {}
    for dim, largest in sizes.groupBy("dim").agg(F.max("size")).collect():  # one row per length of vector
        sample = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("node")).select("v").limit(train_rows).toArrow()
        grids[dim] = Grid(matrix(sample.column(0)), centres(largest), threshold, target_recall)
    grids = spark.sparkContext.broadcast(grids)  # 2 x (size of the largest label)^0.4 centres per length, and their gaps

    def send(batches):
        """Each vector as a stored one in the group of its own cell and as a visitor of the groups of the cells that it visits."""
        deal = lambda c, g: (c * 40503 + (c >> 3)) % g

        def group_of(i, j, groups, k):
            first = np.minimum(groups, k)
            return deal(i, first) + first * deal(j, -(-groups // first))

        for b in batches:
            dims, groups = b.column("dim").to_numpy(), b.column("groups").to_numpy()
            take, group, stored = [], [], []
            for d in np.unique(dims):
                at, grid = np.flatnonzero(dims == d), grids.value[int(d)]
                own, one, two = grid.distances(_unit(matrix(b.column("v").take(pa.array(at)))))
                k = len(grid.books[0])
                take.append(at)
                group.append(group_of(own[:, 0], own[:, 1], groups[at], k))
                stored.append(np.ones(len(at), bool))
                for part in range(0, len(at), 2048):
                    r, i, j = grid.visits(one[part : part + 2048], two[part : part + 2048])
                    r = r + part
                    later = i >= own[r, 0]
                    r, i, j = r[later], i[later], j[later]
                    seen = np.unique(np.stack([r, group_of(i, j, groups[at][r], k)]), axis=1)
                    take.append(at[seen[0]])
                    group.append(seen[1])
                    stored.append(np.zeros(seen.shape[1], bool))
            take = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("label", "dim", "node", "n", "v")), pa.array(np.concatenate(group).astype(np.int64)), pa.array(np.concatenate(stored))],
                ["label", "dim", "node", "n", "v", "g", "stored"],
            )

    layout = distinct.select("label", "dim", "node", "n", "v")
    asked = layout.join(sizes, ["label", "dim"]).selectExpr("label", "dim", "node", "n", "v", f"cast(ceil(size / {block_rows}) as bigint) as groups")
    sent = asked.mapInArrow(send, layout.withColumn("g", F.lit(0).cast("long")).withColumn("stored", F.lit(True)).schema)
    key = ["label", "dim", "g"]
    sent = cut(sent, "multi-index-sent")
    heavy = sent.groupBy(*key, "stored").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("parts"))
    blocks = sent.join(heavy, [*key, "stored"]).groupBy(*key, "stored", F.expr("pmod(xxhash64(node), parts)").alias("part")).agg(
        F.collect_list("node").alias("nodes"), F.collect_list("n").alias("copies"), F.collect_list("v").alias("vs")
    )
    blocks = cut(blocks, "multi-index-blocks")
    # pairs of blocks are made as numbers; vectors are attached by the blocks of one side at a time, so no task makes all pairs of a group
    tasks = max(spark.sparkContext.defaultParallelism, -(-blocks.count() // 4))
    named = lambda test, part: blocks.where(test).select(*key, F.col("part").alias(part))
    ids = named("not stored", "pa").join(named("stored", "pb"), key)
    left = blocks.where("not stored").selectExpr(*key, "part as pa", "nodes as na", "copies as ca", "vs as va")
    right = blocks.where("stored").selectExpr(*key, "part as pb", "nodes as nb", "copies as cb", "vs as vb")
    pairs = ids.join(left, [*key, "pa"]).join(right, [*key, "pb"]).repartition(tasks, *key, "pa", "pb")
    pairs = pairs.select("dim", "na", "ca", "va", "nb", "cb", "vb")

    def check(batches):
        for b in batches:
            for k in range(b.num_rows):
                number = lambda c: b.column(c)[k].values.to_numpy()
                block = lambda c: matrix(b.column(c)[k].values)
                na, nb = number("na"), number("nb")
                links_x, links_y, label, pairs = compare(grids.value[b.column("dim")[k].as_py()], block("va"), na, number("ca"), block("vb"), nb, number("cb"), threshold)
                nodes, linked = np.concatenate([na, nb]), np.concatenate([links_x, links_y])
                hit = np.flatnonzero(linked)
                column = lambda values, last: pa.array([*values.tolist(), last], pa.int64())
                zero = np.zeros(len(hit), np.int64)
                yield pa.RecordBatch.from_arrays([column(nodes[hit], None), column(linked[hit], 0), column(nodes[label[hit]], None), column(zero, pairs)], ["node", "links", "root", "pairs"])

    return cut(pairs.mapInArrow(check, "node long, links long, root long, pairs long"), "multi-index-links"), rows, distinct
