"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly with numpy exclusive-or and bit counts. The table of distinct
64-bit fingerprints is cut into tiles by the population counts of its two 32-bit halves; tile pairs
whose counts differ by more than the radius cannot hold a link and are never formed. Longer
fingerprints have radii so wide that population counts of whole tiles exclude nothing; there texts are
tiled by their number of distinct shingles, and tile pairs with too different numbers for the wanted
similarity are never formed. Inside a tile pair the test of population counts, on 16-bit quarters, skips blocks.

Short prints (one word) are nodes of the graph of links themselves. Long ones only point at texts to look at: there a node
is a distinct set of shingles, its print counts each shingle once, and a link holds where the sets share enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import connected_components, cut, fresh_name, fresh_path, scratch, small_batches, tasks_for

SEED = 42
_STEP = 32768  # shingles counted at once
_BLOCK = 512  # fingerprints compared at once


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Further hash words from the first (splitmix64 finaliser)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, width: int, step: int = _STEP):
    """XXH64 of each shingle of ``width`` words, in runs of at most ``step``. Words are runs outside ASCII white space, A-Z
    lower-cased. Fewer words than ``width`` make one shingle; no word makes none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    width = min(width, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1]
    ends, digest = ends[width - 1 :], xxhash.xxh64_intdigest
    for at in range(0, len(ends), step):
        part = zip(starts[at : at + step].tolist(), ends[at : at + step].tolist())
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def fingerprint(text: str | None, width: int = 4, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words. A bit is 1 if set in over half of the hashes of the shingles, repeats
    included. No word gives zero."""
    return _majority(shingle_hashes(text, width), words)


def _majority(runs, words: int) -> np.ndarray:
    """The bits that are set in over half of all hashes of ``runs``."""
    n, count = 0, np.zeros(64 * words, np.int64)
    for h in runs:
        n += len(h)
        for k in range(words):
            x = h if k == 0 else _mix(h, k)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(count * 2 > n, bitorder="little").view(np.uint64)


def set_print(shingles: np.ndarray, words: int) -> tuple[bytes, int]:
    """The print of a set of shingles, each counted once, and the hash that names the set."""
    runs = (shingles[at : at + _STEP] for at in range(0, len(shingles), _STEP))
    name = np.array([xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], np.uint64).view(np.int64)[0]
    return _majority(runs, words).tobytes(), int(name)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, words: int = 1) -> DataFrame:
    """One row per input row: id long, text_key long (Spark's xxhash64 of the text, of '' for null),
    fp binary (``words`` x 8 little-endian bytes), node long, shingles int (distinct ones; counted for longer prints only).

    One word: the node is the print, over all shingles. More: the node names the set of shingles, and the print counts each once, so
    that a shingle that makes up half of a text doesn't make its print."""

    def run(batches):
        for b in small_batches(batches):
            texts = b.column(1).to_pylist()
            if words == 1:
                prints = [fingerprint(t, width) for t in texts]
                nodes, sizes = [int(x.view(np.int64)[0]) for x in prints], [0] * len(texts)
                prints = [x.tobytes() for x in prints]
            else:
                sets = [shingle_set(t, width) for t in texts]
                prints, nodes = zip(*(set_print(x, words) for x in sets)) if sets else ((), ())
                sizes = list(map(len, sets))
            keys = np.fromiter((xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), SEED) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys.view(np.int64)), pa.array(prints, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32())],
                ["id", "text_key", "fp", "node", "shingles"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "id long, text_key long, fp binary, node long, shingles int"
    )


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the trees of linked nodes; every label ends as the smallest index of its tree. Returns the numbers of the
    links that merged two trees, a spanning forest of what was not joined before."""
    used, number = [], np.arange(len(i))
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return np.concatenate(used) if used else number[:0]
        i, j, a, b, number = i[differ], j[differ], a[differ], b[differ], number[differ]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        firsts = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
        label[high[firsts]] = low[firsts]  # each root is hooked once, to a smaller one
        used.append(number[firsts])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _prepared(raw: bytes, words: int, beside: int):
    """Fingerprints of a tile (and the words beside them) in the order of quarter counts, with the bounds of each block's counts."""
    rows = np.frombuffer(raw, np.uint64).reshape(-1, words + beside)
    quarters = np.bitwise_count(np.ascontiguousarray(rows[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(quarters.T)
    rows, quarters = rows[order], quarters[order]
    cuts = np.arange(0, len(rows), _BLOCK)
    return np.ascontiguousarray(rows[:, :words]), rows[:, words:].view(">i8").astype(np.int64), np.minimum.reduceat(quarters, cuts), np.maximum.reduceat(quarters, cuts)


def _close(u: np.ndarray, v: np.ndarray, radius: int):
    """(i, j, distance) of rows of ``u`` and ``v`` within ``radius`` bits."""
    far = np.bitwise_count(u[:, 0][:, None] ^ v[:, 0][None])
    for k in range(1, u.shape[1]):
        far = far.astype(np.uint16) if k == 3 else far  # a byte holds the counts of three words
        far += np.bitwise_count(u[:, k][:, None] ^ v[:, k][None])
    i, j = np.nonzero(far <= radius)
    return i, j, far[i, j].astype(np.int32)


def tile_links(a: bytes, b: bytes | None, radius: int, words: int = 1, across: bool = False):
    """Links within ``radius`` bits inside one pair of tiles (``b`` None: the tile with itself), as two arrays of nodes. Rows of tiles are
    a print of one word, which is the node, or of more words and then the node and its group.

    They make a least spanning forest by distance: every link is a real one, and what is linked in
    the pair of tiles is joined. With ``across`` they are all links between nodes of different groups."""
    beside, same = 0 if words == 1 else 2, b is None
    xa, about_a, lo_a, hi_a = _prepared(a, words, beside)
    xb, about_b, lo_b, hi_b = (xa, about_a, lo_a, hi_a) if same else _prepared(b, words, beside)
    shift = 0 if same else len(xa)
    gap = np.maximum(np.maximum(lo_a[:, None] - hi_b[None], lo_b[None] - hi_a[:, None]), 0).sum(axis=2)
    found, size = [], 0
    about = about_a if same else np.concatenate([about_a, about_b])
    nodes = about[:, 0] if beside else (xa if same else np.concatenate([xa, xb]))[:, 0].view(np.int64)

    def forest(parts):
        i, j, d = (np.concatenate(x) for x in zip(*parts))
        label, kept = np.arange(len(nodes)), []
        order = np.argsort(d, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(d[order])) + 1):
            kept.append(level[_hook(label, i[level], j[level])])
        kept = np.concatenate(kept)
        return i[kept], j[kept], d[kept]

    for p, q in np.argwhere(gap <= radius).tolist():
        if same and q < p:
            continue
        i, j, d = _close(xa[p * _BLOCK : (p + 1) * _BLOCK], xb[q * _BLOCK : (q + 1) * _BLOCK], radius)
        i, j = i + p * _BLOCK, j + q * _BLOCK + shift
        wanted = (i < j) & (about[i, 1] != about[j, 1]) if across else i < j
        found.append((i[wanted], j[wanted], d[wanted]))
        size += int(wanted.sum())
        if across and size > 100_000:
            yield tuple(nodes[np.concatenate(x)] for x in list(zip(*found))[:2])
            found, size = [], 0
        elif size > 1_000_000:  # links that a least forest of these lacks are in none of the whole
            found = [forest(found)]
            size = 0
    if found:
        i, j = (np.concatenate(x) for x in list(zip(*found))[:2]) if across else forest(found)[:2]
        yield nodes[i], nodes[j]


def _cells(distinct: DataFrame, radius: int, words: int, similarity: float):
    """(cells, steps): the rows of tiles that ``distinct`` gives, each with a cell (x, y), and the steps to later cells that can
    hold links."""
    if words == 1:  # by the counts of ones in both halves
        x, y = F.bit_count(F.expr("node & 4294967295")), F.bit_count(F.expr("shiftrightunsigned(node, 32)"))
        reach = range(-radius, radius + 1)
        steps = [(i, j) for i in reach for j in reach if abs(i) + abs(j) <= radius and (i > 0 or i == 0 <= j)]
        return distinct.select(F.col("fp").alias("item"), x.alias("x"), y.alias("y")), steps
    # similar sets differ in size by the similarity at most: two cells for that factor
    width = -np.log(similarity) / 2
    cell = F.when(F.col("shingles") > 0, F.floor(F.log("shingles") / F.lit(float(width)))).otherwise(-10).cast("int")
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return distinct.select(F.concat("fp", number(F.col("node")), number(F.lit(0).cast("long"))).alias("item"), cell.alias("x"), F.lit(0).alias("y")), [(0, 0), (1, 0), (2, 0)]


def _tile_pairs(distinct: DataFrame, radius: int, words: int, tile_rows: int, similarity: float) -> DataFrame:
    """(a, b): pairs of tiles of about ``tile_rows`` fingerprints whose cells allow a link; b is null for a tile with itself.

    A tile goes to each tile that it meets, so a crowded cell's pairs are dealt over as many keys as it has tiles;
    the number of tasks follows the number of tiles."""
    cells, steps = _cells(distinct, radius, words, similarity)
    sizes = cells.groupBy("x", "y").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("nb"))
    sizes = cut(sizes, "simhash-cells")  # at most 33 x 33 rows, or one per size of texts on a scale of steps of 11 %
    tasks = tasks_for(distinct.sparkSession, sizes.agg(F.sum("nb")).first()[0] or 1, 2)
    placed = cells.join(F.broadcast(sizes), ["x", "y"]).withColumn("bucket", F.expr("pmod(xxhash64(item), nb)"))
    tiles = placed.groupBy("x", "y", "bucket").agg(F.unhex(F.array_join(F.collect_list(F.hex("item")), "")).alias("tile"))
    tiles = cut(tiles, "simhash-tiles")
    ways = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])
    left = tiles.withColumn("step", F.explode(ways)).selectExpr("tile as a", "bucket as ba", "x + step.x as x", "y + step.y as y", "step.x = 0 and step.y = 0 as level")
    left = left.join(F.broadcast(sizes), ["x", "y"]).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("not level or ba <= bb")
    right = tiles.selectExpr("x", "y", "cast(bucket as int) as bb", "tile as b")
    key = ["x", "y", "bb"]
    pairs = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key)
    return pairs.selectExpr("a", "if(level and ba = bb, null, b) as b")


def linked_nodes(distinct: DataFrame, radius: int, words: int = 1, tile_rows: int = 16384, similarity: float = 0.8) -> DataFrame:
    """(u long, v long): links within ``radius`` bits between the nodes of ``distinct(fp, node, shingles)`` that join all that is
    linked. Of prints of several words only those are compared whose texts can have the ``similarity``, by their number of shingles."""

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                for u, v in tile_links(a.as_py(), b.as_py(), radius, words):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return _tile_pairs(distinct, radius, words, tile_rows, similarity).mapInArrow(run, "u long, v long")


def _shingle_sets(links: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, h): the distinct shingles of each node of the links. ``reps(node, id, text_key)`` names a row of ``docs(id, text)`` for it."""
    asked = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    named = reps.join(asked, "node").select("node", F.col("id").alias("rep_id"), F.col("text_key").alias("rep_key"))

    def sets(batches):
        for b in small_batches(batches, 256):
            found = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "h"])

    on = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("made") == F.col("rep_key"))
    texts = docs.withColumn("made", F.xxhash64(F.coalesce("text", F.lit("")))).join(named, on).select("node", "text")
    return texts.dropDuplicates(["node"]).mapInArrow(sets, "node long, h array<long>")


def _with_set(rows: DataFrame, hubs: DataFrame | None, sets: DataFrame, end: str) -> DataFrame:
    """``rows`` with the set of their node ``end``. The set of a node of ``hubs(node, parts)`` is copied to so many keys, so that
    none of them is the key of one task."""
    named = sets.select(F.col("node").alias(end), F.col("h").alias(f"h{end}"))
    if hubs is None:
        return rows.join(named, end)
    parts = F.broadcast(hubs.withColumnRenamed("node", end))
    dealt = rows.join(parts, end, "left").withColumn("part", F.expr("pmod(xxhash64(u, v), coalesce(parts, 1))")).drop("parts")
    copied = named.join(parts, end, "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1) - 1L)"))).drop("parts")
    return dealt.join(copied, [end, "part"]).drop("part")


def verified_links(links: DataFrame, sets: DataFrame, similarity: float, hub: int = 5000) -> DataFrame:
    """The links whose texts share ``similarity`` of their distinct shingles (``sets(node, h)``), counted exactly. Nodes of more than ``hub`` links
    are dealt over several keys; there are at most 2 x links / hub of these."""
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count().where(F.col("count") > hub)
    hubs = cut(ends.select("node", F.ceil(F.col("count") / hub).cast("int").alias("parts")), "simhash-hubs")
    hubs = None if hubs.isEmpty() else hubs
    both = _with_set(_with_set(links, hubs, sets, "u"), hubs, sets, "v")

    def check(batches):
        for b in small_batches(batches, 256):
            a, c = b.column("hu"), b.column("hv")
            same = np.fromiter((len(np.intersect1d(a[k].values.to_numpy(), c[k].values.to_numpy(), assume_unique=True)) for k in range(b.num_rows)), np.int64, b.num_rows)
            union = np.array([len(a[k].values) + len(c[k].values) for k in range(b.num_rows)], np.int64) - same
            ok = pa.array((same >= similarity * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], ["u", "v"])

    return both.select("u", "v", "hu", "hv").mapInArrow(check, "u long, v long")


def _roots_joined(rows_a: list, rows_b: list | None, radius: int, similarity: float):
    """Links between different parts that join all parts which rows of the two tiles (``rows_b`` None: of the one with itself) link: at most one fewer
    than the parts. Rows are dicts of fp, group and h (an array); nearest prints come first, and nothing is counted inside what is joined already."""
    rows, shift = (rows_a, 0) if rows_b is None else (rows_a + rows_b, len(rows_a))
    prints = np.frombuffer(b"".join(x["fp"] for x in rows), np.uint64).reshape(len(rows), -1)
    sets = [x["h"] for x in rows]
    size, group = np.fromiter(map(len, sets), np.int64, len(rows)), np.array([x["group"] for x in rows], np.int64)
    i, j, far = _close(prints[: len(rows_a)], prints[shift:], radius)
    j = j + shift
    wanted = (group[i] != group[j]) & (i < j) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
    i, j = i[wanted], j[wanted]
    up, found = {int(g): int(g) for g in group}, []

    def root(g):
        while up[g] != g:
            up[g] = up[up[g]]
            g = up[g]
        return g

    for k in np.argsort(far[wanted], kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        x, y = root(int(group[a])), root(int(group[b]))
        if x == y:
            continue
        same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        union = len(sets[a]) + len(sets[b]) - same
        if union and same >= similarity * union:
            up[max(x, y)] = min(x, y)
            found.append((int(group[a]), int(group[b])))
    return found


def joined_parts(rows: DataFrame, radius: int, similarity: float, tile_rows: int = 256) -> DataFrame:
    """(u, v): parts that a pair of texts links, of ``rows(near, node, group, fp, h)``: only rows of one ``near`` are compared, in pairs of tiles of
    about ``tile_rows`` rows and 8 MB, whose sets are counted where their prints are. What leaves a pair of tiles is a forest of its parts, so the number
    of rows doesn't follow the number of near pairs."""
    tiles_of = F.greatest(F.ceil(F.count("*") / F.lit(tile_rows)), F.ceil(F.sum(F.size("h")) / F.lit(1_000_000))).cast("int")
    large = cut(rows.groupBy("near").agg(tiles_of.alias("nb")).where("nb > 1"), "simhash-large")  # one tile holds at most so much of the rest
    placed = rows.join(F.broadcast(large), "near", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("bucket", F.expr("pmod(xxhash64(node), nb)").cast("int"))
    tiles = placed.groupBy("near", "nb", "bucket").agg(F.collect_list(F.struct("fp", "group", "h")).alias("tile"))
    tiles = cut(tiles, "simhash-parts-tiles")
    tasks = tasks_for(rows.sparkSession, tiles.count(), 8)
    left = tiles.select("near", F.col("bucket").alias("ba"), F.col("tile").alias("a"), F.explode(F.sequence("bucket", F.col("nb") - 1)).alias("bb"))
    right = tiles.select("near", F.col("bucket").alias("bb"), F.col("tile").alias("b"))
    pairs = left.repartition(tasks, "near", "bb").join(right.repartition(tasks, "near", "bb"), ["near", "bb"])

    def rows_of(tile):
        if not tile.is_valid:
            return None
        fp, group, h = (tile.values.field(c) for c in ("fp", "group", "h"))
        return [{"fp": x, "group": g, "h": y.values.to_numpy()} for x, g, y in zip(fp.to_pylist(), group.to_pylist(), h)]

    def run(batches):
        for batch in small_batches(batches, 1):
            found = _roots_joined(rows_of(batch.column(0)[0]), rows_of(batch.column(1)[0]), radius, similarity)
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return pairs.selectExpr("a", "if(ba = bb, null, b) as b").mapInArrow(run, "u long, v long")


def similar_groups(reps: DataFrame, docs: DataFrame, width: int, words: int, radius: int, tile_rows: int, similarity: float) -> DataFrame:
    """(node, root): groups of the sets of ``reps`` that links of at least the ``similarity`` join, of all pairs within ``radius`` bits.

    A least spanning forest of the prints' links is counted first. Inside what its links that hold join, others join nothing more. Where some link
    is refused, links between different such parts are counted too, among the sets that chains of links within ``radius`` bits connect."""
    links = cut(linked_nodes(reps, radius, words, tile_rows, similarity).distinct(), "simhash-found")
    sets = cut(_shingle_sets(links, reps, docs, width), "simhash-shingles")
    held = cut(verified_links(links, sets, similarity), "simhash-held")
    parts = cut(connected_components(held, "simhash-parts"), "simhash-roots")
    if held.count() == links.count():
        return parts
    near = connected_components(links, "simhash-near").select("node", F.col("root").alias("near"))
    group = cut(near.join(parts, "node", "left").select("node", "near", F.coalesce("root", "node").alias("group")), "simhash-open")
    mixed = group.groupBy("near").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("near")
    rows = group.join(mixed, "near").join(reps.select("node", "fp"), "node").join(sets, "node")
    joined = cut(joined_parts(rows, radius, similarity).distinct(), "simhash-joined")
    if joined.isEmpty():
        return parts
    above = connected_components(joined, "simhash-groups").toDF("group", "above")
    return group.join(above, "group", "left").select("node", F.coalesce("above", "group").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, words: int = 1, tile_rows: int = 16384
) -> DataFrame:
    """One row per input row: id, text_key, fp, node, component (a node of the group), component_id
    (the smallest id of the group, nulls aside; null if it has none).

    Null and empty texts have fingerprint zero, linked like any other. Rows with a null id keep
    their fingerprint but never name a component. Repeated rows are repeated in the result.
    An empty table gives an empty result; further columns are ignored.
    """
    fps, reps = _prints(docs, id_col, text_col, width, words)
    return _grouped(fps, reps, connected_components(linked_nodes(reps, radius, words, tile_rows), "simhash-links"))


def _prints(docs, id_col, text_col, width, words):
    """Fingerprints of all rows, and one row per distinct one: node, fp, and id, text_key and shingles of its smallest row."""
    fps = cut(fingerprints(docs, id_col, text_col, width, words), "simhash-fingerprints")
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "shingles")).alias("rep")
    reps = fps.groupBy("node").agg(F.first("fp").alias("fp"), smallest).select("node", "fp", "rep.id", "rep.text_key", "rep.shingles")
    return fps, cut(reps, "simhash-distinct")


def _grouped(fps, reps, roots):
    grouped = reps.select("node", "id").join(roots, "node")
    lows = grouped.groupBy("root").agg(F.min("id").alias("least"))
    merged = grouped.join(lows, "root").select("node", "root", "least")
    named = reps.select("node", "id").join(merged, "node", "left").selectExpr("node", "coalesce(root, node) as component", "coalesce(least, id) as component_id")
    named = cut(named, "simhash-groups")  # a table of its own, so that the join with a hot fingerprint can be split
    return fps.join(named, "node").select("id", "text_key", "fp", "node", "component", "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 5, words: int = 4, radius: int = 72, tile_rows: int = 16384, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays (then
    the smallest hash of the text; null ids come last).

    256-bit fingerprints over the sets of five-word shingles: at similarity s two prints differ in about arccos(2s/(1+s))/pi of their bits,
    15 % at 0.8, 19 % where sets of four and five meet. The radius of 28 % is five (four) standard deviations
    above that. What lies within it is counted exactly, and only texts that share ``similarity`` of their distinct
    shingles are linked (see :func:`similar_groups`), so no text goes without a chain of such links to the one that stays. Texts of equal prints
    are compared like others; texts with the same set of shingles, and all texts without a word, are one node.
    Of repeated rows one stays; of equal ids and texts too. Very long texts count whole. Columns are those of ``docs``, whatever their
    names; an empty table stays empty.
    """
    spark = docs.sparkSession
    one, two, of = (fresh_name(docs, n) for n in ("stay_id", "stay_key", "text_key"))
    path = fresh_path(spark, "simhash-stay")
    with scratch(spark):  # only the list of rows that stay is kept
        fps, reps = _prints(docs, "doc_id", "text", width, words)
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        near = _grouped(fps, reps, similar_groups(reps, texts, width, words, radius, tile_rows, similarity))
        best = near.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("b"))
        stay = cut(best.select(F.col("b.id").alias(one), F.col("b.text_key").alias(two)), "simhash-stay", path)
    kept = docs.withColumn(of, F.xxhash64(F.coalesce("text", F.lit("")))).join(stay, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(of) == F.col(two)))
    return kept.dropDuplicates([one, two]).select(*docs.columns)
