"""Brute-force checks and edge cases of the vector, archive and chat operators, and of the pipeline."""

import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwatch.llm import additive, chat, common, multiindex, warczip

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[:40] + 0.02 * r.normal(size=(40, d)).astype(np.float32)
    x[-20:] = x[0]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [float("nan")] * d, 1), (1003, [None] * d, 1), (1004, x[1].tolist(), None), (1005, [1.0, 2.0], 1)]
    return rows + odd


def test_multi_index_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", node string, n int")
    got = {r.vec_id: r for r in multiindex.near_duplicates(df, block_rows=32).collect()}
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i < 1000]
    ids = np.array([i for i, _, _ in ok])
    x = np.stack([v for _, v, _ in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([l for _, _, l in ok])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    c = ids.copy()
    for _ in range(20):
        c = np.minimum(c, np.where(link, c[None], 10**9).min(1))
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[k].sum(), c[k], c[k] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005))


def test_multi_sequence_order():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 8))
    g = multiindex.Grid(x, 6, 0.93, 0.99)
    assert 0 < g.reach < 2 - 2 * 0.93 < 0.15 and multiindex.Grid(x, 6, 0.93, 1.0).reach == pytest.approx(0.14)
    own, one, two = g.distances(multiindex._unit(x))
    row, i, j = g.visits(one, two)
    for k in range(0, 500, 50):
        seen = list(g.traverse(one[k], two[k]))
        assert seen[0][1:] == tuple(own[k]) and len({c[1:] for c in seen}) == 36 and [d for d, *_ in seen] == sorted(d for d, *_ in seen)
        met = [(one[k, p], two[k, q], p, q) for p, q in zip(i[row == k].tolist(), j[row == k].tolist())]
        assert {c[1:] for c in seen if c[0] <= g.reach} == {m[2:] for m in met} and len(met) == sum(c[0] <= g.reach for c in seen)
        assert [a + b for a, b, *_ in met] == sorted(a + b for a, b, *_ in met)  # nearest first, as the heap takes them


def test_multi_index_recall_and_pruning(spark):
    """The query's own settings: recall against brute force, and the share of the pairs of a label that is compared."""
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 64))
    near = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True)
    away = r.normal(size=near.shape)
    away -= (away * near).sum(1, keepdims=True) * near
    x[600:900] = 0.935 * near + np.sqrt(1 - 0.935**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    x = x.astype(np.float32)
    label = np.arange(1500) % 3
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], VECTORS)
    found = multiindex.links(df, 0.93, 0.9999)[0]
    compared = found.agg(F.sum("pairs")).first()[0]
    assert compared < 0.25 * 3 * (500 * 499 / 2)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    assert link.sum() - 1500 >= 600
    assert found.agg(F.sum("links")).first()[0] >= 0.99 * (link.sum() - 1500)
    assert multiindex.centres(50) > 1


def test_multi_index_empty(spark):
    assert multiindex.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_additive_recall_and_scores(spark):
    rows = vectors(600)
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in additive.search(df, df.where("vec_id % 20 = 0"), k=20, books=8, words=32, query_rows=7, block_rows=4096).collect():
        got.setdefault(r.query_id, []).append(r)
    x = {i: np.array(v, float) for i, v, _ in rows if i < 1000}
    hits = 0
    for q in range(0, 600, 20):
        s = sorted(((-(x[q] * x[i]).sum(), i) for i in x if i != q))[:20]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - (x[q] * x[r.vec_id]).sum()) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({i for _, i in s} & {r.vec_id for r in mine})
    assert hits / (30 * 20) >= 0.9
    assert 1000 not in got and 1001 not in got


def test_additive_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (3, [1.0, 1.0], 1)], VECTORS)
    got = additive.search(df, df.where("vec_id % 20 = 0"), k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert additive.search(df.limit(0), df.limit(0)).count() == 0


def test_additive_ids_with_several_vectors(spark):
    """An id with two vectors is one candidate, with its better score; reruns agree."""
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 8)).astype(np.float32)
    big = (10 * x[0]).tolist()
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)] + [(7, big, "a", 1), (7, big, "a", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, h1 string, dim int")
    got = sorted(tuple(q) for q in additive.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == sorted(tuple(q) for q in additive.search(df, df.where("vec_id % 20 = 0")).collect())
    mine = [q for q in got if q[0] == 0]
    assert len({q[2] for q in mine}) == len(mine) == 20 and mine[0][2] == 7 and abs(mine[0][3] - np.dot(x[0].astype(float), np.array(big, np.float32).astype(float))) < 1e-6


PAGES = [(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, None, None), (4, "http://c d\r\n", "short"), (5, "u", "short"), (None, "n", "é" * 900), (7, "u", "é" * 900), (7, "u", "é" * 900)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/packages"
    packages = warczip.write_packages(warczip.with_references(df), folder)
    rows = warczip.read_records(packages, payloads=True, split_bytes=500).collect()
    assert len(rows) == len(PAGES)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert kinds == [(0, "revisit", 7), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (7, "response", None), (7, "response", None)]
    text = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in rows:
        assert r.payload_bytes == len(text[r.page_id]) and r.payload_digest == hashlib.sha1(text[r.page_id]).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == text[r.page_id]
    for p in (tmp_path / "packages").iterdir():
        names = zipfile.ZipFile(p).namelist()
        assert names == [warczip.DATA, warczip.INDEX]
    assert warczip.package_pages(df.limit(0)).count() == 0
    records = spark.createDataFrame([r.asDict() for r in rows], warczip.read_records(packages).schema)
    assert warczip.dangling_revisits(records).count() == 0
    other = F.when(F.col("page_id") == 2, F.lit("00")).otherwise(F.col("payload_digest"))
    assert [r.page_id for r in warczip.dangling_revisits(records.withColumn("payload_digest", F.when(F.col("record_type") == "response", other).otherwise(F.col("payload_digest")))).collect()] == [2]


def test_warc_of_a_very_long_page(spark):
    df = spark.createDataFrame([(1, "u", "long é" * 500_000), (2, "u", "short"), (3, "v", "long é" * 500_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warczip.package_pages(df).collect()}
    assert [got[i].payload_bytes for i in (1, 2, 3)] == [3_500_000, 5, 3_500_000] and (got[1].refers_to, got[3].record_type) == (3, "response")


def test_zip_directories():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for n in range(3):
            z.writestr(f"m{n}", b"data" * n)
        z.comment = b"PK\5\6 in a comment"
    members = warczip.directory(raw, len(raw.getvalue()))
    for n in range(3):
        at, size = warczip.member_range(raw, members[f"m{n}"])
        assert raw.getvalue()[at : at + size] == b"data" * n
    with pytest.raises(ValueError):
        warczip.directory(io.BytesIO(b"nothing"), 7)


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"0123456789" * 5)
        z.writestr("b", b"x" * 33)
    assert b"PK\6\6" in raw.getvalue() and b"PK\6\7" in raw.getvalue()
    members = warczip.directory(raw, len(raw.getvalue()))
    at, size = warczip.member_range(raw, members["b"])
    assert raw.getvalue()[at : at + size] == b"x" * 33


SAYS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s> ␛0; [/INST]"), (2, 0, "assistant", None), (2, 1, None, "x"), (None, 0, "user", "a"), (3, 0, "to[:]ol", "[TURN]"), (4, 5, "user", "q"), (4, 5, "user", "q"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*s, 1) for s in SAYS], "conv_id long, turn long, role string, text string, state int")
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    for c in (1, 2, None, 3, 4):
        mine = [(r or "", t or "") for k, _, r, t in SAYS if k == c]
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c].valid for c in (1, 2, 3, 4)] == [True, False, False, False]
    whole = "".join(s["text"] for r in turns.where("conv_id = 1").orderBy("seq").collect() for s in r.segments)
    assert whole.count("</s>") == 1 and got[1].formatted_chars == len(whole)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    stored = common.cut(turns.repartition(3, "seq"), "turns")  # another order; read_back restores it
    assert {tuple(r) for r in chat.read_back(stored).collect()} == {tuple(r) for r in got.values()}
    with pytest.raises(Exception, match="comes where"):
        chat.read_back(stored.where("conv_id <> 1 or seq <> 1")).collect()
    long = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "</s> a " * 300_000)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(long)).first().loss_chars == 2_100_000


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)] + [(10, 10 + i) for i in range(1, 50)], "u long, v long")
    got = {r.node: r.root for r in common.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {10 + i: 10 for i in range(50)}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_component_rounds_have_small_plans(spark, monkeypatch):
    """With a hub and without: right roots, and no table of a round reads more than a few tables (60 and more before)."""
    rng, reads, cut = np.random.default_rng(3), [], common.cut

    def counted(df, *args):
        reads.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return cut(df, *args)

    monkeypatch.setattr(common, "cut", counted)
    pairs = rng.integers(0, 400, (300, 2)).tolist() + [(1000 + i, 1001 + i) for i in range(40)]
    for edges, most in ((pairs, 4), (pairs + [(5000, 5001 + i) for i in range(1500)] + [(9000 - i, 9000) for i in range(1, 1200)], 12)):
        reads.clear()
        root = {n: n for pair in edges for n in pair}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for u, v in edges:
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
        linked = {n for u, v in edges if u != v for n in (u, v)}
        got = common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert len(got) == len(linked) and {r.node: r.root for r in got} == {n: find(n) for n in linked}
        assert max(reads) <= most


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        before = docs.count()
        docs = common.cut(stage(spark, docs, sf), "t")
        assert docs.columns == columns and 0 < docs.count() <= before * 1.5, name
    out = c.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_stages_take_odd_rows(spark, sf):
    """Nulls, empty and white texts, repeated rows and ids, columns named like inner ones, an empty table."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars int, row string, text_key int, score string, copies int, size string, id int"
    texts = [None, "", " \n ", "one two", "one two", "a clean sentence of some words. " * 20, "é漢🙂 " * 50]
    rows = [(i if i else None, t, None, None if i % 2 else "s", len(t or ""), "x", i, "y", 0, None, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[5], rows[0]], schema)
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf)
        assert name == "byte-level BPE" or out.schema == docs.schema, name
        got = out.collect()
        assert len(got) <= 3 * len(rows) + 6, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        if name == "SimHash near-dedup":
            assert sorted(r.doc_id or -1 for r in got) == [1, 3, 5, 6]  # texts without words are one group, and equal texts
        if name == "substring dedup":
            assert len(got) == len(rows) + 2 and sum(r.text is None for r in got) == 2
        if name == "byte-level BPE":
            assert len(got) == len(rows) + 2 and all(r.n_tokens == len(r.ids) for r in got)


def test_registered_queries(spark, sf):
    from spanwatch.llm import queries

    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_multi_index_of_more_groups_than_centres(spark):
    """Small blocks, so that groups follow both halves."""
    rows = vectors(n=600, d=8, seed=4)
    df = spark.createDataFrame(rows, VECTORS)
    pick = lambda b: sorted((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_duplicates(df, block_rows=b).collect())
    assert pick(4) == pick(2048)


def test_short_payloads_have_no_part_in_the_join(spark):
    """Half of the pages are empty or share a short text; only repeated long ones refer."""
    pages = [(i, "u", "" if i % 2 else "x" * 1200 if i % 3 else f"y{i}" * 600) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warczip.with_references(df).collect()}
    repeated = [i for i, _, h in pages if h == "x" * 1200]
    assert got == {i: max(repeated) if i in repeated and i != max(repeated) else None for i, *_ in pages}
