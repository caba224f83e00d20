"""Token counts by prefix, cross-tokenizer alignment and collocations against the libraries and plain loops."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanwatch.llm import collocations, crosstoken, prefixcounts, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ATOMS = [
    "the", "'re", "'r", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", "\x85", "　", "é", "é", "ñ", "日本", "1", "23", "<|endoftext|>", "<|endof", "!", "...",
    "ing", "aaaa", "ÃÂ", "€", "|", "՘", "\U000107bb", "▁", "<s>", "ŒŒ", "\x00",
]


def odd_texts(n=250, seed=3):
    r = random.Random(seed)
    made = ["".join(r.choice(ATOMS) if r.random() < 0.7 else r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 30))) for _ in range(n)]
    return made + ["", " ", "  ", "\n\n", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "x" * 3000, " \n" * 500, "ab " * 2000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_prefix_counts_equal_the_library(library):
    """Every prefix of every odd text, each encoded anew by the library."""
    counter = prefixcounts.PrefixCounter(open(JSON, "rb").read(), cache_bytes=10_000)
    for text in odd_texts():
        step = 1 if len(text) < 100 else 97
        at = list(range(0, len(text), step))
        want = [len(e.ids) for e in library.encode_batch([text[: i + 1] for i in at], add_special_tokens=False)]
        assert counter.counts(text)[at].tolist() == want, text[:100]


def test_prefix_table_answers_budgets(spark, library):
    texts = [*odd_texts(60, seed=5), None]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, prefix_tokens string, _text int")
    table = prefixcounts.prefix_counts(df, JSON)
    assert table.columns == ["doc_id", "text", "_text", "prefix_tokens"]
    asked = table.select(
        "doc_id",
        "text",
        prefixcounts.tokens_of("prefix_tokens", F.lit(7)).alias("of_7"),
        prefixcounts.tokens_of("prefix_tokens", F.lit(10**6)).alias("of_all"),
        prefixcounts.longest_within("prefix_tokens", F.lit(5)).alias("fits"),
    ).collect()
    tokens = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in asked:
        t = r.text or ""
        assert (r.of_7, r.of_all) == (tokens(t[:7]), tokens(t))
        assert r.fits == max(n for n in range(min(len(t), 200) + 1) if tokens(t[:n]) <= 5)
    cut = {r.doc_id: r.text for r in prefixcounts.truncate(df, JSON, 5).collect()}
    assert cut == {r.doc_id: (None if r.text is None else r.text[: r.fits]) for r in asked}


def test_prefix_report(spark, sf, library):
    rows = [(1, "one two", "en", "s", 1), (1, "one two", "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (4, "é " * 600, "fr", "s", 9)]
    got = prefixcounts.report(spark.createDataFrame(rows, DOCS), JSON, limit=512).collect()
    n = len(library.encode("é " * 600).ids)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(0, 0, 0, False), (1, 7, 2, False), (1, 7, 2, False), (3, 0, 0, False), (4, 1800, n, True)]
    assert prefixcounts.report(spark.createDataFrame([], DOCS), JSON, limit=512).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op12_prefix_counts(spark, sf).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 512)


def plain_alignment(texts):
    """Whole texts through both libraries, offsets and links by plain loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, byte = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=MODEL), prefixcounts.byte_of_symbol()
    a.encode_special_tokens = True
    bytes_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        data = f" {t}".encode()
        if not t or b"".join(map(bytes_a, ids_a)) != data or b"".join(map(bytes_b, ids_b)) != data:
            docs.append(([], [], []))
            continue
        groups, i, j, at_a, at_b, run_a, run_b = [], 0, 0, 0, 0, [], []
        while i < len(ids_a) or j < len(ids_b):
            if j == len(ids_b) or (i < len(ids_a) and at_a <= at_b):
                run_a.append(ids_a[i])
                at_a, i = at_a + len(bytes_a(ids_a[i])), i + 1
            else:
                run_b.append(ids_b[j])
                at_b, j = at_b + len(bytes_b(ids_b[j])), j + 1
            if at_a == at_b:
                groups.append((run_a, run_b))
                run_a, run_b = [], []
        docs.append((ids_a, ids_b, groups))
    count = Counter((x[-1], y[-1]) for *_, groups in docs for x, y in groups)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for ids_a, ids_b, groups in docs:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if ids_a else ""
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest))
    return rows, count


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_plain_loops(spark, sf):
    odd = [*odd_texts(120, seed=9), "a ", " a", "a\n  b", "a\u3000 b", "x\x85 y", "a\x1c b", "<s> </s>", "a▁b"]
    rows = [(i, t, "x", i) for i, t in enumerate(odd + ["the same text"] * 3 + [None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, links int").repartition(5)
    want, count = plain_alignment([t or "" for _, t, *_ in rows])
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in crosstoken.align(df, JSON, MODEL).collect()}
    for i, t, *_ in rows:
        assert got[i] == want[i], repr(t)
    assert sum(w[0] == 0 for w in want) < len(rows) / 2 and any(x[0] and x[2] < x[0] for x in want)
    pairs = crosstoken.pair_counts(df, JSON, MODEL).collect()
    assert len(pairs) == len(count) and {(r.a_id, r.b_id): r.n for r in pairs} == count
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], plain_alignment([r.text or "" for r in docs])[0]))
    got = queries.op11_cross_tokenizer(spark, sf).collect()
    assert len(got) == len(docs) and {r.doc_id: tuple(r[c] for c in ALIGNED) for r in got} == want


def test_alignment_of_odd_rows(spark):
    rows = [(None, "a b", None, None, None), (1, "a b", "en", "s", 1), (1, "a b", "en", "s", 1), (2, None, None, None, None)]
    got = crosstoken.align(spark.createDataFrame(rows, DOCS), JSON, MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in got) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert crosstoken.align(spark.createDataFrame([], DOCS), JSON, MODEL).count() == 0
    aligner = crosstoken.Aligner(open(JSON, "rb").read(), open(MODEL, "rb").read(), cache_bytes=1000)
    texts = odd_texts(80, seed=4)
    kept = crosstoken.Aligner(open(JSON, "rb").read(), open(MODEL, "rb").read())
    assert [aligner.documents([t])[0] for t in texts * 2] == kept.documents(texts * 2)


def plain_collocations(rows, least, share, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    chosen = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    held = {}
    for (lang, p), a in chosen.items():
        for inner in (p[:2], p[1:]) if len(p) == 3 else ():
            held[lang, inner] = max(held.get((lang, inner), 0), a)
    out = {}
    for (lang, p), a in chosen.items():
        if len(p) == 2 and 100 * held.get((lang, p), 0) >= share * a and (lang, p) in held:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


def test_collocations_equal_plain_loops(spark):
    r = random.Random(7)
    words = ["a", "b", "c", "New", "york", "É", "x.y", "\x00", "z;", "\t", " ", "q\n", "\u3000", "日本"]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", "  ", "\t"]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None, "und"])) for _ in range(200)]
    rows += [(None, "en"), ("", None), ("a b c " * 3000, "en"), ("new york " * 50, "de"), ("same words", "nl"), *[("same words here", "nl")] * 12]
    df = spark.createDataFrame(rows, "text string, lang string").select("*", F.lit(1).alias("n"), F.lit("w").alias("w1")).repartition(4)
    for least, share, top in ((10, 50, 2000), (2, 80, 7)):
        got = collocations.collocations(df, least, share, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        want = plain_collocations(rows, least, share, top)
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**12, 10**12, 3 * 10**12), (7, 7, 7)], "a long, l long, r long")
    assert [x.s for x in big.select(collocations._score("l", "r").alias("s")).collect()] == [333333, 1000000]
