"""Brute-force checks and edge cases of the operators on texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from spanwatch.llm import bpe, chunkdedup, licenses, mixing, quality, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é" * 300), (None, "no id"), (5, "same row"), (5, "same row"), (6, "x" * 20000)]
SCHEMA = "doc_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(n))


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def test_simhash_matches_brute_force(spark):
    base = [prose(s, 60) for s in range(30)]
    texts = base + [t.replace("alpha", "omega", 1) for t in base] + base[:5] + ["", None, "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.id: r for r in simhash.near_duplicates(df, width=4, radius=4, tile_rows=16).collect()}
    prints = [brute_fingerprint(t, 4) for t in texts]
    assert [got[i].node & (2**64 - 1) for i in range(len(texts))] == prints
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert [got[i].component_id for i in range(len(texts))] == label


def tile(prints, nodes, groups):
    """Rows of a tile: print, node and group."""
    return b"".join(x.tobytes() + int(n).to_bytes(8, "big") + int(g).to_bytes(8, "big") for x, n, g in zip(prints, nodes, groups))


def test_simhash_forest_equals_brute_force():
    x = np.random.default_rng(1).integers(0, 2**64, (90, 4), np.uint64)
    x[30:60] = x[:30]
    x[30:60, 3] ^= np.uint64(0b1011)
    x[60:70, 2] = x[:10, 2] ^ np.uint64(1)
    x[60:70, [0, 1, 3]] = x[:10][:, [0, 1, 3]]
    rows = tile(x, range(90), [k % 30 for k in range(90)])
    links = [(a, b) for u, v in simhash.tile_links(rows, None, 42, 4) for a, b in zip(u.tolist(), v.tolist())]
    far = np.bitwise_count(x[:, None] ^ x[None]).sum(2)
    assert len(links) == 40 and all(far[a, b] <= 42 for a, b in links)
    assert sorted(far[a, b] for a, b in links) == [1] * 10 + [3] * 30  # the least forest: 4 is not taken
    a, b = rows[: 45 * 48], rows[45 * 48 :]
    joined = {frozenset(p) for t in ((a, None), (b, None), (a, b)) for u, v in simhash.tile_links(*t, 42, 4) for p in zip(u.tolist(), v.tolist())}
    label = list(range(90))
    for m, n in map(sorted, joined):
        label = [min(label[m], label[n]) if k in (label[m], label[n]) else k for k in label]
    assert all(far[m, n] <= 42 for m, n in map(sorted, joined)) and len(set(label)) == 50
    across = {frozenset(p) for u, v in simhash.tile_links(tile(x, range(90), range(90)), None, 42, 4, across=True) for p in zip(u.tolist(), v.tolist())}
    assert across == {frozenset((i, j)) for i in range(90) for j in range(i) if far[i, j] <= 42}
    assert not [u for u, _ in simhash.tile_links(rows, None, 42, 4, across=True) if len(u)]  # the close ones share a group


def groups_of(sets, similarity=0.8):
    """Component labels of all pairs of sets with the similarity, and the similarities of the pairs."""
    label, share = list(range(len(sets))), {}
    for i in range(len(sets)):
        for j in range(i):
            share[i, j] = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
            if (sets[i] == sets[j] or share[i, j] >= similarity) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label, share


def test_near_dedup_of_the_band_at_the_threshold(spark):
    """Runs of words replaced so that similarities lie closely around 0.8, in texts of 9 to 500 words; chains among them."""
    r = random.Random(33)
    texts = []
    for k in range(120):
        words = prose(k, r.choice([9, 12, 20, 45, 120, 500])).split()
        texts.append(" ".join(words))
        for step in range(3):
            words = list(words) if r.random() < 0.5 else texts[-1].split()
            m = max(1, int(len(words) * r.uniform(0.02, 0.13)))
            at = r.choice([0, r.randrange(len(words) - m + 1), len(words) - m])
            words[at : at + m] = [f"w{k}x{step}y{i}" for i in range(r.choice([0, m]))]
            texts.append(" ".join(words))
    label, share = groups_of([set(simhash.shingle_set(t, 5).tolist()) for t in texts])
    assert sum(0.8 <= s < 0.9 for s in share.values()) > 80 and sum(0.6 <= s < 0.8 for s in share.values()) > 80
    kept = {x.doc_id for x in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), SCHEMA), tile_rows=100).collect()}
    assert kept == set(label)


def test_near_dedup_keeps_texts_of_one_repeated_line(spark):
    """One shingle or line makes up most of these texts, which share nothing else."""
    r = random.Random(3)
    own = [" ".join(f"{k}w{i}" for i in range(150)) for k in range(4)]
    texts = ["x " * 200 + o for o in own[:2]] + ["all rights reserved to nobody here " * 60 + o for o in own[2:]]
    texts += ["x " * n for n in (10, 500)] + ["", None, " \n"]
    texts += [" ".join(r.choice("ab") for _ in range(40)) for _ in range(20)]
    label, _ = groups_of([set(simhash.shingle_set(t, 5).tolist()) for t in texts])
    kept = {x.doc_id for x in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert {0, 1, 2, 3, 4, 6} <= kept and 5 not in kept and kept == set(label)


def test_refused_links_hide_no_others(spark, monkeypatch):
    """A forest of the nearest prints whose links are all refused: the farther link that holds is found."""
    sets = [set(range(100)), set(range(10, 112)), set(range(30, 135))]
    sets.append(set(range(100)) | {200, 201, 202} - {1})
    nodes = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "node long, h array<long>")
    prints = np.zeros((4, 4), np.uint64)
    prints[:, 0] = [0, 1, 3, 0b1111]  # the one like node 0 has the farthest print
    reps = spark.createDataFrame([(k, x.tobytes(), 100, k, k) for k, x in enumerate(prints)], "node long, fp binary, shingles int, id long, text_key long")
    monkeypatch.setattr(simhash, "_shingle_sets", lambda *_: nodes)
    label, _ = groups_of(sets)
    got = {x.node: x.root for x in simhash.similar_groups(reps, None, 5, 4, 72, 16384, 0.8).collect()}
    found = [min([k, *(n for n, root in got.items() if root == got.get(k))]) for k in range(4)]
    assert found == label and len(set(label)) < 4


def test_near_dedup_equals_brute_force(spark):
    """Groups over exact similarities of 0.8 and more; documents of less go on."""
    r = random.Random(21)
    base = [prose(s, r.choice([30, 120, 400])) for s in range(25)]

    def edited(text, share):
        words = text.split()
        for k in r.sample(range(len(words)), max(1, int(share * len(words)))):
            words[k] = "other" + str(r.randint(0, 10**6))
        return " ".join(words)

    texts = base + [edited(t, 0.01) for t in base] + [edited(t, 0.2) for t in base] + ["", None, "few words", "few words"]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    same = lambda a, b: a == b or len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b]))
    label = list(range(len(texts)))
    for _ in range(4):
        for i in range(len(texts)):
            for j in range(i):
                if (sets[i] == sets[j] or same(i, j)) and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = {x.doc_id for x in simhash.keep_one_of_each(df, tile_rows=16).collect()}
    assert kept == set(label)


def test_simhash_keeps_one(spark, odd):
    base = [prose(s, 200) for s in range(10)]
    near = [t.replace(t.split()[50], "changed", 1) for t in base]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(base + near + base)], "doc_id long, text string, component string")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(10))
    rest = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(odd).collect()]
    assert (5, "same row") in rest and rest.count((5, "same row")) == 1 and (1, None) in rest
    assert simhash.keep_one_of_each(odd.limit(0)).count() == 0


def test_chunks_resist_insertions():
    text = prose(7, 400).encode()
    a = chunkdedup.cuts(np.frombuffer(text, np.uint8))
    b = chunkdedup.cuts(np.frombuffer(b"inserted words here " + text, np.uint8))
    assert len(set(len(text) - a) & set(len(text) + 20 - b)) > 0.9 * len(a)
    assert a[-1] == len(text) and np.diff(a).max() <= 256


def test_chunk_cuts_keep_characters():
    raw = ("é漢" * 2000).encode()
    for e in chunkdedup.cuts(np.frombuffer(raw, np.uint8)):
        raw[:e].decode()


def test_repeated_passages_go(spark):
    passage = prose(99, 60)
    texts = [prose(1, 50) + " " + passage, prose(2, 50) + " " + passage + " " + prose(3, 40), prose(4, 120), None, ""]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, seq int")
    out = {r.doc_id: r.text for r in chunkdedup.dedup_text(df).collect()}
    assert chunkdedup.dedup_text(df).columns == df.columns
    assert out[0] == texts[0] and out[2] == texts[2] and out[3] is None and out[4] == ""
    assert len(out[1]) < len(texts[1]) - len(passage) / 2 and prose(2, 50)[:200] in out[1]
    spans = chunkdedup.repeated_spans(df).collect()
    assert [s.doc_id for s in spans] == [1] and spans[0].first_doc_ids == [0] and spans[0].n_words >= 20
    assert texts[1][spans[0].span_start : spans[0].span_end] in passage


def brute_spans(rows, min_words=20):
    """Chunks, first occurrences and spans by plain loops over (doc_id, text) rows in the order in which they are read."""
    chunks = {}
    for row, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        ends = chunkdedup.cuts(np.frombuffer(raw, np.uint8)).tolist()
        chunks[row] = [(a, e, raw[a:e]) for a, e in zip([0, *ends], ends)]
    order = sorted(chunks, key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r))
    first, out = {}, []
    for row in order:
        for k, (_, _, c) in enumerate(chunks[row]):
            first.setdefault(c, (row, k))
    for row in order:
        raw, run = (rows[row][1] or "").encode(), []
        for k, (a, e, c) in enumerate([*chunks[row], (0, 0, None)]):
            if c is not None and first[c] != (row, k):
                run.append((a, e, rows[first[c][0]][0]))
                continue
            if len(run) > 1:
                a, e = run[0][0], run[-1][1]
                begun = sum(1 for p in range(a, e) if not raw[p : p + 1].isspace() and (p == 0 or raw[p - 1 : p].isspace()))
                held = {x for *_, x in run}
                if begun >= min_words:
                    out.append((rows[row][0], len(raw[:a].decode()), len(raw[:e].decode()), begun, len(run), [None] * (None in held) + sorted(held - {None})))
            run = []
    return out


def test_repeated_spans_equal_plain_loops(spark):
    r = random.Random(11)
    lines = [prose(1000 + i, 30) + " é漢 " for i in range(12)]
    rows = [(i, "\n".join(r.choice(lines) if r.random() < 0.5 else prose(i * 50 + k, 25) for k in range(r.randint(1, 6)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, lines[0] * 3), (None, lines[0] * 3), (None, None), (80, ""), (81, lines[1] * 40)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    key = lambda t: (t[0] is not None, t[0] or 0, *t[1:5])
    got = sorted((tuple(x) for x in chunkdedup.repeated_spans(df).collect()), key=key)
    want = sorted(brute_spans(rows), key=key)
    assert len(want) > 50 and [(*x[:5], list(x[5])) for x in got] == want
    kept = [x.text for x in chunkdedup.dedup_text(df).where("doc_id is null and text is not null").collect()]
    assert sorted(map(len, kept))[0] < 40 < len(lines[0]) <= max(map(len, kept))


def test_hot_chunks_are_joined_by_broadcast(spark):
    """One passage in every one of 1500 documents: its digests pass the bound of the broadcast."""
    line = prose(5, 60)
    df = spark.createDataFrame([(i, f"{prose(i, 12)} {line}") for i in range(1500)], SCHEMA)
    spans = chunkdedup.repeated_spans(df).collect()
    assert len({s.doc_id for s in spans}) == 1499 and all(0 in s.first_doc_ids for s in spans)


def test_chunks_of_odd_rows(spark, odd):
    clash = odd.withColumn("row", F.lit("r")).withColumn("gone", F.lit(1)).withColumn("id", F.lit(2))
    assert chunkdedup.dedup_text(clash).columns == clash.columns and chunkdedup.repeated_spans(clash).count() == 0
    assert chunkdedup.repeated_spans(odd.limit(0)).count() == 0
    assert chunkdedup.dedup_text(odd).count() == len(ODD)
    assert chunkdedup.dedup_text(odd.limit(0)).count() == 0
    same = [r.text for r in chunkdedup.dedup_text(odd).where("doc_id = 5").collect()]
    assert same == ["same row", "same row"]


@pytest.fixture(scope="module")
def tokenizers():
    tok = bpe.Tokenizer(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN, cache_size=50)
    return tok, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})


def test_bpe_equals_tiktoken(tokenizers):
    tok, enc = tokenizers
    r = random.Random(3)
    texts = ["", "hello world", "<|endoftext|>", "aaaa" * 300, "   \n\n x", "é漢字🙂" * 20] + ["".join(chr(r.randint(1, 0xD7FF)) for _ in range(200)) for _ in range(30)]
    for t, joined in zip(texts, tok.encoded(texts)):
        assert list(map(int, joined.split())) == enc.encode_ordinary(t)
        assert tok.decode(bpe._numbers(joined)) == t.encode()


def test_bpe_frames(spark, odd, tokenizers):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = odd.withColumn("ids", F.lit("clash"))
    back = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((i or 0, t or "") for i, t in ODD)
    got = {r.doc_id: r for r in bpe.round_trip(odd, path, public_tokenizers.PATTERN).collect()}
    assert got[1].n_tokens == 0 and got[4].decoded_sha256 == hashlib.sha256(("é" * 300).encode()).hexdigest()
    ids = tokenizers[1].encode_ordinary("same row")
    assert got[5].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_mixing_targets_and_copies(spark):
    rows = [(s * 10000 + i, " ".join(["w"] * (i % 37)), name) for s, (name, n) in enumerate([("a", 900), ("b", 300), (None, 60), ("c", 20)]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.report(df).collect()
    by, total = {}, sum(r.size for r in got)
    for r in got:
        by.setdefault(r.doc_id // 10000, []).append(r)
        assert r.taken <= 3 * r.size
    targets = {k: v[0].target for k, v in by.items()}
    assert abs(sum(targets.values()) - total) < 1e-6
    for k, v in by.items():
        assert targets[k] <= 3 * v[0].source_size and abs(sum(r.taken for r in v) - targets[k]) <= 40
    assert sorted(got) == sorted(mixing.report(df).collect())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_odd_rows(spark, odd):
    df = odd.withColumn("source", F.when(F.col("doc_id") > 3, "s")).withColumn("size", F.lit("clash"))
    for name in ("src", "part", "row_no", "rows_before", "__s", "__b"):
        df = df.withColumn(name, F.lit("mine"))
    assert len(mixing.copies(df).collect()) == len(ODD)
    assert all(r.src == r.part == r.row_no == r.rows_before == r["__s"] == r["__b"] == "mine" for r in mixing.copies(df).collect())
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    # ids that share a remainder, or are missing, are dealt over many slices
    even = spark.createDataFrame([(64 * i, f"w{i}", "s") for i in range(500)] + [(None, f"v{i}", "s") for i in range(500)], "doc_id long, text string, source string")
    taken = mixing.copies(even).collect()
    assert len(taken) == 1000 and sum(r.copies for r in taken) == 1000
    assert all(r.taken == 0 for r in mixing.report(df).collect() if r.size == 0)


LICENSED = [
    "Licensed under the Apache License, Version 2.0; see http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: GPL-2.0-only", "MIT License MIT License", "CC BY-SA 4.0 and cc by",
    "Copyright (c) 2020 Foo. All rights reserved.", "GNU General Public License version 3", "released under the BSD 3-clause license", "GNU general public licence", "K mit license", "Redistribution and use in source and binary forms, with or without modification, are permitted",
]


def test_licenses_equal_plain_python(spark, odd):
    texts = LICENSED + [" ".join(LICENSED)] + [t for _, t in ODD] + ["mit license " * 400]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in licenses.scan(df).collect():
        assert tuple(r)[1:] == licenses.scan_text(texts[r.doc_id]), texts[r.doc_id]
    assert licenses.scan(df.limit(0)).count() == 0


def sampled(items, r):
    """A text that a parsed expression matches, with a branch, repeat and character drawn each time."""
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, value = r.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else "7" if "DIGIT" in str(value) else "word"
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sampled(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 3))))
        elif op == "SUBPATTERN":
            out += sampled(arg[3], r)
        elif op == "BRANCH":
            out += sampled(r.choice(arg[1]), r)
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def license_samples(each):
    import re

    r = random.Random(8)
    for rule in licenses.rules():
        parsed = re._parser.parse(rule.pattern)
        drawn = (sampled(parsed, r) for _ in range(each))
        yield rule, [t for t in drawn if re.search(f"(?<= )(?:{rule.pattern})(?= )", f" {t} ")]


def test_every_rule_passes_its_gate():
    hit = 0
    for rule, texts in license_samples(30):
        hit += bool(texts)
        for t in texts:
            assert any(k in f" {t} " for k in rule.keywords), (rule, t)
            assert any(k in f" {t} " for k in licenses.TRIGGERS), (rule, t)
    assert hit == len(licenses.rules()) and len(licenses.NOTICES) + len(licenses.NAMES) >= 150


def test_scan_equals_plain_python_on_samples_of_every_rule(spark):
    texts = ["before " + " and then ".join(t[:2]) + " after" for _, t in license_samples(4) if t]
    texts += ["Licensed under the Expat license", "released under the expat license", "you may not use this file except in compliance with the licence"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) and all(tuple(r)[1:] == licenses.scan_text(texts[r.doc_id]) for r in got)
    labels = {r.doc_id: r.labels for r in got}
    assert [labels[len(texts) - k] for k in (3, 2, 1)] == ["mit", "mit", "apache-2.0"]


def test_licenses_of_a_very_long_text(spark):
    import time

    df = spark.createDataFrame([(1, "mit license " * 200_000)], SCHEMA)
    licenses.scan(df.limit(0)).count()
    began = time.time()
    r = licenses.scan(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (400_000, 200_000, 0, 399_998, "mit")
    assert time.time() - began < 60  # linear: about 5 s; quadratic work would take hours


def test_license_rules_open_and_stay_native(spark):
    rules = licenses.rules()
    assert len(rules) > 500
    df = spark.createDataFrame([(1, "MIT License")], SCHEMA)
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_on_held_out_rows(spark):
    good = [(i, prose(i, 80), 1) for i in range(400)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 80).split()), 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad], "doc_id long, quality int")
    truth = {i: y for i, _, y in good + bad}
    held = [r for r in quality.classify(docs, labels).collect() if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.classify(odd, labels).count() == len(ODD)
    assert quality.classify(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.keep_good(odd.limit(0), labels).columns == odd.columns


def test_gam_learns_an_interaction():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == (y[2000:] > 0)).mean() > 0.85
    assert any({i, j} == {0, 1} for i, j, *_ in model.pairs)


def test_gam_parts_equal_plain_loops():
    """Scores, trees and pairs of cuts against loops over all possibilities."""
    import bisect
    import math

    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(400, 4)), 1)
    model = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=20)
    for row, got in zip(x[:60].tolist(), model.score(x[:60])):
        z = model.base + sum(t[bisect.bisect_right(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, row))
        z += sum(t[bisect.bisect_right(ei.tolist(), row[i]), bisect.bisect_right(ej.tolist(), row[j])] for i, j, ei, ej, t in model.pairs)
        assert abs(1 / (1 + math.exp(-z)) - got) < 1e-12
    for _ in range(20):
        g, h = r.normal(size=7), r.uniform(0.1, 1, 7)
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2)
        gains = [value(0, k) + value(k, 7) - value(0, 7) for k in range(1, 7)]
        gain, at = quality._split(g, h, 2.0)
        assert abs(gain - max(gains)) < 1e-9 and gains[at - 1] == pytest.approx(max(gains))
        tree = quality._tree(g, h, 2.0, 2)
        leaf = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 2)
        assert max(gains) <= 1e-9 or np.allclose(tree, [leaf(0, at)] * at + [leaf(at, 7)] * (7 - at))
        g, h = r.normal(size=(4, 5)), r.uniform(0.1, 1, (4, 5))
        part = lambda s: g[s].sum() ** 2 / (h[s].sum() + 2)
        best = max(sum(part((rows, cols)) for rows in (slice(0, a), slice(a, 4)) for cols in (slice(0, b), slice(b, 5))) - g.sum() ** 2 / (h.sum() + 2) for a in range(1, 4) for b in range(1, 5))
        assert quality._quadrants(g, h, 2.0)[0] == pytest.approx(best)


def test_quality_sample_is_bounded_where_ids_repeat(spark):
    rows = [(i % 3 + 2, prose(i, 20), "t", 1.0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, quality double")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (2, 0)], "doc_id long, quality int")
    out = quality.keep_good(docs, labels, max_rows=2)
    assert out.columns == docs.columns and 0 <= out.count() <= 90
    assert quality.classify(docs, labels).count() == 90


def test_very_long_texts(spark):
    """One text of 190 000 words through the operators on texts."""
    text = " ".join(WORDS) + " "
    df = spark.createDataFrame([(1, text * 10_000, "s"), (2, text, "s")], "doc_id long, text string, source string")
    n = 10_000 * len(WORDS)
    sizes = {r.doc_id: r.size for r in mixing.report(df).collect()}
    assert sizes == {1: n, 2: len(WORDS)}
    assert simhash.keep_one_of_each(df).count() <= 2
    spans = chunkdedup.repeated_spans(df).collect()
    assert sum(s.n_words for s in spans if s.doc_id == 1) > 0.99 * n - 100
    assert quality.score(df, quality.Gam(0.0, [np.zeros(0)] * len(quality.FEATURES), [np.zeros(1)] * len(quality.FEATURES), [])).count() == 2
    got = bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert all(r.decoded_sha256 == hashlib.sha256((text * (10_000 if r.doc_id == 1 else 1)).encode()).hexdigest() for r in got)


def test_bpe_of_one_long_piece(tokenizers):
    tok, enc = tokenizers
    r = random.Random(4)
    piece = "".join(r.choice("etaoin") for _ in range(20_000))
    assert tok.encode_pieces([piece.encode()])[0] == enc.encode_ordinary(piece)


def test_long_pieces_are_not_kept():
    import public_tokenizers

    from spanwatch.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tok = bpe.Tokenizer(open(path, "rb").read(), public_tokenizers.PATTERN)
    texts = ["a" * 5000 + " word", "word " + "b" * 70, "word"]
    first = tok.encoded(texts)
    assert max(map(len, tok.text_of)) <= 64 and " word" in tok.text_of
    assert tok.encoded(texts) == first and tok.decode(bpe._numbers(first[0])).decode() == texts[0]


def test_verified_links_of_a_hub(spark):
    """More links at one node than one key takes."""
    sets = [(0, list(range(10)))] + [(k, [*range(1, 10), 100 + k] if k % 2 else [k, *range(200, 209)]) for k in range(1, 40)]
    links = spark.createDataFrame([(0, k) if k % 3 else (k, 0) for k in range(1, 40)], "u long, v long")
    got = simhash.verified_links(links, spark.createDataFrame(sets, "node long, h array<long>"), 0.8, hub=4).collect()
    assert sorted(max(x.u, x.v) for x in got) == [k for k in range(1, 40) if k % 2]


def test_links_between_parts_are_a_forest(spark):
    """A large group of near prints, all pairs of which are near: of the links that hold those that join parts leave, not all."""
    r = np.random.default_rng(5)
    rows, sets = [], []
    for k in range(300):
        own = set(range(100 * (k % 10), 100 * (k % 10) + 90)) | set(r.integers(10_000, 10**6, 10).tolist())
        sets.append(own)
        rows.append((0, k, k, np.array([k % 7, 0, 0, 0], np.uint64).tobytes(), sorted(own)))
    df = spark.createDataFrame(rows, "near long, node long, group long, fp binary, h array<long>")
    links = [(x.u, x.v) for x in simhash.joined_parts(df, 72, 0.8, tile_rows=100).collect()]
    label, share = groups_of(sets)
    got = list(range(300))
    for u, v in links:
        low, high = sorted((got[u], got[v]))
        got = [low if x == high else x for x in got]
        assert share[max(u, v), min(u, v)] >= 0.8
    assert got == label and len(set(label)) == 10
    assert len(links) < 3000 < sum(s >= 0.8 for s in share.values())
