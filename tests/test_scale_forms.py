"""Operators that avoid whole histories, pairs of a group or deep joins, against plain forms of the same rules."""

import random
import re
import time

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwatch.operators import baseline as B
from spanwatch.operators import classify as C
from spanwatch.operators import correlate as K
from spanwatch.operators import errors as E
from spanwatch.operators import metrics as M
from spanwatch.operators import traces as T
from spanwatch.sources import fixtures as X

SPANS = "environment string, trace_id string, span_id string, start_us long, duration_us long"


def test_shortest_holders_equal_the_join(spark):
    """Equal starts, empty and nested spans, traces of one span."""
    r = random.Random(1)
    rows = [("e", f"t{t}", f"s{i:02d}", r.randint(0, 40), r.choice([0, 1, 2, 5, 10, 30, 60])) for t in range(200) for i in range(r.randint(1, 25))]
    df = spark.createDataFrame(rows, SPANS)
    got = {(x.trace_id, x.span_id): x.held for x in T.shortest_holders(df).collect()}
    traces, want = {}, {}
    for _, t, i, s, d in rows:
        traces.setdefault(t, []).append((d, s, i))
    for t, spans in traces.items():
        for _, s, i in spans:
            holds = [x for x in spans if x[2] != i and x[1] <= s < x[1] + x[0]]
            if holds:
                want[t, i] = min(holds)[2]
    assert got == want and len(want) > 1000


def test_a_giant_trace_takes_seconds(spark):
    """10^5 spans, each inside the one before."""
    n = 100_000
    name = F.format_string("s%06d", "id")
    df = spark.range(n).select(F.lit("e").alias("environment"), F.lit("big").alias("trace_id"), name.alias("span_id"), F.col("id").alias("start_us"), (2 * n - 2 * F.col("id")).alias("duration_us"))
    began = time.monotonic()
    held = T.shortest_holders(df)
    wrong = held.where(F.col("held") != F.format_string("s%06d", F.substring("span_id", 2, 6).cast("int") - 1)).count()
    assert wrong == 0 and held.count() == n - 1 and time.monotonic() - began < 90


def entries(spark, paths):
    rows = [("e", f"op{k % 3}", f"h{k:03d}", p, ["s"], 3) for k, p in enumerate(paths)]
    return spark.createDataFrame(rows, "environment string, root_op string, fp_hash string, path string, services array<string>, span_count int")


def random_paths(seed, n):
    """Variants of a few long paths, with tokens that all share and some that few have."""
    r = random.Random(seed)
    bases = [[f"c{i}" for i in range(4)] + [f"b{k}t{i}" for i in range(r.randint(3, 24))] for k in range(4)]
    out = []
    for _ in range(n):
        p = list(r.choice(bases))
        for _ in range(r.randint(0, 3)):
            p[r.randrange(len(p))] = f"x{r.randint(0, 40)}"
        out.append(" -> ".join(p))
    return out + ["a", "a", "b", "a -> b", "a -> b"]


def test_near_duplicate_entries_equal_all_pairs(spark):
    paths = random_paths(2, 160)
    tokens = [set(p.split(" -> ")) for p in paths]
    for threshold in (0.85, 0.5):
        want = {(f"h{i:03d}", f"h{j:03d}") for i in range(len(paths)) for j in range(i + 1, len(paths)) if i % 3 == j % 3 and len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j]) >= threshold}
        got = [(x.hash_a, x.hash_b) for x in B.near_duplicates(entries(spark, paths), threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_near_duplicates_join_on_tokens_only(spark):
    plan = B.near_duplicates(entries(spark, random_paths(3, 20)))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("token" in j or "hash_" in j for j in joins)


def test_closest_entry_equals_all_pairs(spark):
    paths, live_paths = random_paths(4, 90), random_paths(5, 60) + ["q -> z", "a -> b -> q", "z"]
    base = entries(spark, paths)
    live = entries(spark, live_paths).withColumn("fp_hash", F.concat(F.lit("n"), "fp_hash")).withColumn("trace_start", F.lit(0).cast("timestamp")).withColumn("trace_id", F.col("fp_hash"))
    edges = lambda p: {(a, b) for a, b in zip(p.split(" -> "), p.split(" -> ")[1:]) if a != b}
    want = {}
    for i, p in enumerate(live_paths):
        e = edges(p)
        scored = [(-len(e & edges(q)) / max(1, len(e | edges(q))), f"h{j:03d}") for j, q in enumerate(paths) if j % 3 == i % 3]
        want[f"nh{i:03d}"] = (min(scored)[1], round(-min(scored)[0], 9))
    got = {x.fp_hash: (x.base_hash, round(x.similarity, 9)) for x in B.closest_baseline(live, base).collect()}
    assert got == want and {s for _, s in want.values()} >= {0.0, 1.0}


def series(spark, seed, weeks=6, n=1500):
    r = random.Random(seed)
    rows = [("e", r.choice("ab"), f"t{i}", r.choice([r.randint(0, weeks * 7 * 24), 170 * r.randint(0, 3)]) * 3_600_000_000 + r.randint(0, 5), r.choice([1e9, 5.0]) + r.random()) for i in range(n)]
    return spark.createDataFrame(rows, "environment string, service string, trace_id string, ts_us long, v double")


def test_seasonal_moments_equal_the_running_window(spark):
    from spanwatch.functions import scalars as S

    df, key = series(spark, 6), ["environment", "service"]
    w = Window.partitionBy(*key, "slot").orderBy("ts_us", "trace_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("slot", S.seasonal_slot(F.timestamp_micros("ts_us"))).select("trace_id", F.count("*").over(w).alias("n"), F.avg("v").over(w).alias("m"), F.stddev_pop("v").over(w).alias("s"))
    want = {x.trace_id: x for x in plain.collect()}
    for x in M.with_seasonal_stats(df, key, "v").collect():
        y = want[x.trace_id]
        assert x.slot_n == y.n and abs(x.slot_mean - y.m) <= 1e-9 * abs(y.m) and abs(x.slot_std - y.s) <= 1e-6 * max(1, y.s, 1e-3 * y.m)


def test_arrival_numbers_equal_the_whole_window(spark):
    df, key = series(spark, 7), ["environment", "service"]
    whole = F.row_number().over(Window.partitionBy(*key).orderBy("ts_us", "trace_id"))
    want = {x.trace_id: x.nth for x in df.withColumn("nth", whole).collect()}
    assert {x.trace_id: x.nth for x in M.with_phase(df, key, 30).collect()} == want


def test_silences_equal_the_whole_window(spark):
    r = random.Random(8)
    rows = [("e", f"svc{k}:op", f"h{k}", t, f"{k}-{i}") for k in range(6) for i, t in enumerate(np.cumsum([r.choice([0, 1, 30, 39, 40, 41, 500]) for _ in range(60)]).tolist())]
    fps = spark.createDataFrame(rows, "environment string, root_op string, fp_hash string, s long, trace_id string").withColumn("trace_start", F.timestamp_seconds("s"))
    base = spark.createDataFrame([("e", f"svc{k}:op", f"h{k}", [f"svc{k}"], 5, False, False) for k in range(5)], "environment string, root_op string, fp_hash string, services array<string>, occurrences int, auto_promoted boolean, no_missing_service boolean")
    want, times = set(), {}
    for _, op, _, t, _ in rows:
        times.setdefault(op, []).append(t)
    for op, ts in times.items():
        ts = sorted(ts) + [20_000]
        want |= {(op, a, b - a) for a, b in zip(ts, ts[1:]) if b - a >= 40 and op != "svc5:op"}
    got = {(x.root_op, int(x.last_seen.timestamp()), x.silence_s) for x in C.missing_root_ops(fps, base, 10, "1970-01-01 05:33:20").collect()}
    assert got == want and len(want) > 30


def test_suppression_equals_the_whole_window(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), r.randint(0, 3000), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, earliest_ms long, i int")
    for ttl in (0, 5, 40, 1000):
        want = []
        for k in "ab":
            ts = sorted(t for x, t, _ in rows if x == k)
            want += [(k, t) for before, t in zip([None, *ts], ts) if before is None or t - before > ttl]
        assert sorted((x.k, x.earliest_ms) for x in K.suppress_recent(df, ["k"], ttl).collect()) == sorted(want)


def test_windows_of_any_length_by_buckets(spark):
    r = random.Random(10)
    seen = [("e" if r.random() < 0.7 else "f", f"h{i}", "op", r.randint(0, 5000)) for i in range(200)]
    windows = [(r.choice("ef"), a, a + r.choice([0, 1, 10, 700, 4000])) for a in (r.randint(-50, 5000) for _ in range(25))] + [("e", 9, 3)]
    base = spark.createDataFrame(seen, "environment string, fp_hash string, root_op string, ms long").withColumn("first_seen", F.timestamp_millis("ms"))
    got = {(x.environment, x.fp_hash): x.window_start for x in B.stale_entries(base, spark.createDataFrame(windows, "environment string, start_ms long, end_ms long"), 100).collect()}
    want = {}
    for e, h, _, t in seen:
        inside = [a for w, a, b in windows if w == e and a <= t <= b]
        if inside:
            want[e, h] = min(inside)
    assert got == want and len(want) > 20


def test_percentile_sketch_keeps_its_bound(spark):
    """The rank of what it tells is within one part in ``accuracy`` of the rank asked for."""
    n, accuracy = 300_000, 200
    df = spark.range(n).select(F.lit("e").alias("environment"), F.lit("s").alias("service"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("duration_us"), F.col("id").alias("start_us"), F.lit(False).alias("is_error")).repartition(7)
    told = M.slo_inputs(df, accuracy).first().p99_us
    assert abs(told + 1 - 0.99 * n) <= n / accuracy + 1
    assert "percentile(" not in M.slo_inputs(df)._jdf.queryExecution().optimizedPlan().toString()


def test_columns_of_any_name(spark):
    """Columns named like the ones that operators use on the way come back as they were."""
    df = spark.createDataFrame([("e", "svc:op", "svc", 7, True)], "environment string, root_op string, service string, own_value int, told boolean")
    tuned = spark.createDataFrame([("svc", 0.3)], "service string, dominance double")
    assert B.with_threshold(df, tuned, "dominance", 0.5).select("own_value", "dominance").first() == (7, 0.3)
    over = spark.createDataFrame([("e", "svc:op", True)], "environment string, root_op string, no_missing_service boolean")
    out = B.apply_overrides(df.withColumn("no_missing_service", F.lit(False)), over).first()
    assert out.told is True and out.no_missing_service is True


def test_similar_incidents_equal_all_pairs(spark):
    r = random.Random(12)
    some = lambda names, k: sorted(r.sample(names, r.randint(0, k)))
    types, services = list("TUV"), [f"s{i}" for i in range(12)]
    row = lambda i: (r.choice("ef"), i, some(types, 3), some(services, 2))
    past, cur = [row(i) for i in range(400)], [row(1000 + i) for i in range(12)] + [("e", 2000, ["T"], ["other"]), ("e", 2001, [], [])]
    schema = "environment string, day int, types array<string>, services array<string>"
    for n in (1, 3, 5):
        got = {}
        for x in K.similar_incidents(spark.createDataFrame(cur, schema), spark.createDataFrame(past, schema), n).orderBy("place").collect():
            got.setdefault((x.environment, x.day), []).append((x.score, x.p_env, x.p_day))
        for e, day, t, s in cur:
            scored = sorted((-len(set(t) & set(pt)) - len(set(s) & set(ps)), pe, pd) for pe, pd, pt, ps in past)
            assert got.get((e, day), []) == [(-a, b, c) for a, b, c in scored[:n] if a < 0]


def test_recent_sums_equal_whole_windows(spark):
    """Ties, nulls, gaps and reaches of any length; no frame slides, so a row costs the same in a full window."""
    r = random.Random(13)
    rows = [(r.choice("ab"), f"t{i}", r.choice([0, 5000]) + r.randint(-300, 300), r.choice([None, r.random()])) for i in range(500)]
    df, key = spark.createDataFrame(rows, "k string, trace_id string, ts_us long, x double"), ["k"]
    for reach in (0, 1, 7, 100, 100_000):
        got = {x.trace_id: (x.n, x.s) for x in M.recent_sums(df, key, reach, n=F.lit(1).cast("bigint"), s=F.col("x")).collect()}
        for k, t, ts, _ in rows:
            held = [x for k2, _, ts2, x in rows if k2 == k and ts - reach <= ts2 <= ts]
            some = [x for x in held if x is not None]
            assert got[t][0] == len(held) and (got[t][1] is None) == (not some) and abs((got[t][1] or 0) - sum(some)) < 1e-9
    ops = spark.createDataFrame([("e", "s", "o", "t", 1, 0, 1.0, 5)], "environment string, service string, operation string, trace_id string, n long, errors long, mean_us double, ts_us long")
    for rolled in (M.with_rolling_mean(ops, M.OP, "mean_us", 60), M.with_error_rate(ops, M.OP, 60), M.with_spans_per_min(ops, 60)):
        plan = rolled._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "rangeframe" in plan and plan.count("rangeframe") == plan.count("rangeframe, unboundedpreceding")


def test_noise_is_told_from_one_look_at_the_operation(spark):
    """A filter below a projection takes the operation's expression in; it may stand there once only."""
    from spanwatch.functions import scalars as S

    names = ["GET /Health", "/v1/kv/x", "v1xkv", "/apps", "service_discovery", "serviceXdiscovery", "buy", "", "a (b) [c].d", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    extra = ("(B) [C].",)
    want = [None if n is None else any(p in n.lower() for p in (*S.NOISE, "(b) [c].")) for n in names]
    assert [x.noise for x in df.select(S.is_noise(F.col("name"), extra).alias("noise")).collect()] == want
    plan = df.select(F.reverse("name").alias("operation")).where(~S.is_noise(F.col("operation")))._jdf.queryExecution().optimizedPlan().toString()
    assert next(x for x in plan.splitlines() if "Filter" in x).count("reverse(") == 1


def test_exact_percentile_equals_sorting(spark):
    """Few rows, many, ties, nulls, a null key and a key without values; many rows go by the sketch's neighbourhood."""
    r = random.Random(14)
    groups = {"one": [5], "few": [r.randint(0, 9) for _ in range(5)], "ties": [7] * 300 + [9] * 4, None: [r.randint(0, 10**11) for _ in range(700)], "many": [int(r.expovariate(1e-9)) for _ in range(6000)], "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v long")
    for few in (10_000, 2_500):
        got = {x.k: x.p for x in M.exact_percentile(df, ["k"], "v", 0.99, "p", 0.001, few).collect()}
        want = {k: float(np.quantile(np.array(v, float), 0.99)) if v else None for k, v in groups.items()}
        assert set(got) == set(want)
        assert all(got[k] is None if w is None else abs(got[k] - w) <= 1e-9 * abs(w) for k, w in want.items()), (got, want)


def _kept(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_short_and_long_traces_give_the_same(spark, sf, monkeypatch):
    """Traces in rows of their own, those that are swept and a mixture have the same fingerprints, signatures and parents."""
    s = X.event_spans(spark, sf)
    found = []
    for most in (64, 0, 2):
        monkeypatch.setattr(T, "SHORT", most)
        f = _kept(T.fingerprint(s, min_spans=1), "environment", "trace_id", "fp_hash", "path", "root_op", "services", "span_count", "edge_count", "trace_start")
        e = _kept(E.error_signatures(s), "trace_id", "span_id", "service", "error_type", "http_status", "db_system", "operation", "call_path", "event_time", "sig_hash")
        found.append((f, e, _kept(T.resolve_parents(s, False), "trace_id", "span_id", "parent")))
    assert found[0] == found[1] == found[2] and all(map(len, found[0]))


def test_short_traces_are_shuffled_once(spark, sf):
    s = X.event_spans(spark, sf)
    for df in (T.fingerprint(s), E.error_signatures(s)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_spikes_of_a_busy_signature_fold_no_window_anew(spark, monkeypatch):
    """Many events of one signature inside one window, ten at a time, after a quiet start; only events of one time are a sliding frame."""
    quiet, n, window = [100 * k for k in range(12)], 3000, 1_000_000
    times = [t * 1_000_000 for t in quiet] + [5_000_000_000 + 1_000 * (k // 10) for k in range(n)]
    rows = spark.createDataFrame([(t, f"{k:06d}") for k, t in enumerate(times)], "us long, span_id string").withColumn("event_time", F.timestamp_micros("us"))
    sigs = rows.select(F.lit("e").alias("environment"), F.lit("s").alias("sig_hash"), F.lit("t").alias("trace_id"), "span_id", "event_time")
    monkeypatch.setattr(M, "stored", lambda df, name: df)
    base = 5 / (400 / 60)  # half of the first ten
    spikes = M.error_rate_spikes(sigs, None, window, 0.1, 10)
    rates = {f"{k:06d}": round((k + 1) / (window / 60), 9) for k in range(len(times)) if k >= 9 and (k + 1) / (window / 60) >= 0.1 * base}
    assert {x.span_id: (x.per_min, x.base_rate) for x in spikes.collect()} == {k: (v, round(base, 9)) for k, v in rates.items()} and len(rates) > 1000
    starts = re.findall(r"rangeframe, (\S+)\$\(\), ", plan := spikes._jdf.queryExecution().optimizedPlan().toString().lower())
    assert starts and len(starts) == plan.count("rangeframe") and set(starts) <= {"unboundedpreceding", "currentrow"}


def test_snapshot_rolls_up_to_services_and_environments(spark, sf):
    """The query returns all three levels: each row is the worst of the level below, with the counts and means of all its rows."""
    from spanwatch.plans.signal_queries import a_service_metrics

    def of(rows):
        levels = {"operation": [], "service": [], "environment": []}
        for x in rows:
            levels[x.level].append(x)
        return levels.values()

    order = ("learning", "ok", "warn", "anomaly").index
    ops, services, environments = of(a_service_metrics(spark, sf).collect())
    assert {(x.environment, x.service) for x in services} == {(x.environment, x.service) for x in ops} and {x.environment for x in environments} == {x.environment for x in ops}
    for rows, below, key in ((services, ops, lambda x: (x.environment, x.service)), (environments, services, lambda x: x.environment)):
        assert len({key(x) for x in rows}) == len(rows) > 0
        for x in rows:
            parts = [y for y in below if key(y) == key(x)]
            worst = max(parts, key=lambda y: (order(y.status), y.z, y.service, y.operation))
            assert (x.service, x.z, x.status) == (worst.service, worst.z, worst.status) and x.spans == sum(y.spans for y in parts)
            assert (x.parts, x.warn, x.anomalies) == (len(parts), *(sum(y.status == s for y in parts) for s in ("warn", "anomaly")))

    made = (("a", "x", 100, 8), ("a", "y", 300, 40), ("b", "x", 500, 5), ("c", "x", 900, 60))
    spans = [("e", f"t{n:03d}", s, o, n, d, o == "y" and n % 4 == 0) for s, o, d, many in made for n in range(many)]
    table = spark.createDataFrame(spans, "environment string, trace_id string, service string, operation string, s long, duration_us long, is_error boolean").withColumn("start_us", F.col("s") * 1_000_000)
    ops, services, environments = of(M.metrics_snapshot(table, 1000, 30).collect())
    assert {(x.service, x.operation): (x.latency_us, x.baseline_us, x.error_rate, x.status) for x in ops} == {
        ("a", "x"): (100, None, 0, "learning"), ("a", "y"): (300, 300, 0.25, "anomaly"), ("b", "x"): (500, None, 0, "learning"), ("c", "x"): (900, 900, 0, "ok")}
    assert {x.service: (x.operation, x.latency_us, x.baseline_us, round(x.error_rate, 9), x.spans, x.status) for x in services} == {
        "a": ("y", 300, 300, round(10 / 48, 9), 48, "anomaly"), "b": ("x", 500, None, 0, 5, "learning"), "c": ("x", 900, 900, 0, 60, "ok")}
    (e,) = environments
    assert (e.service, e.latency_us, round(e.error_rate, 9), e.spans, e.status, e.parts, e.warn, e.anomalies) == ("a", 400, round(10 / 48 / 3, 9), 113, "anomaly", 3, 0, 1)
