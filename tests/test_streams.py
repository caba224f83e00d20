"""Stateful steps against plain models, and streams against batch results."""

import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwatch.config import STREAM
from spanwatch.operators import metrics as M
from spanwatch.operators import traces as T
from spanwatch.sources import fixtures as X
from spanwatch.streaming import state as K
from spanwatch.streaming import streams as St


def run(step, rows, cuts=(), time="ts_ms", keep=None):
    """Rows through a step in micro-batches that end at ``cuts``, as tuples; with ``keep`` the times of that reach go along."""
    value, out, times = None, [], np.zeros(0, np.int64)
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if a < b:
            frame = pd.DataFrame(rows[a:b])
            value, more = step(value, frame) if keep is None else step(value, frame, times)
            if keep is not None:
                times = np.concatenate([times, frame[time].to_numpy(np.int64)])
                times = times[times >= times[-1] - keep]
            out += [] if more is None else list(more.itertuples(index=False, name=None))
    return out


def cut_points(draw_from):
    return st.lists(st.integers(0, draw_from), max_size=4).map(sorted)


@given(st.lists(st.integers(0, 500), max_size=40).map(sorted), cut_points(40))
@settings(max_examples=60, deadline=None)
def test_dedup_leaves_gaps_of_the_ttl(times, cuts):
    out = [t for t, in run(K.dedup_step(100, ["ts_ms"]), [{"ts_ms": t} for t in times], [min(c, len(times)) for c in cuts])]
    assert all(b - a >= 100 for a, b in zip(out, out[1:])) and (not times or out[0] == times[0])
    assert all(any(0 <= t - o < 100 for o in out) for t in times)


def throughput_model(times, window_ms, drop, learn, rearm):
    out, n, base, down = [], 0, 0.0, False
    for i, now in enumerate(times):
        rate = sum(t >= now - window_ms for t in times[: i + 1]) / (window_ms / 60_000)
        if n < learn:
            base = rate if n == 0 else 0.9 * base + 0.1 * rate
        elif rate / base < drop and not down:
            down = True
            out.append((now, rate, base))
        elif rate / base >= rearm:
            down, base = False, 0.95 * base + 0.05 * rate
        n += 1
    return out


@given(st.lists(st.sampled_from([0, 1, 1, 2, 3, 200]), max_size=120), cut_points(120))
@settings(max_examples=60, deadline=None)
def test_throughput_in_batches_equals_loops(gaps, cuts):
    times = np.cumsum(gaps).tolist()
    got = run(K.throughput_step(100, 0.5, 20, 0.75), [{"ts_ms": t} for t in times], [min(c, len(times)) for c in cuts], keep=100)
    assert got == throughput_model(times, 100, 0.5, 20, 0.75)


@given(st.lists(st.floats(-100, 100), min_size=31, max_size=50), cut_points(50))
@settings(max_examples=50, deadline=None)
def test_learn_state_is_the_mean_and_deviation(values, cuts):
    out = run(K.learn_step(30), [{"key": "k", "ts_ms": i, "value": v} for i, v in enumerate(values)], [min(c, len(values)) for c in cuts])
    mean = sum(values[:30]) / 30
    std = (sum((v - mean) ** 2 for v in values[:30]) / 30) ** 0.5
    assert len(out) == len(values) - 30 and all(abs(o[2] - mean) < 1e-6 and abs(o[3] - std) < 1e-6 for o in out)


def test_drifts_and_promotion():
    flags = [False, True, True, False, False, True]
    rows = [{"ts_ms": i, "drifting": f} for i, f in enumerate(flags)]
    for cuts in ([], [1], [2, 4], [1, 2, 3, 4, 5]):
        assert run(K.drift_step, rows, cuts) == [(1, "drift"), (3, "restored"), (5, "drift")]
        assert run(K.promotion_step(3), [{"ts_ms": i} for i in range(9)], cuts) == [(2, 3)]


def test_array_form_equals_joins(spark, sf):
    spans = X.chat_spans(spark, sf).unionByName(X.event_spans(spark, sf))
    kept = F.struct("start_us", "span_id", "parent_id", "service", "operation", "duration_us", "is_error", "tags")
    traces = spans.groupBy(*T.TRACE).agg(F.collect_list(kept).alias("spans"), F.min("event_time").alias("trace_start"))
    pick = lambda df: sorted((r.trace_id, r.fp_hash, r.span_count) for r in df.collect())
    assert pick(St.fingerprint_arrays(traces)) == pick(T.fingerprint(spans, STREAM))


def test_stream_equals_batch(spark, sf):
    """Rates and learned rates of the stream, of the batch form in segments, and of one segment."""
    from spanwatch.plans.base import stored
    from spanwatch.plans.stream_queries import drained

    f = T.fingerprint(X.event_spans(spark, sf)).withColumn("root_op", F.lit("all")).cache()
    how = {"drop": 0.95, "learn": 5, "rearm": 0.97}
    whole = M.throughput_alerts(M.throughput_fold(f, None, None, 86_400, **how))
    parts = M.throughput_drops(f, 3 * 86_400, lambda df: stored(df, "test"), 86_400, **how)
    arrivals = f.select("environment", "root_op", F.unix_millis("trace_start").alias("ts_ms"))
    stream = drained(lambda x: St.throughput_drops(x, 86_400_000, **how), arrivals, "ts_ms")
    pick = lambda df, t: sorted((r.environment, r.root_op, t(r), round(r.base, 6)) for r in df.collect())
    assert pick(whole, lambda r: r.ts_us) == pick(parts, lambda r: r.ts_us) != []
    assert [x[:3] for x in pick(whole, lambda r: r.ts_us // 1000)] == [x[:3] for x in pick(stream, lambda r: r.ts_ms)]


def test_throughput_state_carries_over(spark):
    """Two half ranges with the state between them equal one range, for root ops that pause too."""
    r = random.Random(4)
    rows = [("e", f"op{k}", f"{k}-{i}", int(t)) for k in range(4) for i, t in enumerate(sorted(r.uniform(0, 4000) ** (1 + k / 6) for _ in range(150 if k else 30)))]
    f = spark.createDataFrame(rows, "environment string, root_op string, trace_id string, s long").withColumn("trace_start", F.timestamp_seconds("s"))
    whole = M.throughput_alerts(M.throughput_fold(f, None, None, 300, 0.9, 5, 0.95)).collect()
    for cut in (900, 2500):
        first = M.throughput_fold(f.where(f"s < {cut}"), None, None, 300, 0.9, 5, 0.95)
        second = M.throughput_fold(f.where(f"s >= {cut} - 300"), first, cut * 1_000_000, 300, 0.9, 5, 0.95)
        got = M.throughput_alerts(first).collect() + M.throughput_alerts(second).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(whole) > 5


def spike_model(times, window, times_base, least, minute):
    """Spikes of one signature's sorted times by loops over a list of its events: those of twice the window are kept."""
    held, out, base = [], [], None
    for now in times:
        held = [t for t in [*held, now] if t > now - 2 * window]
        rate = sum(t > now - window for t in held) / (window / minute)
        if base is None and len(held) >= least:
            older = held[: len(held) // 2]
            if len(older) >= 2 and older[-1] > older[0]:
                base = len(older) / ((older[-1] - older[0]) / minute)
        if base is not None and rate >= base * times_base:
            out.append((now, rate, base))
    return out


UNEVEN = st.lists(st.sampled_from([0, 0, 1, 2, 7, 60, 130]), max_size=80).map(lambda gaps: np.cumsum(gaps).tolist())


@given(UNEVEN, cut_points(80))
@settings(max_examples=100, deadline=None)
def test_spike_step_equals_the_model(times, cuts):
    step = K.spike_step(100, 1.5, 4, minute=10)
    got = run(step, [{"ts_us": t} for t in times], [min(c, len(times)) for c in cuts], "ts_us", 200)
    assert got == spike_model(times, 100, 1.5, 4, 10)


def test_error_spikes_on_uneven_gaps(spark):
    r = random.Random(8)
    rows, want = [], set()
    for k in range(30):
        times = np.cumsum([r.choice([0, 0, 1, 5, 40, 200, 900]) for _ in range(r.randint(0, 90))]).tolist()
        rows += [("e", f"s{k}", "t", f"{i:04d}", t) for i, t in enumerate(times)]
        want |= {("e", f"s{k}", t * 1_000_000, round(a, 6), round(b, 6)) for t, a, b in spike_model(times, 300, 2.0, 6, 60)}
    df = spark.createDataFrame(rows, "environment string, sig_hash string, trace_id string, span_id string, s long").withColumn("event_time", F.timestamp_seconds("s"))
    got = M.error_rate_spikes(df, None, 300, 2.0, 6).collect()
    assert {(x.environment, x.sig_hash, x.ts_us, round(x.per_min, 6), round(x.base_rate, 6)) for x in got} == want and len(want) > 20


def incident_model(rates, spike, calm, shortest, stable):
    """Changes of state by the tracker's rules: a short spike is noise, a spike again keeps its start, any calm rate lets time pass."""
    state, spiked, calmed, out = "NORMAL", None, None, []
    for minute, rate in rates:
        before = state
        if state in ("NORMAL", "HEAL"):
            state = "NORMAL"
            if rate >= spike:
                state, spiked = "SPIKING", minute
        elif state == "SPIKING":
            if rate < spike and minute - spiked < shortest:
                state = "NORMAL"
            elif rate < calm:
                state, calmed = "RESOLVING", minute
        elif rate >= spike:
            state = "SPIKING"
        elif minute - calmed >= stable:
            state = "HEAL"
        if state != before:
            out.append((minute, state))
    return out


def test_incident_states_equal_the_model(spark):
    from spanwatch.operators import correlate as C

    r = random.Random(3)
    rows, want = [], set()
    told = [(0, 2.0), (1, 0.5), (2, 0.5), (3, 0.5), (8, 0.1), (10, 0.5), (20, 0.5)]
    series = {"told": told} | {f"e{k}": sorted({r.randint(0, 200): r.choice([0.0, 0.1, 0.5, 1.2, 3.0]) for _ in range(90)}.items()) for k in range(12)}
    for name, rates in series.items():
        rows += [(name, m, x) for m, x in rates]
        want |= {(name, m, s) for m, s in incident_model(rates, 1.0, 0.2, 4, 5)}
    assert [x[1:] for x in sorted(want) if x[0] == "told"] == [(0, "SPIKING"), (1, "NORMAL")]
    df = spark.createDataFrame(rows, "environment string, minute long, rate double").repartition(5)
    assert {tuple(x) for x in C.incident_states(df, 1.0, 0.2, 5, 4).collect()} == want and {s for *_, s in want} >= {"HEAL", "RESOLVING"}


def test_noise_support(spark):
    from spanwatch.operators import correlate as K

    ops = ["s:GET /health/x", "s:GET /health/y", "t:GET /orders/1", "u:POST /pay"]
    b = spark.createDataFrame([(f"h{i}", o, True, i) for i, o in enumerate(ops)] + [("h9", "s:GET /health/z", False, 0)], "fp_hash string, root_op string, auto_promoted boolean, watch_hits int")
    got = {r.part: r for r in K.noise_suggestions(b).collect()}
    health = [r for p, r in got.items() if "health" in p]
    assert health and max(r.fingerprints for r in health) == 2 and all("/health/z" not in r.examples for r in got.values())


def test_late_spans_are_counted(spark, sf):
    from spanwatch.plans import QUERIES

    early = X.event_spans(spark, sf).where("event_time < timestamp '2024-01-10'").count()
    assert 0 < QUERIES["st_late_spans"](spark, sf).first().dropped_rows <= early


def test_promotion_in_warmup():
    rows = [{"ts_ms": t} for t in (5, 6, 7, 50, 60)]
    for cuts in ([], [1], [2, 3]):
        assert run(K.promotion_step(3, 10), rows, cuts) == [(5, 1)]
        assert run(K.promotion_step(3, 4), rows, cuts) == [(7, 3)]


def test_windows_by_slot_equal_whole_windows(spark):
    """Rolling measures, sessions and learn statistics against windows over a key's whole history."""
    import random

    from pyspark.sql import Window

    from spanwatch.operators import correlate as K

    r = random.Random(6)
    rows = [(r.choice("ab"), str(i), r.randint(0, 3000), r.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, trace_id string, ts_us long, x double")
    w = Window.partitionBy("k").orderBy("ts_us").rangeBetween(-70, 0)
    pick = lambda d, *c: sorted(tuple(x) for x in d.select("trace_id", *[F.round(n, 9) for n in c]).collect())
    assert pick(M.over_recent(df, ["k"], 70, m=F.avg("x"), n=F.count("*")), "m", "n") == pick(df.withColumn("m", F.avg("x").over(w)).withColumn("n", F.count("*").over(w)), "m", "n")
    n = F.row_number().over(Window.partitionBy("k").orderBy("ts_us", "trace_id"))
    first = F.when(F.col("n") <= 30, F.col("x"))
    whole = df.withColumn("n", n).withColumn("base_mean", F.avg(first).over(Window.partitionBy("k"))).withColumn("base_std", F.stddev_pop(first).over(Window.partitionBy("k")))
    assert pick(M.with_learn_stats(df, ["k"], "x", 30), "base_mean", "base_std") == pick(whole, "base_mean", "base_std")
    e = df.select("k", F.col("trace_id").alias("event_id"), F.col("ts_us").alias("ts_ms")).unionByName(spark.createDataFrame([(None, "n1", 5), (None, "n2", 900)], "k string, event_id string, ts_ms long"))
    for gap in (3, 8, 20):
        order = Window.partitionBy("k").orderBy("ts_ms", "event_id")
        plain = e.withColumn("new", F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(order) > gap).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(order))
        sets = lambda d: {frozenset(x.ids) for x in d.groupBy("k", "session").agg(F.collect_list("event_id").alias("ids")).collect()}
        assert sets(K._sessions(e, ["k"], gap)) == sets(plain)


def test_buffer_releases_by_the_first_span(spark):
    """A trace that never pauses is released all the same."""
    from spanwatch.plans.stream_queries import drained

    rows = [("e", "busy", f"s{i}", None, "svc", "op", i, 1, False, {}, 1000 + 4 * i) for i in range(10)] + [("e", "last", "z", None, "svc", "op", 0, 1, False, {}, 5000)]
    schema = "environment string, trace_id string, span_id string, parent_id string, service string, operation string, start_us long, duration_us long, is_error boolean, tags map<string,string>, s long"
    df = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds("s")).drop("s")
    got = sorted((r.trace_id, len(r.spans)) for r in drained(lambda x: St.buffer_traces(x, 10_000, "1 second"), df, "event_time").collect())
    assert got == [("busy", 1), ("busy", 3), ("busy", 3), ("busy", 3)]


def walk_model(calls, start):
    """The end of each walk over heaviest calls (of equal ones the first name), at the first node met twice or without a call."""
    ends = {}
    for origin in start:
        node, been = origin, {origin}
        while node in calls:
            node = min((-w, callee) for callee, w in calls[node].items())[1]
            if node in been:
                break
            been.add(node)
        ends[origin] = node
    return ends


def test_walks_go_to_the_end(spark):
    """A chain of ten services, rings, and random graphs: candidates, causal chain and secondary services without a bound of hops."""
    from spanwatch.operators import topology as G

    r = random.Random(5)
    graphs = {"chain": {f"s{i}": {f"s{i + 1}": 1} for i in range(9)}, "ring": {"a": {"b": 1}, "b": {"c": 1}, "c": {"a": 1}, "x": {"a": 1}}}
    for k in range(4):
        graphs[f"g{k}"] = {f"n{i}": {f"n{r.randint(0, 14)}": r.randint(1, 3) for _ in range(r.randint(0, 3))} for i in range(15)}
        graphs[f"g{k}"] = {a: {b: w for b, w in c.items() if a != b} for a, c in graphs[f"g{k}"].items()}
        graphs[f"g{k}"] = {a: c for a, c in graphs[f"g{k}"].items() if c}
    edges = spark.createDataFrame([(e, a, b, w) for e, g in graphs.items() for a, c in g.items() for b, w in c.items()], "environment string, caller string, callee string, n int")
    nodes = {e: sorted(set(g) | {b for c in g.values() for b in c}) for e, g in graphs.items()}
    active = spark.createDataFrame([(e, n, "LATENCY_ANOMALY", 0) for e, ns in nodes.items() for n in ns], "environment string, service string, anomaly_type string, ts_ms long")
    got = {(x.environment, x.candidate): x.supporters for x in G.root_candidates(edges, active).collect()}
    want = {}
    for e, g in graphs.items():
        for end in walk_model(g, nodes[e]).values():
            want[e, end] = want.get((e, end), 0) + 1
    assert got == want and got["chain", "s9"] == 10
    roots = spark.createDataFrame([("chain", "s9"), ("ring", "b"), ("g0", "n3")], "environment string, node string")
    chain = {(x.environment, x.node): x.hops for x in G.causal_chain(edges, active, roots).collect()}
    assert [chain["chain", f"s{i}"] for i in range(10)] == [9 - i for i in range(10)] and chain["ring", "x"] == 2
    told = {(x.environment, x.service) for x in G.secondary_services(edges, active, roots).collect()}
    assert {("chain", f"s{i}") for i in range(9)} <= told and ("chain", "s9") not in told
    assert told == {k for k, hops in chain.items() if hops > 0}


def test_buffer_holds_many_traces_a_key():
    """One call takes the traces of a bucket; late spans move a buffer's start, what the watermark has passed goes."""
    from types import SimpleNamespace

    class Handle:
        rows, timers = [], []
        getListState = lambda self, *_: self
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        listTimers = lambda self: iter(self.timers)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def deleteTimer(self, t):
            self.timers = [x for x in self.timers if x != t]

        def registerTimer(self, t):
            self.timers = [*self.timers, t]

    handle, buffer = Handle(), K.TraceBuffer(["environment", "bucket"], 10)
    buffer.init(handle)
    told = lambda frames: [tuple(x) for f in frames for x in f[["trace_id", "first_ms", "spans"]].itertuples(index=False)]
    put = lambda *rows: told(buffer.handleInputRows(("e", 1), iter([pd.DataFrame(list(rows), columns=["trace_id", "ts_ms", "span"])]), None))
    assert put(("a", 5, "1"), ("b", 7, "2"), ("a", 15, "3")) == [("a", 5, "[1]")] and handle.timers == [17]
    assert put(("b", 6, "4"), ("b", 16, "5"), ("c", 30, "6")) == [("b", 6, "[4,2]")] and handle.timers == [25]
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 26)
    assert told(buffer.handleExpiredTimer(("e", 1), at, None)) == [("a", 15, "[3]"), ("b", 16, "[5]")] and handle.timers == [40]


def test_drifts_of_one_millisecond_follow_their_microseconds(spark, tmp_path):
    """Two traces of a key in one millisecond, of which one drifts: what comes out doesn't depend on how they arrive."""
    from spanwatch.plans.stream_queries import st_active_drifts

    rows, wanted, at = [], set(), pd.Timestamp("2024-01-01 01:00:00")
    for n, (service, first) in enumerate([("click", 4), ("view", 2), ("search", 4), ("scroll", 2)]):
        for trace, spans in enumerate([first, 6 - first]):  # the first begins at microsecond 100, the second at 500
            user, start = 3 * (2 * n + (trace if n < 2 else 1 - trace)), at + pd.Timedelta(microseconds=100 + 400 * trace)
            rows += [(len(rows) + k, start + pd.Timedelta(minutes=k), user, service, 0.0, '{"k": 0}') for k in range(spans)]
        ts_ms = at.value // 1_000_000
        wanted |= {(service, ts_ms, c) for c in (("drift", "restored") if first == 4 else ("drift",))}
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    for name, table in (("as", events), ("back", events.iloc[::-1])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(table).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        hashes = {r.fp_hash: r.service for r in T.fingerprint(X.event_spans(spark, f"{tmp_path}/{name}")).selectExpr("fp_hash", "split(root_op, ':')[0] as service").distinct().collect()}
        out = [(hashes[r.fp_hash], r.ts_ms, r.change) for r in st_active_drifts(spark, f"{tmp_path}/{name}").collect()]
        assert len(out) == len(wanted) and set(out) == wanted
