"""Small cases of trace structure, errors, decisions and sources."""

import random

from pyspark.sql import functions as F

from spanwatch import schema
from spanwatch.config import BATCH, STREAM
from spanwatch.functions import scalars as S
from spanwatch.operators import baseline as B
from spanwatch.operators import classify as C
from spanwatch.operators import errors as E
from spanwatch.operators import traces as T
from spanwatch.sources import readers as R
from spanwatch.sources import sinks as K


def frame(spark, rows):
    """rows: (trace, span, parent, service, operation, start, duration, error tags)."""
    data = [("test", t, s, p, svc, op, a, d, False, dict(tags), None) for t, s, p, svc, op, a, d, tags in rows]
    return spark.createDataFrame(data, schema.SPANS).withColumn("event_time", F.timestamp_micros("start_us"))


def chain(trace, names, explicit=True, tags=()):
    """Child i starts 2 us after its parent and is shorter."""
    return [(trace, f"{trace}s{i}", f"{trace}s{i - 1}" if explicit and i else None, svc, op, 2 * i, 10_000 - 10 * i, dict(tags)) for i, (svc, op) in enumerate(names)]


PATH = [("api-gateway", "GET /owners"), ("customers-service", "GET /owners")]


def test_basic_path(spark):
    r = T.fingerprint(frame(spark, chain("a", PATH)), STREAM).first()
    assert (r.root_op, r.edge_count, len(r.services)) == ("api-gateway:GET /owners", 1, 2)


def test_hash_ignores_intra_service_spans_in_the_stream_profile_only(spark):
    more = chain("a", PATH) + [("a", "x", "as1", "customers-service", "query", 5, 10, {})]
    one, two = (T.fingerprint(frame(spark, r), STREAM).first() for r in (chain("a", PATH), more))
    assert one.fp_hash == two.fp_hash
    full = [T.fingerprint(frame(spark, r), BATCH).first().fp_hash for r in (chain("a", PATH), more)]
    assert full[0] != full[1]


def test_short_noisy_and_empty_traces(spark):
    assert T.fingerprint(frame(spark, chain("a", PATH[:1])), STREAM).count() == 0
    assert T.fingerprint(frame(spark, chain("a", [("svc", "/eureka/apps/delta"), ("b", "x")])), STREAM).count() == 0
    assert T.fingerprint(frame(spark, chain("a", [("svc", "GET /x"), ("b", "GET /health")])), STREAM).count() == 0
    assert T.fingerprint(frame(spark, chain("a", PATH)).limit(0), STREAM).count() == 0
    known = spark.createDataFrame([("test", "api-gateway:GET /owners")], "environment string, root_op string")
    assert T.fingerprint(frame(spark, chain("a", PATH[:1])), BATCH, known_root_ops=known).count() == 1


def test_parents(spark):
    rows = chain("a", PATH, explicit=False) + [("b", "p", None, "x", "op", 0, 100, {}), ("b", "c", "missing", "y", "op", 5, 10, {})]
    got = {r.span_id: r.parent for r in T.resolve_parents(frame(spark, rows)).collect()}
    assert got == {"as0": None, "as1": "as0", "p": None, "c": "p"}


def test_order_of_rows_does_not_matter(spark):
    rows = [x for t in "abcdef" for x in chain(t, [("s%d" % (i % 3), "op") for i in range(6)], explicit=False)]
    want = {(r.trace_id, r.fp_hash) for r in T.fingerprint(frame(spark, rows)).collect()}
    random.Random(1).shuffle(rows)
    assert {(r.trace_id, r.fp_hash) for r in T.fingerprint(frame(spark, rows).repartition(5)).collect()} == want


def test_error_signatures(spark):
    tags = {"error": "true", "exception.type": "NullPointerException"}
    sigs = E.error_signatures(frame(spark, chain("a", PATH, tags=tags))).collect()
    assert {(s.service, s.error_type, s.call_path) for s in sigs} == {("api-gateway", "NullPointerException", ""), ("customers-service", "NullPointerException", "api-gateway:GET /owners")}
    assert E.error_signatures(frame(spark, chain("a", PATH))).count() == 0
    status = E.error_signatures(frame(spark, chain("a", PATH[:1], tags={"http.status_code": "503"}))).first()
    assert (status.error_type, status.http_status) == ("503", "503")
    assert E.error_signatures(frame(spark, chain("a", [("s", "GET /health")], tags=tags))).count() == 0


def test_noise_table(spark):
    rows = [("/eureka/apps", True), ("GET /actuator/health", True), ("/READYZ", True), ("GET /owners", False), ("POST /pets", False), ("select", False)]
    for r in spark.createDataFrame(rows, "op string, noise boolean").select("noise", S.is_noise(F.col("op")).alias("got")).collect():
        assert r.noise == r.got


BASE = "environment string, fp_hash string, path string, root_op string, services array<string>, span_count int, span_count_min int, span_count_max int, edge_count int, occurrences bigint, watch_hits int, auto_promoted boolean, promoted_at timestamp, no_missing_service boolean, first_seen timestamp, last_seen timestamp"
FPS = "environment string, trace_id string, fp_hash string, path string, root_op string, services array<string>, span_count int, edge_count int, trace_start timestamp"


def entry(h, services, spans=6, n=10, promoted=False, exempt=False, root="a:op"):
    return ("test", h, h, root, services, spans, spans, spans, 1, n, 0, promoted, None, exempt, None, None)


def seen(h, services, spans=6, root="a:op", path=None):
    return ("test", "t" + h, h, path or h, root, services, spans, 1, None)


def decide(spark, base, live):
    b, f = spark.createDataFrame(base, BASE), spark.createDataFrame(live, FPS)
    return {r.fp_hash: r.verdict for r in C.decide(f, b).collect()}


def test_decision_table(spark):
    base = [entry("k", ["a", "b"]), entry("rare", ["a", "b"], n=2), entry("p", ["a"], promoted=True, spans=4, root="z:op"), entry("pk", ["a", "b"], promoted=True, n=1)]
    assert decide(spark, base, [seen("pk", ["a"])]) == {"pk": None}
    assert decide(spark, base, [seen("x", ["a"])]) == {"x": "MISSING_SERVICE"}
    assert decide(spark, base, [seen("x", ["a"]), seen("k", ["a", "b"])]) == {"x": "OVERRIDE", "k": None}
    assert decide(spark, base, [seen("x", ["a", "b"], path="a:/health -> b")]) == {"x": None}
    assert decide(spark, base, [seen("x", ["a"], spans=4, root="z:op")]) == {"x": None}
    assert decide(spark, base, [seen("x", ["a", "b"], spans=9)]) == {"x": "NEW_FINGERPRINT"}
    assert decide(spark, base, [seen("rare", ["a", "b"], spans=9)]) == {"rare": "NEW_FINGERPRINT"}
    assert decide(spark, base, [seen("k", ["a", "b", "c"])]) == {"k": "NEW_SERVICE"}
    assert decide(spark, base, [seen("k", ["a", "b"], spans=13)]) == {"k": "SPAN_COUNT_SPIKE"}
    assert decide(spark, base, [seen("k", ["a", "b"], spans=2)]) == {"k": "SPAN_COUNT_DROP"}
    assert decide(spark, base, [seen("k", ["a"])]) == {"k": "MISSING_SERVICE"}
    assert decide(spark, [entry("k", ["a", "b"], exempt=True)], [seen("x", ["a"])]) == {"x": "NEW_FINGERPRINT"}


def test_learning_twice_doubles(spark):
    rows = [x for i in range(4) for x in chain(f"t{i}", [("a", "op"), ("b", "op"), ("a", "op2")])]
    fps = T.fingerprint(frame(spark, rows))
    once = B.learn_trace(fps, min_occurrences=3)
    b = once.withColumn("services", F.array(F.lit("a")))
    twice = B.learn_trace(fps, prev=b)
    assert [r.occurrences for r in once.collect()] in ([], [4]) and [r.occurrences for r in twice.collect()] == [8] * once.count()


def test_merge_decay_and_hits(spark):
    a = spark.createDataFrame([entry("x", ["a"], n=5), entry("y", ["a"], n=1, promoted=True)], BASE)
    b = spark.createDataFrame([entry("x", ["b"], n=9), entry("y", ["b"], n=1), entry("z", ["b"], n=1)], BASE)
    m = {r.fp_hash: r for r in B.merge_trace_baselines(a, b).collect()}
    assert (m["x"].occurrences, m["x"].services, m["y"].services, m["y"].auto_promoted, len(m)) == (9, ["b"], ["a"], True, 3)
    assert B.merge_trace_baselines(a, a).exceptAll(a).count() == 0
    old = a.withColumn("last_seen", F.lit("2024-01-01").cast("timestamp"))
    assert {r.fp_hash: r.occurrences for r in B.decay(old, "2024-01-16").collect()} == {"x": 2, "y": 1}
    assert {r.fp_hash for r in B.decay(old, "2024-03-01").collect()} == {"y"}
    new = spark.createDataFrame([seen("n", ["a"]), seen("x", ["a"])], FPS)
    hits = {r.fp_hash: (r.watch_hits, r.auto_promoted, r.occurrences) for r in B.apply_watch_hits(a, new, "2024-02-01", 2).collect()}
    assert hits == {"x": (1, False, 5), "y": (0, True, 1), "n": (1, False, 1)}


def test_otlp(spark, tmp_path):
    line = (
        '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"api"}}]},"scopeSpans":[{"spans":['
        '{"traceId":"t","spanId":"a","parentSpanId":"0000","name":"GET /","startTimeUnixNano":"5000","endTimeUnixNano":"9000","status":{"code":2},"attributes":[{"key":"k","value":{"stringValue":"v"}}]},'
        '{"traceId":"t","spanId":"b","parentSpanId":"a","name":"x","startTimeUnixNano":"6000","endTimeUnixNano":"7000"}]}]}]}'
    )
    (tmp_path / "x.json").write_text(line)
    got = {r.span_id: r for r in R.read_otlp(spark, str(tmp_path)).collect()}
    assert (got["a"].parent_id, got["a"].service, got["a"].start_us, got["a"].duration_us, got["a"].is_error, got["a"].tags) == (None, "api", 5, 4, True, {"k": "v"})
    assert got["b"].parent_id == "a" and not got["b"].is_error


def test_baseline_versions(spark, tmp_path):
    a = spark.createDataFrame([entry("x", ["a"])], BASE)
    root = str(tmp_path / "base")
    first = K.write_baseline(a, root)
    K.write_baseline(a.withColumn("fp_hash", F.lit("y")), root)
    assert [r.fp_hash for r in K.read_baseline(spark, root).collect()] == ["y"]
    assert [r.fp_hash for r in K.read_baseline(spark, root, first).collect()] == ["x"]


def test_log_lines(spark):
    lines = ['drift "service": "a", "missing_services": "x, y"', 'latency anomaly "service": "b"', "nothing", 'drift "root_op": "c:op", "fp_hash": "h"']
    got = sorted((r.anomaly_type, r.service) for r in R.parse_log_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == [("LATENCY_ANOMALY", "b"), ("MISSING_SERVICE", "y"), ("NEW_FINGERPRINT", "c")]


def test_writers_of_one_number_conflict(spark, tmp_path, monkeypatch):
    """A writer that finds its number taken by a version that is current learns of it, and an update starts anew from that one."""
    root = f"file://{tmp_path}/b"
    rows = lambda n: spark.createDataFrame([("e", n)], "environment string, n int")
    K.write_baseline(rows(1), root)
    real, rivals = K.baseline_versions, [True]

    def with_rival(spark, root):
        told = real(spark, root)
        if rivals and told.count() == 2:  # ours is listed: another takes the same number
            rivals.pop()
            rows(10).write.partitionBy("environment").parquet(f"{root}/version=zz")
            told.where("number = 2").withColumn("version", F.lit("zz")).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
        return real(spark, root)

    monkeypatch.setattr(K, "baseline_versions", with_rival)
    K.update_baseline(spark, root, lambda b: b.withColumn("n", F.col("n") + 1))
    assert not rivals and K.read_baseline(spark, root).first().n == 11
