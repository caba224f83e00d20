"""Structured Streaming forms of the operators: event time with watermarks, windows and keyed state."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from spanwatch.config import STREAM, Profile
from spanwatch.functions import scalars as S
from spanwatch.streaming import state

# ---- windows


def tumbling_rates(events: DataFrame, size: str = "5 minutes", delay: str = "10 minutes", key: str = "service", time: str = "event_time") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sliding_latency(spans: DataFrame, size: str = "2 minutes", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    w = spans.withWatermark("event_time", delay).groupBy(F.window("event_time", size, slide), "environment", "service", "operation")
    return w.agg(F.avg("duration_us").alias("mean_us"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "environment", "service", "operation", "mean_us", "n")


def session_incidents(events: DataFrame, gap: str = "15 minutes", delay: str = "15 minutes", keys: tuple[str, ...] = ("environment", "service")) -> DataFrame:
    w = events.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), *keys, "n")


_SPAN = "struct<start_us:bigint,span_id:string,parent_id:string,service:string,operation:string,duration_us:bigint,is_error:boolean,tags:map<string,string>>"


def buffer_traces(spans: DataFrame, timeout_ms: int = 10_000, delay: str = "10 seconds", buckets: int = 256) -> DataFrame:
    """Spans of a trace as one row (environment, trace_id, spans, trace_start), released ``timeout_ms`` after its first span by event time,
    however busy the trace is; later spans make a new row. Spans behind the watermark are dropped and counted by the query's
    numRowsDroppedByWatermark. State is kept by ``buckets`` of traces an environment (as a checkpoint has it, the number stays); a bucket holds the
    spans of its open buffers."""
    names = ["start_us", "span_id", "parent_id", "service", "operation", "duration_us", "is_error"]
    kept = F.to_json(F.struct(*names, "tags"))
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = spans.withWatermark("event_time", delay).select("environment", bucket, "trace_id", "event_time", F.unix_millis("event_time").alias("ts_ms"), kept.alias("span"))
    keys = ["environment", "bucket"]
    released = state.keyed(rows, keys, state.TraceBuffer(keys, timeout_ms), "trace_id string, first_ms long, spans string", event_time=True)
    return released.select("environment", "trace_id", F.from_json("spans", f"array<{_SPAN}>").alias("spans"), F.timestamp_millis("first_ms").alias("trace_start"))


def signature_arrays(traces: DataFrame, profile: Profile = STREAM) -> DataFrame:
    """Error signatures of buffered traces: one row per error span, with the hash of the batch rules. Ancestors are found by walking
    up a map of the trace's spans, ``profile.frames`` steps at most."""
    spans = F.transform("spans", lambda s: F.struct(s["span_id"].alias("id"), s["parent_id"].alias("up"), F.concat_ws(":", s["service"], s["operation"]).alias("frame")))
    t = traces.withColumn("known", F.map_from_entries(F.transform(spans, lambda s: F.struct(s["id"], s))))
    e = t.select("environment", "trace_id", "known", F.explode("spans").alias("s")).where(F.col("s.is_error") | S.is_error(F.col("s.tags"), profile.name))
    e = e.where(~S.error_op_excluded(F.col("s.operation"), profile.name))
    up, path = F.try_element_at("known", F.col("s.parent_id")), F.lit("")
    for _ in range(profile.frames):
        path = F.when(up.isNotNull(), F.concat_ws(" -> ", up["frame"], F.nullif(path, F.lit("")))).otherwise(path)
        up = F.try_element_at("known", up["up"])
    tag = lambda k: F.coalesce(F.try_element_at("s.tags", F.lit(k)), F.lit(""))
    e = e.select("environment", "trace_id", F.col("s.span_id").alias("span_id"), F.col("s.service").alias("service"), S.error_type(F.col("s.tags")).alias("error_type"), tag("http.status_code").alias("http_status"), F.col("s.operation").alias("operation"), path.alias("call_path"))
    return e.withColumn("sig_hash", S.sig_hash(*[F.col(c) for c in ("service", "error_type", "http_status", "operation", "call_path")]))


def fingerprint_arrays(traces: DataFrame, profile: Profile = STREAM, min_spans: int = 2) -> DataFrame:
    """Fingerprints of buffered traces (one array of spans a row) with array functions only: the batch rules, without joins."""
    t = traces.withColumn("spans", F.array_sort(F.transform("spans", lambda s: F.struct(s["start_us"].alias("start_us"), s["span_id"].alias("span_id"), s["parent_id"].alias("parent_id"), s["service"].alias("service"), s["operation"].alias("operation"), s["duration_us"].alias("duration_us")))))

    def parent_of(s):
        known = F.filter("spans", lambda p: p["span_id"] == s["parent_id"])
        held = F.filter("spans", lambda p: (p["span_id"] != s["span_id"]) & (p["start_us"] <= s["start_us"]) & (s["start_us"] < p["start_us"] + p["duration_us"]))
        best = F.array_min(F.transform(held, lambda p: F.struct(p["duration_us"], p["start_us"], p["span_id"], p["service"], p["operation"])))
        nearest = F.when(best.isNotNull(), F.struct(best["service"].alias("service"), best["operation"].alias("operation")))
        told = F.try_element_at(known, F.lit(1))
        return F.when(told.isNotNull(), F.struct(told["service"].alias("service"), told["operation"].alias("operation"))).otherwise(nearest) if profile.explicit_parents else nearest

    t = t.withColumn("placed", F.transform("spans", lambda s: F.struct(s["service"].alias("service"), s["operation"].alias("operation"), parent_of(s).alias("p"))))
    root = F.coalesce(F.try_element_at(F.filter("placed", lambda s: s["p"].isNull()), F.lit(1)), F.try_element_at("placed", F.lit(1)))
    edges = F.filter("placed", lambda s: s["p"].isNotNull() & ((s["p"]["service"] != s["service"]) if profile.cross_service_only else F.lit(True)))
    texts = F.transform(edges, lambda s: F.concat_ws(" -> ", F.concat_ws(":", s["p"]["service"], s["p"]["operation"]), F.concat_ws(":", s["service"], s["operation"])))
    t = t.withColumn("root", root).withColumn("edges", F.array_distinct(texts) if profile.cross_service_only else texts)
    t = t.withColumn("root_op", F.concat_ws(":", "root.service", "root.operation")).withColumn("path", F.when(F.size("edges") > 0, F.array_join("edges", " -> ")).otherwise(F.col("root_op")))
    noisy = F.exists("spans", lambda s: S.is_noise(s["operation"]))
    t = t.where((F.size("spans") >= min_spans) & ~S.is_noise(F.col("root.operation")) & ~((F.size("spans") <= 3) & noisy))
    return t.select("environment", "trace_id", S.fp_hash(F.col("path")).alias("fp_hash"), "path", "root_op", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["service"]))).alias("services"), F.size("spans").alias("span_count"), F.size("edges").alias("edge_count"), "trace_start")


def fingerprint_batches(traces: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, profile: Profile = STREAM):
    """Fingerprints of buffered traces of any length: each micro-batch's spans go through the batch operator, whose parents come from a sweep
    (:func:`fingerprint_arrays` looks at all spans for each, which suits short traces)."""
    from spanwatch.operators.traces import fingerprint

    def each(batch: DataFrame, _):
        spans = batch.select("environment", "trace_id", F.explode("spans").alias("s")).select("environment", "trace_id", "s.*")
        write(fingerprint(spans, profile))

    return traces.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def after_warmup(events: DataFrame, start, warmup_s: int = 120, time: str = "event_time") -> DataFrame:
    return events.where(F.unix_micros(time) >= F.unix_micros(F.lit(start).cast("timestamp")) + warmup_s * 1_000_000)


def classify_batches(fps: DataFrame, read_baseline: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str):
    """Classify each micro-batch of fingerprints against the baseline that is current when it runs."""
    from spanwatch.operators.classify import classify_traces_stream

    def each(batch: DataFrame, _):
        write(classify_traces_stream(batch, read_baseline()))

    return fps.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


# ---- keyed state


def _fold(rows: DataFrame, keys: list[str], types: str, step: state.Step, output: str, order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    return state.keyed(rows, keys, state.Fold(keys, types, step, list(order)), output)


def _dedup(rows: DataFrame, keys: list[str], ttl_ms: int, delay: str) -> DataFrame:
    names = ["ts_ms", "event_id"]
    fold = state.Fold(keys, "last_ms long", state.dedup_step(ttl_ms, names), names, ttl_ms)
    return state.keyed(rows.withWatermark("event_time", delay), keys, fold, "ts_ms long, event_id long", event_time=True)


def dedup_events(events: DataFrame, ttl_ms: int = 120_000, delay: str = "10 minutes") -> DataFrame:
    """Events of which none of the same type and hash passed within ``ttl_ms`` before. A key's state goes ``ttl_ms`` after its last event."""
    return _dedup(events, ["anomaly_type", "hash"], ttl_ms, delay)


def dedup_alerts(events: DataFrame, ttl_ms: int = 120_000, delay: str = "10 minutes") -> DataFrame:
    """The same by hash, or by type, service and operation where the hash is empty."""
    key = F.coalesce(S.filled(F.col("hash")), F.concat_ws(":", "anomaly_type", "service", "root_op"))
    return _dedup(events.withColumn("key", key), ["key"], ttl_ms, delay)


def throughput_drops(arrivals: DataFrame, window_ms: int = 300_000, **options) -> DataFrame:
    """Traces (environment, root_op, ts_ms) as they arrive: their rates are counted in the state, from the times of one window."""
    keys = ["environment", "root_op"]
    fold = state.Recent(keys, "n long, base double, down boolean", state.throughput_step(window_ms, **options), "ts_ms", window_ms)
    return state.keyed(arrivals, keys, fold, "ts_ms long, rate double, base double")


def error_spikes(sigs: DataFrame, window_us: int = 300_000_000, **options) -> DataFrame:
    """Error events (environment, sig_hash, ts_us) whose rate is a multiple of the one that their signature had when it was learned."""
    keys = ["environment", "sig_hash"]
    fold = state.Recent(keys, "base double", state.spike_step(window_us, **options), "ts_us", 2 * window_us)
    return state.keyed(sigs, keys, fold, "ts_us long, per_min double, base double")


def learn_state(samples: DataFrame, n: int = 30) -> DataFrame:
    types = "count long, mean double, squares double"
    return _fold(samples, ["key"], types, state.learn_step(n), "ts_ms long, value double, mean double, std double", ("ts_ms", "value"))


def promotion_counts(detections: DataFrame, threshold: int = 10, warmup_until_ms: int | None = None) -> DataFrame:
    step = state.promotion_step(threshold, warmup_until_ms)
    return _fold(detections, ["environment", "fp_hash"], "n long", step, "ts_ms long, detections long")


def active_drifts(states: DataFrame, order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """Changes of drifting(environment, fp_hash, ts_ms, drifting). ``order`` settles which of several states of one time comes first; by the time
    alone they would follow as they arrive."""
    return _fold(states, ["environment", "fp_hash"], "drifting boolean", state.drift_step, "ts_ms long, change string", order)


def silence_timer(fps: DataFrame, silence_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Root ops (environment, root_op, ts_ms, event_time) that fall silent: once per silence, armed again by the next trace."""
    keys = ["environment", "root_op"]
    return state.keyed(fps.withWatermark("event_time", delay), keys, state.Silence(keys, silence_ms), "last_ms long", event_time=True)


# ---- counters of a running query


class RunCounters(StreamingQueryListener):
    """Writes what :func:`counted` observes: a row per query, batch and counter to the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.written: set[tuple[str, int]] = set()

    def settled(self, query, seconds: float = 60) -> bool:
        """Wait until every batch that ``query`` reports is written; events come after the batches they tell of."""
        asked = {(str(p.id), p.batchId) for p in query.recentProgress if p.numInputRows}
        until = time.monotonic() + seconds
        while not asked <= self.written and time.monotonic() < until:
            time.sleep(0.05)
        return asked <= self.written

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        told = [(str(p.id), p.batchId, p.timestamp, name, int(n or 0)) for row in p.observedMetrics.values() for name, n in row.asDict().items()]
        if told and p.numInputRows:
            rows = self.spark.createDataFrame(told, "query_id string, batch_id long, at string, counter string, value long")
            rows.coalesce(1).write.mode("append").parquet(self.path)
            self.written.add((str(p.id), p.batchId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted(rows: DataFrame, name: str, **counters: Column) -> DataFrame:
    """``rows``, whose ``counters`` (aggregates) are observed in each micro-batch as the stream runs."""
    return rows.observe(name, *[c.alias(n) for n, c in counters.items()])


def late_span_metrics(query) -> int:
    """Rows that the watermark has dropped so far."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in (json.loads(p.json) if hasattr(p, "json") else p)["stateOperators"])
