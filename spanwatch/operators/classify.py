"""Decisions about traces against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.config import DEFAULTS
from spanwatch.functions import scalars as S
from spanwatch.operators import baseline as B
from spanwatch.operators.baseline import KEY, ROOT


def lookup(fps: DataFrame, baseline: DataFrame) -> DataFrame:
    """``fps`` with the baseline's entry of the same hash (null where there is none)."""
    entry = baseline.select(*KEY, F.struct("occurrences", "auto_promoted", "watch_hits").alias("stored"))
    return fps.join(entry, KEY, "left")


def root_stats(baseline: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """One row per root op with what a decision needs: established entries, dominant services, union of services, span
    bounds, exemption, and the same of promoted entries."""
    est = B.established(baseline)
    dom = B.dominant_services(est, thresholds).groupBy(*ROOT).agg(F.array_sort(F.collect_list("service")).alias("dominant"))
    base = est.groupBy(*ROOT).agg(F.count("*").alias("variants"), F.max("no_missing_service").alias("exempt"))
    promoted = baseline.where("auto_promoted")
    prom = promoted.groupBy(*ROOT).agg(F.min("span_count").alias("promoted_min")).join(B.service_union(promoted, "promoted_services"), ROOT, "left")
    return base.join(B.service_union(est, "base_services"), ROOT, "left").join(dom, ROOT, "left").join(B.span_bounds(est), ROOT, "left").join(prom, ROOT, "full_outer")


def watch_services(fps: DataFrame) -> DataFrame:
    """All services seen in the window, by root op."""
    return B.service_union(fps, "seen")


def decide(fps: DataFrame, baseline: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """``fps`` with anomaly_type (null: none), missing services, and whether an override is proposed."""
    t = lookup(fps, baseline).join(root_stats(baseline, thresholds), ROOT, "left").join(watch_services(fps), ROOT, "left")
    t = t.withColumn("service", S.service_of(F.col("root_op")))
    t = B.with_threshold(t, thresholds, "span_count_spike_multiplier", DEFAULTS.spike_times)
    t = B.with_threshold(t, thresholds, "span_count_drop_threshold", DEFAULTS.drop_times)
    t = B.with_threshold(t, thresholds, "span_count_drop_min_baseline", DEFAULTS.drop_min)
    none = F.expr("cast(array() as array<string>)")
    t = t.withColumn("missing", F.array_sort(F.array_except(F.coalesce("dominant", none), "services")))
    absent = (F.size("missing") > 0) & ~F.coalesce("exempt", F.lit(False))
    elsewhere = F.size(F.array_except("missing", F.coalesce("seen", none))) == 0
    known = F.coalesce(F.col("stored.occurrences") >= DEFAULTS.learn_min_trace, F.lit(False))
    partial = F.coalesce((F.size(F.array_except("services", "promoted_services")) == 0) & (F.col("span_count") <= F.col("promoted_min")), F.lit(False))
    missing_kind = F.when(elsewhere, "OVERRIDE").otherwise("MISSING_SERVICE")
    unknown = F.when(absent, missing_kind).when(S.is_noise(F.col("path")), None).when(partial, None).otherwise("NEW_FINGERPRINT")
    familiar = (
        F.when(F.size(F.array_except("services", F.coalesce("base_services", none))) > 0, "NEW_SERVICE")
        .when((F.col("span_max") > 0) & (F.col("span_count") > F.col("span_max") * F.col("span_count_spike_multiplier")), "SPAN_COUNT_SPIKE")
        .when((F.col("span_min") >= F.col("span_count_drop_min_baseline")) & (F.col("span_count") < F.col("span_min") * F.col("span_count_drop_threshold")), "SPAN_COUNT_DROP")
        .when(absent, missing_kind)
    )
    verdict = F.when(F.coalesce(F.col("stored.auto_promoted"), F.lit(False)), None).when(~known, unknown).otherwise(familiar)
    return t.withColumn("verdict", verdict)


def classify_traces(fps: DataFrame, baseline: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Anomalous traces: environment, trace_id, fp_hash, root_op, service, anomaly_type, missing_services, span_count, trace_start."""
    d = decide(fps, baseline, thresholds).where("verdict is not null and verdict <> 'OVERRIDE'")
    gone = F.when(F.col("verdict") == "MISSING_SERVICE", F.array_join("missing", ",")).otherwise("")
    return d.select("environment", "trace_id", "fp_hash", "root_op", "service", F.col("verdict").alias("anomaly_type"), gone.alias("missing_services"), "span_count", "trace_start")


def override_suggestions(fps: DataFrame, baseline: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Root ops whose missing services were all seen elsewhere in the window: an optional path."""
    d = decide(fps, baseline, thresholds).where("verdict = 'OVERRIDE'")
    optional = B.service_union(d, "optional", "missing").select(*ROOT, F.array_join("optional", ",").alias("optional_services"))
    return d.groupBy(*ROOT).agg(F.count("*").alias("traces")).join(optional, ROOT)


def first_per_hash(anomalies: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("trace_start", "trace_id")
    return anomalies.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def silent_root_ops(fps: DataFrame, baseline: DataFrame, thresholds: DataFrame | None = None, least: int = DEFAULTS.silent_min) -> DataFrame:
    """Root ops of the baseline without a trace in the window: environment, root_op, fp_hash, missing_services."""
    g = baseline.groupBy(*ROOT).agg(F.sum("occurrences").alias("occurrences"), F.max("no_missing_service").alias("exempt"), F.max(S.is_noise(F.col("path"))).alias("noisy"))
    g = g.where((F.col("occurrences") >= least) & ~F.col("exempt") & ~F.col("noisy") & ~S.is_noise(S.operation_of(F.col("root_op"))))
    g = g.join(B.infra_only_root_ops(baseline), ROOT, "left_anti")
    g = g.join(fps.select(*ROOT).distinct(), ROOT, "left_anti")
    dom = B.dominant_services(baseline, thresholds).groupBy(*ROOT).agg(F.array_join(F.array_sort(F.collect_list("service")), ",").alias("missing_services"))
    return g.join(dom, ROOT).select(*ROOT, S.silent_hash(F.col("root_op")).alias("fp_hash"), "missing_services", "occurrences")


def drop_partial(fps: DataFrame, baseline: DataFrame) -> DataFrame:
    """Without unknown fingerprints under the p10 span count of their root op (under 0.7 of the largest where there is none)."""
    t = lookup(fps, baseline).join(B.p10_span_count(baseline), ROOT, "left").join(B.max_span_count(baseline), ROOT, "left")
    floor = F.coalesce(F.when(F.col("p10") > 0, F.col("p10").cast("double")), F.col("max_span_count") * 0.7, F.lit(0.0))
    return t.where(F.col("stored").isNotNull() | (F.col("span_count") >= floor)).select(*fps.columns)


def classify_traces_stream(fps: DataFrame, baseline: DataFrame) -> DataFrame:
    """The stream's rule: NEW_FINGERPRINT for hashes that the baseline lacks, unless partial; rare known ones are silent."""
    return drop_partial(fps, baseline).join(baseline.select(*KEY), KEY, "left_anti").withColumn("anomaly_type", F.lit("NEW_FINGERPRINT")).select("environment", "trace_id", "fp_hash", "root_op", "anomaly_type")


def restored(fps: DataFrame, drifts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Hashes that drifted before and now match an established entry: the first trace after the drift."""
    d = drifts.groupBy(*KEY).agg(F.min("trace_start").alias("drift_start"))
    ok = B.established_stream(baseline).select(*KEY)
    back = fps.join(d, KEY).where("trace_start > drift_start").join(ok, KEY, "left_semi")
    return back.groupBy(*KEY).agg(F.min("trace_start").alias("restored_at"), F.count("*").alias("traces"))


def missing_root_ops(fps: DataFrame, baseline: DataFrame, interval_s: int, as_of, factor: int = 4) -> DataFrame:
    """Silences of established root ops that call more than infrastructure: gaps of ``factor`` intervals or more after a trace (up to
    ``as_of`` for the last).

    Time is cut into slots as long as the shortest silence. None lies inside a slot, so traces are folded to the first and last one of each
    slot, and only a root op's slots, not its traces, are put in order."""
    length = factor * interval_s * 1_000_000
    watched = B.established_root_ops(baseline).join(B.infra_only_root_ops(baseline), ROOT, "left_anti")
    at = fps.join(watched, ROOT, "left_semi").select(*ROOT, F.unix_micros("trace_start").alias("at"))
    slots = at.groupBy(*ROOT, F.floor(F.col("at") / length).alias("slot")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    following = F.lead("first").over(Window.partitionBy(*ROOT).orderBy("slot"))
    until = F.coalesce(following, F.unix_micros(F.lit(as_of).cast("timestamp")))
    g = slots.withColumn("silence_s", F.floor((until - F.col("last")) / 1_000_000))
    return g.where(F.col("silence_s") >= factor * interval_s).select(*ROOT, F.timestamp_micros("last").alias("last_seen"), "silence_s")


def with_root_stats(fps: DataFrame, baseline: DataFrame) -> DataFrame:
    return fps.join(root_stats(baseline), ROOT, "left")


def drop_auto_noise(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Without NEW_FINGERPRINT events of services that start no trace of the baseline (all stay if it is empty)."""
    roots = baseline.select("environment", S.service_of(F.col("root_op")).alias("service")).distinct()
    some = roots.select("environment").distinct().withColumn("some", F.lit(True))
    j = events.join(roots.withColumn("starts", F.lit(True)), ["environment", "service"], "left").join(some, "environment", "left")
    return j.where("anomaly_type <> 'NEW_FINGERPRINT' or some is null or starts").select(*events.columns)
