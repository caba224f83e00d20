"""Error signatures and what is unusual about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.config import BATCH, DEFAULTS, Profile
from spanwatch.functions import scalars as S
from spanwatch.operators.traces import TRACE, by_length, call_path, short_call_paths, short_traces, swept_parents

SIG = ["environment", "sig_hash"]
_PARTS = ["service", "error_type", "http_status", "db_system", "operation", "call_path"]


def error_signatures(spans: DataFrame, profile: Profile = BATCH) -> DataFrame:
    """One row per error span: type, status, database, operation, call path and their hash."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    bad = (F.col("is_error") | S.is_error(F.col("tags"), profile.name)) & ~S.error_op_excluded(F.col("operation"), profile.name)
    told = F.struct(S.error_type(F.col("tags")).alias("error_type"), tag("http.status_code").alias("http_status"), tag("db.system").alias("db_system"), "event_time")
    given = ["parent"] if "parent" in spans.columns else ["parent_id"] if profile.explicit_parents else []
    fields = ["start_us", "span_id", "duration_us", "service", "operation", *given]
    short, long = by_length(spans.select(*TRACE, *fields, F.when(bad, told).alias("error")))
    short = short.where(F.exists("spans", lambda s: s["error"].isNotNull()))
    e = short_call_paths(short_traces(short, [*fields, "error"], profile.explicit_parents), lambda s: s["error"].isNotNull(), profile.frames)
    e = e.select(*TRACE, "s.span_id", "s.service", "s.operation", "s.error", "call_path")
    if long is not None:
        e = e.unionByName(call_path(swept_parents(long, profile.explicit_parents), profile.frames).where("error is not null").select(*e.columns))
    e = e.select(*TRACE, "span_id", "service", "error.error_type", "error.http_status", "error.db_system", "operation", "call_path", "error.event_time")
    return e.withColumn("sig_hash", S.sig_hash(*[F.col(c) for c in ("service", "error_type", "http_status", "operation", "call_path")]))


def watch_counts(sigs: DataFrame) -> DataFrame:
    return sigs.groupBy(*SIG, "service").agg(F.count("*").alias("n"))


def learn_error(sigs: DataFrame, prev: DataFrame | None = None, min_occurrences: int = DEFAULTS.learn_min_error) -> DataFrame:
    """A new error baseline: known signatures add their counts, new ones need ``min_occurrences``; signatures
    not seen and not promoted are dropped."""
    first = {c: F.min_by(c, F.struct("event_time", "trace_id", "span_id")).alias(c) for c in _PARTS}
    now = sigs.groupBy(*SIG).agg(F.count("*").alias("n"), F.min("event_time").alias("seen"), *first.values())
    if prev is None:
        return now.where(F.col("n") >= min_occurrences).select(
            *SIG, *_PARTS, F.col("n").alias("occurrences"), F.lit(0).alias("watch_hits"), F.lit(False).alias("auto_promoted"), F.lit(None).cast("timestamp").alias("promoted_at"), F.col("seen").alias("first_seen")
        )
    old = prev.select(*SIG, *[F.col(c).alias("old_" + c) for c in prev.columns if c not in SIG])
    j = now.join(old, SIG, "full_outer")
    known = F.col("old_occurrences").isNotNull()
    kept = j.where((known & (F.col("n").isNotNull() | F.col("old_auto_promoted"))) | (~known & (F.col("n") >= min_occurrences)))
    return kept.select(
        *SIG, *[F.coalesce("old_" + c, c).alias(c) for c in _PARTS], (F.coalesce("old_occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"),
        F.coalesce("old_watch_hits", F.lit(0)).alias("watch_hits"), F.coalesce("old_auto_promoted", F.lit(False)).alias("auto_promoted"), F.col("old_promoted_at").alias("promoted_at"), F.coalesce("old_first_seen", "seen").alias("first_seen"),
    )


def apply_watch_hits(baseline: DataFrame, new: DataFrame, as_of, threshold: int = DEFAULTS.promote_runs) -> DataFrame:
    """One hit for each signature of ``new`` (one run's new signatures; unknown ones are inserted with one occurrence); at
    ``threshold`` hits a signature is promoted."""
    seen = new.groupBy(*SIG).agg(*[F.min(c).alias(c) for c in _PARTS])
    old = baseline.select(*SIG, F.struct(*[c for c in baseline.columns if c not in SIG]).alias("o"))
    j = old.join(seen, SIG, "full_outer")
    here = F.col("service").isNotNull()
    hits = F.coalesce("o.watch_hits", F.lit(0)) + here.cast("int")
    was = F.coalesce("o.auto_promoted", F.lit(False))
    promote, ts = here & (hits >= threshold) & ~was, F.lit(as_of).cast("timestamp")
    return j.select(
        *SIG, *[F.coalesce(F.col(f"o.{c}"), F.col(c)).alias(c) for c in _PARTS], F.coalesce("o.occurrences", F.lit(1)).alias("occurrences"), hits.alias("watch_hits"),
        (was | promote).alias("auto_promoted"), F.when(promote, ts).otherwise(F.col("o.promoted_at")).alias("promoted_at"), F.coalesce("o.first_seen", ts).alias("first_seen"),
    )


def classify_errors(counts: DataFrame, baseline: DataFrame, learn_runs: int = 1, thresholds: DataFrame | None = None) -> DataFrame:
    """NEW_ERROR_SIGNATURE or SIGNATURE_SPIKE for counted signatures (``counts(environment, sig_hash, service, n)``)."""
    b = baseline.select(*SIG, "occurrences", "auto_promoted")
    c = counts.join(b, SIG, "left")
    times = F.lit(DEFAULTS.error_spike_times)
    if thresholds is not None:
        c = c.join(thresholds.select("service", "error_spike_multiplier"), "service", "left")
        times = F.coalesce("error_spike_multiplier", times)
    rate = F.col("occurrences") / max(learn_runs, 1)
    kind = F.when(F.col("occurrences").isNull(), "NEW_ERROR_SIGNATURE").when(F.col("auto_promoted"), None).when((F.col("occurrences") >= DEFAULTS.error_spike_min) & (F.col("n") > rate * times), "SIGNATURE_SPIKE")
    return c.withColumn("anomaly_type", kind).where("anomaly_type is not null").select(*SIG, "service", "n", "occurrences", "anomaly_type")


def vanished_signatures(baseline: DataFrame, counts: DataFrame, share: float = DEFAULTS.vanished_share) -> DataFrame:
    """Signatures with at least ``share`` of their service's baseline errors that are absent now; only of services
    seen in the window, or of all if none was."""
    part = F.col("occurrences") / F.sum("occurrences").over(Window.partitionBy("environment", "service"))
    gone = baseline.withColumn("share", part).where(F.col("share") >= share).join(counts.select(*SIG), SIG, "left_anti")
    seen = counts.select("environment", "service").distinct()
    any_seen = seen.select("environment").distinct().withColumn("some", F.lit(True))
    gone = gone.join(any_seen, "environment", "left").join(seen.withColumn("here", F.lit(True)), ["environment", "service"], "left")
    return gone.where("some is null or here").select(*SIG, "service", "occurrences", "share")


def group_new_errors(new_sigs: DataFrame) -> DataFrame:
    """New signatures by service and error type: how many, and their first three operations."""
    ops = F.array_sort(F.collect_set("operation"))
    g = new_sigs.groupBy("environment", "service", "error_type").agg(
        F.countDistinct("sig_hash").alias("signatures"), F.min("sig_hash").alias("representative"), ops.alias("ops"), F.countDistinct("call_path").alias("call_paths")
    )
    more = F.when(F.size("ops") > 3, F.format_string(" (+%d more)", F.size("ops") - 3)).otherwise("")
    return g.select("environment", "service", "error_type", "signatures", "representative", F.concat(F.array_join(F.slice("ops", 1, 3), ", "), more).alias("operations"), "call_paths")
