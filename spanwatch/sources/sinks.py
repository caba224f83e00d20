"""Sinks: baseline versions, JSON export, event envelopes and run counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwatch.functions import scalars as S


_POINTER = "version string, number bigint, created_at timestamp, updated_at timestamp"


class BaselineConflict(Exception):
    """Another writer made a version with the same number, and that one is current."""


def write_baseline(df: DataFrame, root: str, as_of=None) -> str:
    """Write a new version under ``root`` and make it current. A version is written whole before the pointer names it, and a
    version that is being read is never touched. Versions are numbered on, not ordered by clocks; created_at stays that of the first,
    updated_at is ``as_of`` (now without it). Of writers that take the same number at once the one with the largest name is current; the
    others get :class:`BaselineConflict`, since what they wrote does not know the current one (see :func:`update_baseline`)."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.partitionBy("environment").parquet(f"{root}/version={version}")
    last = baseline_versions(spark, root).agg(F.max("number").alias("number"), F.min("created_at").alias("created_at"))
    at = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    entry = last.select(F.lit(version).alias("version"), (F.coalesce("number", F.lit(0)) + 1).alias("number"), F.coalesce("created_at", at).alias("created_at"), at.alias("updated_at"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    told = baseline_versions(spark, root)
    own = told.where(F.col("version") == version).select("number")
    rival = told.join(own, "number").agg(F.max("version")).first()[0]
    if rival != version:
        raise BaselineConflict(f"version {rival} was written at the same time as {version}")
    return version


def update_baseline(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], tries: int = 5, as_of=None) -> str:
    """Read the current version, write ``change`` of it, and do so again from the then current one where another writer came first."""
    for left in range(tries - 1, -1, -1):
        try:
            return write_baseline(change(read_baseline(spark, root)), root, as_of)
        except BaselineConflict:
            if not left:
                raise


def baseline_versions(spark: SparkSession, root: str) -> DataFrame:
    """version, number, created_at, updated_at of all versions under ``root`` (none before the first)."""
    try:
        return spark.read.schema(_POINTER).parquet(f"{root}/pointer")
    except AnalysisException:  # no pointer yet
        return spark.createDataFrame([], _POINTER)


def read_baseline(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    if version is None:
        version = baseline_versions(spark, root).orderBy(F.desc("number"), F.desc("version")).first()["version"]
    return spark.read.parquet(f"{root}/version={version}")


def export_baseline_json(baseline: DataFrame, kind: str = "trace") -> DataFrame:
    """One JSON text per environment: hash -> entry. An export file holds a whole baseline by its nature."""
    field, key = ("fingerprints", "fp_hash") if kind == "trace" else ("signatures", "sig_hash")
    rest = [F.col(c) for c in baseline.columns if c not in ("environment", key)]
    entry = F.struct(F.col(key), F.struct(F.col(key).alias("hash"), *rest))
    g = baseline.groupBy("environment").agg(F.map_from_entries(F.collect_list(entry)).alias(field))
    return g.select("environment", F.to_json(F.struct(field)).alias("json"))


# Event types of anomaly types.
EVENT_TYPES = {
    "NEW_FINGERPRINT": "trace.path.drift", "MISSING_SERVICE": "trace.path.drift", "NEW_SERVICE": "trace.path.drift", "SPAN_COUNT_SPIKE": "trace.path.drift", "SPAN_COUNT_DROP": "trace.path.drift",
    "NEW_ERROR_SIGNATURE": "error.signature.drift", "SIGNATURE_SPIKE": "error.signature.spike", "SIGNATURE_VANISHED": "error.signature.drift", "LATENCY_ANOMALY": "service.latency.anomaly",
    "ERROR_RATE": "service.error.rate.anomaly", "SLOW_QUERY": "db.query.slow", "NEW_QUERY": "db.query.new_plan",
}


def to_event_envelope(anomalies: DataFrame) -> DataFrame:
    """Envelopes of anomaly rows (environment, service, anomaly_type, hash, message, ts_ms; rolling, z, rate where they are there)."""
    has = set(anomalies.columns)
    kind = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    dims = F.create_map(
        F.lit("anomaly_type"), F.col("anomaly_type"), F.lit("service"), F.col("service"), F.lit("environment"), F.col("environment"), F.lit("sf_environment"), F.col("environment"), F.lit("fp_hash"), F.coalesce("hash", F.lit(""))
    )
    shown = [("message", S.truncate(F.coalesce("message", F.lit("")))), ("services", F.coalesce("services", F.lit("")) if "services" in has else F.lit(""))]
    numbers = (("rolling", S.fmt_ms(F.col("rolling")) if "rolling" in has else None), ("z", F.format_string("%.2f", "z") if "z" in has else None), ("rate", F.format_string("%.3f", "rate") if "rate" in has else None))
    shown += [(n, F.coalesce(c, F.lit(""))) for n, c in numbers if c is not None]
    props = F.create_map(*[x for n, c in shown for x in (F.lit(n), c)])
    return anomalies.select(F.coalesce(F.try_element_at(kind, F.col("anomaly_type")), F.lit("trace.path.drift")).alias("eventType"), F.lit("USER_DEFINED").alias("category"), dims.alias("metadata"), props.alias("properties"), F.col("ts_ms").alias("timestampMs"))


# Counters of anomaly types.
COUNTED = {
    "NEW_FINGERPRINT": "drift", "NEW_ERROR_SIGNATURE": "error", "MISSING_SERVICE": "missing", "LATENCY_ANOMALY": "latency", "ERROR_RATE": "error_rate", "THROUGHPUT_DROP": "throughput", "TOPOLOGY": "topology",
}


def run_counters(traces: DataFrame, events: DataFrame, promotions: DataFrame, partial: DataFrame, interval_s: int = 60) -> DataFrame:
    """Counters per environment and interval: traces and known ones (``traces(environment, ts, known)``), events by type
    (``events(environment, ts, anomaly_type)``), promotions and partial traces that were skipped (``(environment, ts)`` each)."""
    row = lambda df, kind: df.select("environment", "ts", kind.alias("kind"))
    kinds = F.create_map(*[F.lit(x) for kv in COUNTED.items() for x in kv])
    every = row(traces, F.lit("traces")).unionByName(row(traces.where("known"), F.lit("known"))).unionByName(row(events, F.try_element_at(kinds, F.col("anomaly_type"))))
    every = every.unionByName(row(promotions, F.lit("promotions"))).unionByName(row(partial, F.lit("partial")))
    start = F.floor(F.unix_micros("ts") / F.lit(interval_s * 1_000_000)) * interval_s
    n = lambda name: F.count(F.when(F.col("kind") == name, 1)).alias(name)
    return every.groupBy("environment", start.alias("start_s")).agg(*[n(c) for c in ("traces", "known", *COUNTED.values(), "promotions", "partial")])
