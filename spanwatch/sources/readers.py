"""Sources: span, event and baseline files as tables. Each takes a DataFrame (batch or stream) of the raw shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwatch import schema
from spanwatch.functions import scalars as S


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    return flatten_otlp(spark.read.schema(schema.OTLP).json(path))


def _attributes(c):
    return F.map_from_entries(F.transform(c, lambda a: F.struct(a["key"], a["value"]["stringValue"])))


def flatten_otlp(batches: DataFrame) -> DataFrame:
    """Resource, scope and span nesting as span rows. Ids of zeros are null; durations in microseconds."""
    r = batches.select(F.explode("resourceSpans").alias("r")).withColumn("attrs", _attributes(F.coalesce("r.resource.attributes", F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>"))))
    s = r.select("attrs", F.explode("r.scopeSpans").alias("sc")).select("attrs", F.explode("sc.spans").alias("s"))
    tags = _attributes(F.coalesce("s.attributes", F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>")))
    us = F.expr("cast(s.startTimeUnixNano as bigint) div 1000")
    env = F.coalesce(F.try_element_at("attrs", F.lit("deployment.environment")), F.lit("all"))
    return s.withColumn("tags", tags).select(
        env.alias("environment"), F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"),
        F.when(~F.coalesce(F.col("s.parentSpanId"), F.lit("")).rlike("^0*$"), F.col("s.parentSpanId")).alias("parent_id"),
        F.coalesce(F.try_element_at("attrs", F.lit("service.name")), F.lit("unknown")).alias("service"), F.col("s.name").alias("operation"), us.alias("start_us"),
        F.expr("(cast(s.endTimeUnixNano as bigint) - cast(s.startTimeUnixNano as bigint)) div 1000").alias("duration_us"), S.is_error(F.col("tags"), "stream", F.coalesce(F.col("s.status.code") == 2, F.lit(False))).alias("is_error"),
        "tags", F.timestamp_micros(us).alias("event_time"),
    )


def flatten_trace_docs(docs: DataFrame, environment: str = "all") -> DataFrame:
    """Trace documents as span rows; they have no parent ids."""
    s = docs.select(F.col("traceID").alias("trace_id"), F.explode("spans").alias("s"))
    tags = F.map_from_entries(F.transform(F.coalesce("s.tags", F.array().cast("array<struct<key:string,value:string>>")), lambda t: F.struct(t["key"], t["value"])))
    return s.withColumn("tags", tags).select(
        F.lit(environment).alias("environment"), "trace_id", F.col("s.spanID").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.col("s.serviceName").alias("service"), F.col("s.operationName").alias("operation"),
        F.col("s.startTime").alias("start_us"), F.col("s.duration").alias("duration_us"), S.is_error(F.col("tags")).alias("is_error"), "tags", F.timestamp_micros("s.startTime").alias("event_time"),
    )


# Tiers of event types.
TIERS = {
    "trace.path.drift": "tier2", "error.signature.drift": "tier3", "error.signature.spike": "tier3", "service.latency.anomaly": "tier2", "service.error.rate.anomaly": "tier2", "db.query.slow": "tier2", "db.query.new_plan": "tier2",
}


def read_events(envelopes: DataFrame, environment: str | None = None) -> DataFrame:
    """Event envelopes as anomaly rows; events without a service or of unknown types are dropped."""
    d, p = F.col("metadata"), F.col("properties")
    get = lambda m, k: S.filled(F.try_element_at(m, F.lit(k)))
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    e = envelopes.select(
        F.coalesce(get(d, "environment"), get(d, "sf_environment")).alias("environment"), S.event_service(d, p).alias("service"), F.try_element_at(tier, F.col("eventType")).alias("tier"), F.col("eventType").alias("event_type"),
        F.coalesce(get(d, "anomaly_type"), F.upper("eventType")).alias("anomaly_type"), F.coalesce(get(d, "fp_hash"), get(d, "sig_hash"), F.lit("")).alias("hash"),
        F.coalesce(get(p, "message"), F.lit("")).alias("message"), F.coalesce(get(p, "services"), F.lit("")).alias("services"), F.col("timestampMs").alias("ts_ms"),
    )
    return e.where(F.col("service").isNotNull() & F.col("tier").isNotNull() & S.env_match(F.col("environment"), environment)).withColumn("environment", F.coalesce("environment", F.lit("all")))


def read_deployments(envelopes: DataFrame, environment: str | None = None) -> DataFrame:
    get = lambda k: S.filled(F.coalesce(F.try_element_at("metadata", F.lit(k)), F.try_element_at("properties", F.lit(k))))
    d = envelopes.where("eventType = 'deployment.started' or eventType like 'deployment%'").select(
        F.coalesce(get("environment"), F.lit("all")).alias("environment"), get("service").alias("service"), *[F.coalesce(get(k), F.lit("")).alias(k) for k in ("version", "commit", "deployer", "description")], F.col("timestampMs").alias("ts_ms")
    )
    return d.where(F.col("service").isNotNull() & S.env_match(F.col("environment"), environment))


def parse_log_events(lines: DataFrame) -> DataFrame:
    """Log lines with quoted fields as anomaly rows: kind by the fields that are there; hash from the line if none is given."""
    line = F.col("value")
    get = lambda k: S.filled(F.regexp_extract(line, rf'"{k}":\s*"([^"]*)"', 1))
    kinds = (
        ("LATENCY_ANOMALY", line.contains("latency")), ("ERROR_RATE", line.contains("error rate")), ("SLOW_QUERY", line.contains("slow query")), ("NEW_QUERY", line.contains("new query")),
        ("MISSING_SERVICE", get("missing_services").isNotNull()), ("NEW_ERROR_SIGNATURE", get("sig_hash").isNotNull()),
    )
    kind = F.lit("NEW_FINGERPRINT")
    for name, test in reversed(kinds):
        kind = F.when(F.coalesce(test, F.lit(False)), name).otherwise(kind)
    listed = F.trim(F.substring_index(get("missing_services"), ",", -1))
    service = F.coalesce(listed, get("service"), S.service_of(get("root_op")))
    own = S.short_hash(F.concat_ws(":", kind, service, get("operation")))
    e = lines.where(line.contains('"')).select(kind.alias("anomaly_type"), service.alias("service"), F.coalesce(get("fp_hash"), get("sig_hash"), own).alias("hash"), F.coalesce(get("environment"), F.lit("all")).alias("environment"), F.coalesce(get("message"), F.lit("")).alias("message"))
    return e.where("service is not null and service <> ''")


# Reasons of cluster warnings that are kept.
INFRA_REASONS = ("BackOff", "CrashLoopBackOff", "OOMKilling", "Unhealthy", "FailedScheduling", "Evicted", "NodeNotReady", "Killing")


def read_infra_events(events: DataFrame, as_of_ms: int, max_age_s: int = 300, infra: tuple[str, ...] = ()) -> DataFrame:
    """Recent cluster warnings (``reason, pod, ts_ms``) by service."""
    e = events.where(F.col("reason").isin(*INFRA_REASONS) & (F.col("ts_ms") >= as_of_ms - max_age_s * 1000)).withColumn("service", S.pod_to_service(F.col("pod")))
    return e.where(~F.col("service").isin(*infra)) if infra else e


def node_utilisation(metrics: DataFrame) -> DataFrame:
    """Mean cpu and memory of nodes in percent; memory falls back to usage over limit. ``metrics(node, metric, value)``."""
    mean = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
    g = metrics.groupBy("node").agg(mean("cpu").alias("c"), mean("memory").alias("m"), mean("memory_usage").alias("u"), mean("memory_limit").alias("l"))
    return g.select("node", F.round(F.col("c") * 100, 1).alias("cpu"), F.round(F.coalesce(F.col("m"), F.col("u") / F.nullif("l", F.lit(0.0))) * 100, 1).alias("memory"))


def host_verdict(utilisation: DataFrame) -> DataFrame:
    hot = (F.col("cpu") >= 90) | (F.col("memory") >= 95)
    warm = (F.col("cpu") >= 70) | (F.col("memory") >= 85)
    none = F.col("cpu").isNull() & F.col("memory").isNull()
    return utilisation.select("*", F.when(none, "no_data").when(hot, "critical").when(warm, "elevated").otherwise("ok").alias("pressure"), F.when(none, "no_data").when(hot | warm, "host_issue").otherwise("host_ok").alias("verdict"))


def service_infra(pods: DataFrame, metrics: DataFrame) -> DataFrame:
    """Worst node utilisation of each service. ``pods(pod, node)``."""
    p = pods.select(S.pod_to_service(F.col("pod")).alias("service"), "node").distinct()
    return p.join(node_utilisation(metrics), "node", "left").groupBy("service").agg(F.count("*").alias("nodes"), F.max("cpu").alias("cpu"), F.max("memory").alias("memory"))


TRACE_ENTRY = (
    "map<string, struct<hash: string, path: string, root_op: string, services: array<string>, span_count: int, span_count_min: int, span_count_max: int, edge_count: int, occurrences: bigint, watch_hits: int, "
    "auto_promoted: boolean, promoted_at: string, no_missing_service: boolean, first_seen: string, last_seen: string>>"
)
ERROR_ENTRY = (
    "map<string, struct<hash: string, service: string, error_type: string, http_status: string, db_system: string, operation: string, call_path: string, occurrences: bigint, watch_hits: int, "
    "auto_promoted: boolean, promoted_at: string, first_seen: string>>"
)


def parse_baseline_json(texts: DataFrame, kind: str, environment: str) -> DataFrame:
    """Baseline files (column ``value``: a whole file) as entries; a missing hash is the key, and a path loses a leading ``Path: ``."""
    field, entry, key = ("fingerprints", TRACE_ENTRY, "fp_hash") if kind == "trace" else ("signatures", ERROR_ENTRY, "sig_hash")
    e = texts.select(F.from_json("value", f"struct<{field}: {entry}>").alias("j")).select(F.explode(F.col(f"j.{field}")).alias("k", "v")).select("k", "v.*")
    e = e.withColumn(key, F.coalesce(S.filled(F.col("hash")), "k")).withColumn("environment", F.lit(environment)).drop("hash", "k")
    return e.withColumn("path", F.regexp_replace("path", "^Path: ", "")) if kind == "trace" else e


def read_baseline_json(spark: SparkSession, path: str, kind: str, environment: str) -> DataFrame:
    return parse_baseline_json(spark.read.text(path, wholetext=True), kind, environment)
