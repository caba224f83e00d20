"""Queries of sources and sinks: tables that Spark brings into a foreign shape and reads again."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwatch.operators.classify import decide, drop_partial
from spanwatch.plans.base import spans, sql
from spanwatch.plans.registry import query
from spanwatch.plans.stream_queries import _folder
from spanwatch.plans.structure_queries import _DECIDE, _P10, base, live
from spanwatch.sources import fixtures as X
from spanwatch.sources import readers as R
from spanwatch.sources import sinks as K

_SPAN_ROWS = sql("select trace_id, span_id, service, operation, start_us, duration_us, is_error as is_error from spans")
_SPAN_COLUMNS = ["trace_id", "span_id", "service", "operation", "start_us", "duration_us", "is_error"]


def _attrs(m):
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


@query(_SPAN_ROWS)
def src_otlp_spans(spark, d):
    nano = lambda c: (c * 1000).cast("string")
    s = spans(spark, d).select(
        "service", F.struct(
            F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.lit("0000000000000000").alias("parentSpanId"), F.col("operation").alias("name"), nano(F.col("start_us")).alias("startTimeUnixNano"),
            nano(F.col("start_us") + F.col("duration_us")).alias("endTimeUnixNano"), F.struct(F.when(F.col("is_error"), 2).otherwise(0).alias("code")).alias("status"), _attrs(F.col("tags")).alias("attributes"),
        ).alias("s"), "trace_id",
    )
    g = s.groupBy("service", "trace_id").agg(F.collect_list("s").alias("spans"))
    batches = g.select(F.array(F.struct(F.struct(_attrs(F.create_map(F.lit("service.name"), "service")).alias("attributes")).alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))
    folder = _folder(spark)
    batches.write.json(folder)
    return R.read_otlp(spark, folder).select(*_SPAN_COLUMNS)


@query(_SPAN_ROWS)
def src_trace_docs(spark, d):
    tags = F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    one = F.struct(F.col("span_id").alias("spanID"), F.col("operation").alias("operationName"), F.col("service").alias("serviceName"), F.col("start_us").alias("startTime"), F.col("duration_us").alias("duration"), tags.alias("tags"))
    docs = spans(spark, d).groupBy(F.col("trace_id").alias("traceID")).agg(F.collect_list(one).alias("spans"))
    return R.flatten_trace_docs(docs).select(*_SPAN_COLUMNS)


def _envelopes(spark, d):
    return K.to_event_envelope(X.anomaly_events(spark, d))


@query(sql("select environment, service, anomaly_type, hash, message, ts_ms from (select *, anomaly_type || ' on ' || service as message from anomalies)"))
def src_events(spark, d):
    return R.read_events(_envelopes(spark, d)).select("environment", "service", "anomaly_type", "hash", "message", "ts_ms")


_TYPE = "case when anomaly_type = 'NEW_ERROR_SIGNATURE' then 'error.signature.drift' when anomaly_type = 'SIGNATURE_SPIKE' then 'error.signature.spike' when anomaly_type = 'LATENCY_ANOMALY' then 'service.latency.anomaly' else 'trace.path.drift' end"


@query(sql(f"select {_TYPE} as event_type, ts_ms, service, hash, anomaly_type || ' on ' || service as message from anomalies"))
def sink_events(spark, d):
    e = _envelopes(spark, d)
    return e.select(F.col("eventType").alias("event_type"), F.col("timestampMs").alias("ts_ms"), F.col("metadata")["service"].alias("service"), F.col("metadata")["fp_hash"].alias("hash"), F.col("properties")["message"].alias("message"))


@query(sql("select environment, service, version, ts_ms from deploys"))
def src_deployments(spark, d):
    x = X.deployments(spark, d)
    e = x.select(F.lit("deployment.started").alias("eventType"), F.lit("USER").alias("category"), F.create_map(F.lit("service"), "service", F.lit("environment"), "environment", F.lit("version"), "version").alias("metadata"), F.expr("cast(map() as map<string,string>)").alias("properties"), F.col("ts_ms").alias("timestampMs"))
    return R.read_deployments(e).select("environment", "service", "version", "ts_ms")


@query(sql("""select case when k % 4 = 0 then 'MISSING_SERVICE' when k % 4 = 1 then 'NEW_ERROR_SIGNATURE' when k % 4 = 2 then 'LATENCY_ANOMALY' else 'NEW_FINGERPRINT' end as anomaly_type,
    case when k % 4 = 0 then 'svc' || k else 'svc' || (user_id % 50) end as service, environment, case when k % 4 = 1 then 's' || k else 'f' || event_id end as hash from anomalies"""))
def src_log_events(spark, d):
    e = X._events(spark, d).where("event_type <> 'signup'")
    k, svc = F.col("k"), F.concat(F.lit("svc"), F.col("user_id") % 50)
    env = F.when(F.col("user_id") % 3 == 0, "dev").when(F.col("user_id") % 3 == 1, "staging").otherwise("prod")
    pair = lambda n, v: F.concat(F.lit(f', "{n}": "'), v, F.lit('"'))
    extra = F.when(k % 4 == 0, pair("missing_services", F.concat(F.lit("a, svc"), k))).when(k % 4 == 1, pair("sig_hash", F.concat(F.lit("s"), k))).otherwise("")
    own = F.when(k % 4 == 1, "").otherwise(pair("fp_hash", F.concat(F.lit("f"), F.col("event_id"))))
    lines = e.select(F.concat(F.when(k % 4 == 2, "latency anomaly").otherwise("drift"), pair("service", svc), pair("environment", env), extra, own).alias("value"))
    return R.parse_log_events(lines).select("anomaly_type", "service", "environment", "hash")


def _metrics(spark, d):
    e = X._events(spark, d)
    return e.select(F.concat(F.lit("node"), F.col("user_id") % 7).alias("node"), F.when(F.col("k") % 2 == 0, "cpu").otherwise("memory").alias("metric"), (F.col("k") / 100.0).alias("value"))


_UTIL = "select 'node' || (user_id % 7) as node, round(avg(k / 100.0) filter (where k % 2 = 0) * 100, 1) as cpu, round(avg(k / 100.0) filter (where k % 2 = 1) * 100, 1) as memory from ev group by 1"


@query(sql(_UTIL))
def src_node_metrics(spark, d):
    return R.node_utilisation(_metrics(spark, d))


@query(sql("""select *, case when cpu is null and memory is null then 'no_data' when cpu >= 90 or memory >= 95 then 'critical' when cpu >= 70 or memory >= 85 then 'elevated' else 'ok' end as pressure,
    case when cpu is null and memory is null then 'no_data' when cpu >= 70 or memory >= 85 then 'host_issue' else 'host_ok' end as verdict from
    (select 'node' || n as node, round(avg(k / 100.0 * (1 + n / 36.0)) filter (where k % 2 = 0 and n % 12 <> 5) * 100, 1) as cpu, round(avg(k / 100.0 * (1 + (n * 7) % 37 / 36.0)) filter (where k % 2 = 1 and n % 6 <> 5) * 100, 1) as memory
     from (select *, user_id % 37 as n from ev) group by 1)"""))
def d_host_pressure(spark, d):
    """Nodes from idle to full; some tell no memory, some nothing."""
    n = F.col("user_id") % 37
    e = X._events(spark, d).withColumn("n", n).withColumn("is_cpu", F.col("k") % 2 == 0)
    kind = F.when(F.col("is_cpu") & (F.col("n") % 12 != 5), "cpu").when(~F.col("is_cpu") & (F.col("n") % 6 != 5), "memory").otherwise("disk")
    load = F.when(F.col("is_cpu"), 1 + F.col("n") / 36.0).otherwise(1 + (F.col("n") * 7) % 37 / 36.0)
    return R.host_verdict(R.node_utilisation(e.select(F.concat(F.lit("node"), "n").alias("node"), kind.alias("metric"), (F.col("k") / 100.0 * load).alias("value"))))


@query(sql(f"select service, count(*) as nodes, max(cpu) as cpu, max(memory) as memory from (select distinct event_type as service, 'node' || (user_id % 7) as node from events) left join ({_UTIL}) using (node) group by 1"))
def j_service_nodes(spark, d):
    pods = X._events(spark, d).select(F.concat_ws("-", "event_type", F.col("k").cast("string"), F.col("event_id").cast("string")).alias("pod"), F.concat(F.lit("node"), F.col("user_id") % 7).alias("node"))
    return R.service_infra(pods, _metrics(spark, d))


@query(sql("select event_id, event_type as service from ev where k % 3 = 0 and ts >= timestamp '2024-01-20'"))
def src_infra_events(spark, d):
    e = X._events(spark, d).select("event_id", F.when(F.col("k") % 3 == 0, "BackOff").otherwise("Pulled").alias("reason"), F.concat_ws("-", "event_type", "k", "event_id").alias("pod"), F.unix_millis("ts").alias("ts_ms"))
    return R.read_infra_events(e, 1705708800000 + 300_000).select("event_id", "service")


@query(sql("select environment, fp_hash, root_op, occurrences, epoch_us(timestamp '2024-02-10') as created_us, epoch_us(timestamp '2024-02-11') as updated_us from base"))
def sink_baseline(spark, d):
    folder = _folder(spark)
    K.write_baseline(base(spark, d).where("occurrences < 10"), folder, "2024-02-10")
    now = K.write_baseline(base(spark, d), folder, "2024-02-11")
    stamp = K.baseline_versions(spark, folder).where(F.col("version") == now).select(F.lit(1).alias("one"), F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))
    current = K.read_baseline(spark, folder).select("environment", "fp_hash", "root_op", "occurrences", F.lit(1).alias("one"))
    return current.join(stamp, "one").drop("one")


@query(sql("select environment, fp_hash, root_op, path, occurrences from base"))
def src_baseline_json(spark, d):
    files = K.export_baseline_json(base(spark, d).withColumn("path", F.concat(F.lit("Path: "), "path")))
    out = None
    for env in ("dev", "staging", "prod"):
        one = R.parse_baseline_json(files.where(F.col("environment") == env).select(F.col("json").alias("value")), "trace", env)
        out = one if out is None else out.unionByName(one)
    return out.select("environment", "fp_hash", "root_op", "path", "occurrences")


@query(sql("select environment, count(*) as entries, sum(occurrences)::bigint as total from base group by 1"))
def sink_baseline_json(spark, d):
    j = K.export_baseline_json(base(spark, d))
    e = j.select("environment", F.explode(F.from_json("json", f"struct<fingerprints: {R.TRACE_ENTRY}>")["fingerprints"]).alias("k", "v"))
    return e.groupBy("environment").agg(F.count("*").alias("entries"), F.sum("v.occurrences").alias("total"))


_COUNT = " ".join(f", count(*) filter (where kind = '{k}') as {k}" for k in ("traces", "known", *K.COUNTED.values(), "promotions", "partial"))


@query(sql(f"""select * from (with {_DECIDE}, p10 as ({_P10}), rw as (select environment, trace_start as ts, 'traces' as kind from vd union all select environment, trace_start, 'known' from vd where verdict is null
    union all select environment, trace_start, case verdict when 'NEW_FINGERPRINT' then 'drift' when 'MISSING_SERVICE' then 'missing' end from vd where verdict is not null
    union all select environment, make_timestamp(ts_ms * 1000), case anomaly_type when 'NEW_ERROR_SIGNATURE' then 'error' when 'LATENCY_ANOMALY' then 'latency' end from anomalies where anomaly_type in ('NEW_ERROR_SIGNATURE', 'LATENCY_ANOMALY', 'SIGNATURE_SPIKE')
    union all select environment, first_seen, 'promotions' from base
    union all select w.environment, w.trace_start, 'partial' from watch w left join p10 p using (environment, root_op) where not exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash) and w.span_count < coalesce(p.p10, 0))
    select environment, epoch_us(ts) // 86400000000 * 86400 as start_s {_COUNT} from rw group by 1, 2)"""))
def sink_run_counters(spark, d):
    w, b = live(spark, d)
    t = decide(w, b).select("environment", F.col("trace_start").alias("ts"), F.col("verdict").isNull().alias("known"), F.col("verdict").alias("anomaly_type"))
    others = X.anomaly_events(spark, d).where("anomaly_type in ('NEW_ERROR_SIGNATURE', 'LATENCY_ANOMALY', 'SIGNATURE_SPIKE')").select("environment", F.timestamp_millis("ts_ms").alias("ts"), "anomaly_type")
    kept = drop_partial(w, b).select("environment", "trace_id")
    partial = w.join(kept, ["environment", "trace_id"], "left_anti").select("environment", F.col("trace_start").alias("ts"))
    happened = t.where("anomaly_type is not null").select("environment", "ts", "anomaly_type").unionByName(others)
    return K.run_counters(t, happened, b.select("environment", F.col("first_seen").alias("ts")), partial, 86_400)
