"""Queries that run as streams over the given tables until all is read; results go to files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwatch.operators.baseline import learn_trace
from spanwatch.plans.base import learn_window, shared_path, spike_sql, sql, stored
from spanwatch.plans.registry import query
from spanwatch.plans.structure_queries import _STREAM, fps, fps_once, live
from spanwatch.sources import fixtures as X
from spanwatch.streaming import streams as St

def _folder(spark: SparkSession) -> str:
    return shared_path(spark, "stream")


def drained(
    build: Callable[[DataFrame], DataFrame], table: DataFrame, time: str | None = None, slices: int = 5, stop: int = 3, ended: Callable | None = None
) -> DataFrame:
    """What the stream ``build(source)`` writes until all of ``table`` is read.

    With a ``time`` the table comes in that order in ``slices`` micro-batches; the query stops after ``stop`` of them and is started
    again from its checkpoint, so state outlives both. ``ended(query)`` is called each time it stops."""
    spark, folder = table.sparkSession, _folder(table.sparkSession)
    source = table if time is None else stored(table, "slices")
    schema, n = None, 1
    parts = [source]
    if time is not None:
        at = F.unix_micros(time) if dict(table.dtypes)[time] == "timestamp" else F.col(time)
        low, high, rows = source.agg(F.min(at), F.max(at), F.count("*")).first()
        n = 1 + rows // (slices * 1_000_000)
        place = F.floor((at - (low or 0)) * slices / ((high or 0) - (low or 0) + 1))
        parts = [source.where(place == k) for k in range(slices)]
    for number, part in enumerate(parts):
        (part if time is None else part.repartition(n)).write.mode("append").parquet(f"{folder}/in")
        if number + 1 not in (stop, len(parts)):
            continue
        reader = spark.readStream.schema(table.schema)
        stream = build((reader if time is None else reader.option("maxFilesPerTrigger", n)).parquet(f"{folder}/in"))
        schema = stream.schema
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
        running = q.trigger(availableNow=True).start()
        running.awaitTermination()
        if ended:
            ended(running)
    return spark.read.schema(schema).parquet(f"{folder}/out")


def as_stream(df: DataFrame) -> DataFrame:
    """A table as a stream: written once to files and read as one."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def _events(spark, d):
    return X.anomaly_events(spark, d).withColumn("event_time", F.timestamp_millis("ts_ms"))


_MARK = "(select max(ts_ms) from anomalies)"


@query(sql(f"select start_ms, service, n from (select ts_ms // 600000 * 600000 as start_ms, service, count(*) as n from anomalies group by 1, 2) where start_ms + 600000 <= {_MARK} - 600000"))
def st_tumbling_rates(spark, d):
    t = drained(lambda s: St.tumbling_rates(s, "10 minutes", "10 minutes"), _events(spark, d), "ts_ms")
    return t.select(F.unix_millis("start").alias("start_ms"), "service", "n")


@query(sql(f"""with s as (select *, sum(new) over (partition by environment, service order by ts_ms, event_id) as g from (select *, case when ts_ms - lag(ts_ms) over (partition by environment, service order by ts_ms, event_id) < 7200000 then 0 else 1 end as new from anomalies))
    select environment, service, opened_ms, n from (select environment, service, min(ts_ms) as opened_ms, max(ts_ms) + 7200000 as closed, count(*) as n from s group by environment, service, g) where closed <= {_MARK} - 900000"""))
def st_session_incidents(spark, d):
    t = drained(lambda s: St.session_incidents(s, "2 hours", "15 minutes"), _events(spark, d), "ts_ms")
    return t.select("environment", "service", F.unix_millis("opened").alias("opened_ms"), "n")


@query(sql(f"""select environment, service, operation, start_us, n, round(mean_us, 3) as mean_us from (select environment, service, operation, w as start_us, count(*) as n, avg(duration_us) as mean_us from (select *, unnest([start_us // 43200000000 * 43200000000, start_us // 43200000000 * 43200000000 - 43200000000]) as w from spans) group by 1, 2, 3, 4)
    where start_us + 86400000000 <= (select max(start_us) from spans) // 1000 * 1000 - 60000000"""))
def st_sliding_latency(spark, d):
    t = drained(lambda s: St.sliding_latency(s, "24 hours", "12 hours"), X.event_spans(spark, d), "event_time")
    return t.select("environment", "service", "operation", F.unix_micros("start").alias("start_us"), "n", F.round("mean_us", 3).alias("mean_us"))


@query(sql("""select anomaly_type, hash, ts_ms, event_id from (with recursive r(anomaly_type, hash, ts_ms, event_id, rn) as (select anomaly_type, hash, ts_ms, event_id, rn from o where rn = 1
    union all select n.anomaly_type, n.hash, n.ts_ms, n.event_id, n.rn from r cross join lateral (select * from o where o.anomaly_type = r.anomaly_type and o.hash = r.hash and o.rn > r.rn and o.ts_ms - r.ts_ms >= 21600000 order by o.rn limit 1) n) select * from r)""",
    o="select anomaly_type, hash, ts_ms, event_id, row_number() over (partition by anomaly_type, hash order by ts_ms, event_id) as rn from anomalies"))
def st_event_dedup(spark, d):
    return drained(lambda s: St.dedup_events(s, 21_600_000), _events(spark, d), "ts_ms")


@query(sql("""select key, ts_ms, event_id from (with recursive r(key, ts_ms, event_id, rn) as (select key, ts_ms, event_id, rn from o where rn = 1
    union all select n.key, n.ts_ms, n.event_id, n.rn from r cross join lateral (select * from o where o.key = r.key and o.rn > r.rn and o.ts_ms - r.ts_ms >= 21600000 order by o.rn limit 1) n) select * from r)""",
    o="select key, ts_ms, event_id, row_number() over (partition by key order by ts_ms, event_id) as rn from (select *, case when k % 2 = 0 then hash else anomaly_type || ':' || service || ':' || root_op end as key from anomalies)"))
def st_alert_dedup(spark, d):
    """Alerts with odd hashes have none: they are told apart by type, service and operation."""
    e = X.anomaly_events(spark, d).withColumn("hash", F.when(F.col("hash").cast("int") % 2 == 0, F.col("hash")).otherwise("")).withColumn("event_time", F.timestamp_millis("ts_ms"))
    return drained(lambda s: St.dedup_alerts(s, 21_600_000), e, "ts_ms")


@query(sql("""select 'event' as kind, event_id::varchar as name, ts_ms from anomalies where ts_ms >= epoch_ms(timestamp '2024-01-02') union all
    select 'promotion', environment || ' ' || fp_hash, epoch_us(t) // 1000 from (select environment, fp_hash, trace_start as t, row_number() over (partition by environment, fp_hash order by trace_start) as n, min(trace_start) over (partition by environment, fp_hash) as t0 from fps)
    where case when t0 < timestamp '2024-01-02' then n = 1 else n = 10 end"""))
def st_warmup(spark, d):
    """During the first day no event goes out and hashes are promoted at first sight."""
    e = drained(lambda s: St.after_warmup(s, "2024-01-01", 86_400), _events(spark, d)).select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("name"), "ts_ms")
    f = fps(spark, d).select("environment", "fp_hash", F.unix_millis("trace_start").alias("ts_ms"))
    p = drained(lambda s: St.promotion_counts(s, 10, 1704153600000), f, "ts_ms")
    return e.unionByName(p.select(F.lit("promotion").alias("kind"), F.concat_ws(" ", "environment", "fp_hash").alias("name"), "ts_ms"))


@query(sql("select environment, fp_hash, epoch_us(t) // 1000 as ts_ms from (select environment, fp_hash, trace_start as t, row_number() over (partition by environment, fp_hash order by trace_start) as n from fps) where n = 10"))
def st_promotion_counts(spark, d):
    f = fps(spark, d).select("environment", "fp_hash", F.unix_millis("trace_start").alias("ts_ms"))
    return drained(lambda s: St.promotion_counts(s, 10), f, "ts_ms").select("environment", "fp_hash", "ts_ms")


@query()
def st_throughput(spark, d):
    """Traces as they come; the stream counts their rates itself."""
    f = fps(spark, d).select("environment", "root_op", F.unix_millis("trace_start").alias("ts_ms"))
    return drained(lambda s: St.throughput_drops(s, 86_400_000, drop=0.8, rearm=0.9), f, "ts_ms")


@query(sql("""select environment, root_op, ts_ms as last_ms from (select *, lead(ts_ms) over (partition by environment, root_op order by ts_ms) as nxt from (select environment, root_op, epoch_us(trace_start) // 1000 as ts_ms from fps))
    where nxt - ts_ms > 10800000 or (nxt is null and ts_ms + 10800000 <= (select max(epoch_us(trace_start)) // 1000 from fps) - 600000)"""))
def st_missing_timer(spark, d):
    """Silences between traces, and those at the end that the watermark has passed."""
    f = fps(spark, d).select("environment", "root_op", F.unix_millis("trace_start").alias("ts_ms"), F.col("trace_start").alias("event_time"))
    return drained(lambda s: St.silence_timer(s, 3 * 3_600_000), f, "ts_ms")


@query(spike_sql("sigs", "172800000000", 4, 2))
def st_error_spike(spark, d):
    from spanwatch.plans.structure_queries import sigs

    s = sigs(spark, d).select("environment", "sig_hash", F.unix_micros("event_time").alias("ts_us"))
    t = drained(lambda x: St.error_spikes(x, 2 * 86_400_000_000, times_base=2.0, least=4), s, "ts_us")
    return t.select("environment", "sig_hash", "ts_us", F.round("per_min", 9).alias("per_min"), F.round("base", 9).alias("base_rate"))


@query(sql("""select key, ts_ms, round(value, 3) as value, round(mean, 3) as mean, round(std, 3) as std from (select *, avg(value) filter (where n <= 30) over (partition by key) as mean, stddev_pop(value) filter (where n <= 30) over (partition by key) as std
    from (select *, row_number() over (partition by key order by ts_ms) as n from (select environment || ':' || service as key, start_us // 1000 as ts_ms, duration_us::double as value from spans))) where n > 30"""))
def st_learn_state(spark, d):
    s = X.event_spans(spark, d).select(F.concat_ws(":", "environment", "service").alias("key"), F.floor(F.col("start_us") / 1000).alias("ts_ms"), F.col("duration_us").cast("double").alias("value"))
    t = drained(lambda x: St.learn_state(x, 30), s, "ts_ms")
    return t.select("key", "ts_ms", *[F.round(c, 3).alias(c) for c in ("value", "mean", "std")])


@query(sql("select environment, fp_hash, ts_ms, case when drifting then 'drift' else 'restored' end as change from (select *, lag(drifting) over (partition by environment, fp_hash order by ts_ms) as before from (select environment, fp_hash, epoch_us(trace_start) // 1000 as ts_ms, span_count > 3 and hour(trace_start) < 12 as drifting from fps)) where drifting <> coalesce(before, false)"))
def st_active_drifts(spark, d):
    """Traces of one millisecond, whose order the SQL leaves open, follow each other by their microseconds, then by their ids."""
    drifting = (F.col("span_count") > 3) & (F.hour("trace_start") < 12)
    f = fps(spark, d).select("environment", "fp_hash", F.unix_millis("trace_start").alias("ts_ms"), drifting.alias("drifting"), "trace_start", "trace_id")
    return drained(lambda s: St.active_drifts(s, ("ts_ms", "trace_start", "trace_id")), f, "ts_ms")


@query(sql("""with c as (select *, service || ':' || operation as frame from chat where trace_id <> (select cast(max(conv_id) as varchar) from conversations)),
    e as (select trace_id, string_agg(edge, ' -> ' order by start_us) as path from (select c.trace_id, min(c.start_us) as start_us, p.frame || ' -> ' || c.frame as edge from c join c p on p.span_id = c.parent_id and p.trace_id = c.trace_id where p.service <> c.service group by c.trace_id, edge) group by 1)
    select 'trace' as kind, trace_id, substr(sha256(coalesce(e.path, t.root)), 1, 16) as hash from (select trace_id, arg_min(frame, start_us) as root from c group by 1 having count(*) >= 2) t left join e using (trace_id)
    union all select 'error', c.trace_id, substr(sha256(c.service || '|error||' || c.operation || '|' || concat_ws(' -> ', p3.frame, p2.frame, p1.frame)), 1, 16) from c left join c p1 on p1.trace_id = c.trace_id and p1.span_id = c.parent_id
      left join c p2 on p2.trace_id = c.trace_id and p2.span_id = p1.parent_id left join c p3 on p3.trace_id = c.trace_id and p3.span_id = p2.parent_id where c.service = 'assistant'"""))
def st_fingerprint(spark, d):
    """Fingerprints and error signatures (answers count as errors) of the conversations that the buffer releases: they follow
    each other by 100 seconds, so all but the last are released after 90."""
    at = F.timestamp_micros(86_400_000_000 + F.col("trace_id").cast("bigint") * 100_000_000 + F.col("start_us"))
    s = X.chat_spans(spark, d).withColumn("is_error", F.col("service") == "assistant").withColumn("event_time", at)
    released = drained(lambda x: St.buffer_traces(x, 90_000, "1 second"), s, "event_time")
    folder = _folder(spark)
    q = St.fingerprint_batches(as_stream(released), lambda df: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    f = spark.read.parquet(f"{folder}/out").select(F.lit("trace").alias("kind"), "trace_id", F.col("fp_hash").alias("hash"))
    e = drained(St.signature_arrays, released).select(F.lit("error").alias("kind"), "trace_id", F.col("sig_hash").alias("hash"))
    return f.unionByName(e)


_BUFFERS = """sp as (select *, row_number() over (partition by trace_id order by start_us, span_id) as rn from spans),
    bf as (with recursive r(environment, trace_id, first_us, start_us, rn) as (select environment, trace_id, start_us, start_us, rn from sp where rn = 1
      union all select s.environment, s.trace_id, case when s.start_us // 1000 >= r.first_us // 1000 + 21600000 then s.start_us else r.first_us end, s.start_us, s.rn from r join sp s on s.trace_id = r.trace_id and s.rn = r.rn + 1) select * from r)"""
_RELEASED = "first_us // 1000 + 21600000 <= (select max(start_us) // 1000 from spans) - 3600000"


@query(sql(f"select environment, trace_id, n, first_us // 1000 as start_ms from (with {_BUFFERS} select environment, trace_id, first_us, count(*) as n, max(start_us) as last_us from bf group by 1, 2, 3) b where {_RELEASED} or exists (select 1 from (with {_BUFFERS} select * from bf) c where c.trace_id = b.trace_id and c.first_us > b.first_us)"))
def st_trace_buffer(spark, d):
    """Traces of a day in rows of six hours after their first span, as far as the watermark has come."""
    t = drained(lambda s: St.buffer_traces(s, 6 * 3_600_000, "1 hour"), X.event_spans(spark, d), "event_time")
    return t.select("environment", "trace_id", F.size("spans").cast("bigint").alias("n"), F.unix_millis("trace_start").alias("start_ms"))


@query(sql(f"select environment, trace_id, fp_hash, root_op, anomaly_type from ({_STREAM})"))
def st_classify(spark, d):
    """A stream of fingerprints against the baseline version that is current in each micro-batch."""
    from spanwatch.sources import sinks

    folder = _folder(spark)
    w, b = live(spark, d)
    sinks.write_baseline(b, f"{folder}/baseline")
    stream = as_stream(w)
    q = St.classify_batches(stream, lambda: sinks.read_baseline(spark, f"{folder}/baseline"), lambda df: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query()
def st_late_spans(spark, d):
    """Spans of the first days that arrive after those of the last days: how many rows the watermark drops."""
    s = X.event_spans(spark, d)
    folder = _folder(spark)
    s.where("event_time >= timestamp '2024-01-15'").coalesce(1).write.parquet(f"{folder}/in")
    counts = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rates = St.tumbling_rates(counts, "1 hour", "1 hour")

    def drain():
        q = rates.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return St.late_span_metrics(q)

    drain()
    s.where("event_time < timestamp '2024-01-10'").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.range(1).select(F.lit(drain()).cast("bigint").alias("dropped_rows"))


@query(sql("""select 'traces' as counter, count(*)::bigint as value, 5::bigint as batches from fps union all select 'known', count(*), 5 from fps where exists (select 1 from base b where b.environment = fps.environment and b.fp_hash = fps.fp_hash)
    union all select 'long', count(*), 5 from fps where span_count > 3"""))
def st_run_counters(spark, d):
    """Counters that a running stream observes in each micro-batch, as its listener writes them; added over batches."""
    f = fps_once(spark, d)
    known = learn_trace(learn_window(f)).select("environment", "fp_hash").withColumn("known", F.lit(True))
    rows = f.select("environment", "fp_hash", "span_count", F.unix_millis("trace_start").alias("ts_ms")).join(known, ["environment", "fp_hash"], "left")
    path = f"{_folder(spark)}/counters"
    listener = St.RunCounters(spark, path)
    spark.streams.addListener(listener)
    try:
        counters = {"traces": F.count("*"), "known": F.count("known"), "long": F.count_if(F.col("span_count") > 3)}
        drained(lambda s: St.counted(s, "run", **counters), rows, "ts_ms", ended=listener.settled)
    finally:
        spark.streams.removeListener(listener)
    told = spark.read.schema("query_id string, batch_id long, at string, counter string, value long").parquet(path)
    return told.groupBy("counter").agg(F.sum("value").alias("value"), F.count("*").alias("batches"))
