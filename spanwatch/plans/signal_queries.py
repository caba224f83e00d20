"""Queries on time series, the service graph and anomaly events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwatch.functions import scalars as S
from spanwatch.operators import baseline as B
from spanwatch.operators import correlate as K
from spanwatch.operators import errors as E
from spanwatch.operators import metrics as M
from spanwatch.operators import topology as G
from spanwatch.operators import traces as T
from spanwatch.plans.base import joined, learn_window, spans, spike_sql, sql, stored, watch_window
from spanwatch.plans.registry import query
from spanwatch.plans.scalar_queries import _TEMPLATE
from spanwatch.plans.structure_queries import base, ebase, fps, sigs
from spanwatch.sources import fixtures as X

DAY = 86_400
HOUR = 3_600_000

_OPS = "ops as (select environment, trace_id, service, operation, avg(duration_us) as mean_us, count(*) as n, sum(is_error::int)::bigint as errors, min(start_us) as ts_us from spans where duration_us > 0 group by 1, 2, 3, 4)"
_KEY = "environment, service, operation"
_LEARN = f"""ph as (select *, row_number() over (partition by {_KEY} order by ts_us, trace_id) as nth from ops),
    ls as (select *, nth <= 30 as learning, avg(mean_us) filter (where nth <= 30) over (partition by {_KEY}) as base_mean, stddev_pop(mean_us) filter (where nth <= 30) over (partition by {_KEY}) as base_std,
      avg(mean_us) over (partition by {_KEY} order by ts_us range between {2 * DAY * 1000000} preceding and current row) as rolling,
      count(*) over (partition by {_KEY} order by ts_us range between {2 * DAY * 1000000} preceding and current row) as buckets,
      sum(errors) over (partition by {_KEY} order by ts_us range between {2 * DAY * 1000000} preceding and current row) / sum(n) over (partition by {_KEY} order by ts_us range between {2 * DAY * 1000000} preceding and current row) as rate,
      (dayofweek(make_timestamp(ts_us)) * 24 + hour(make_timestamp(ts_us)))::int as slot from ph),
    se as (select *, count(*) over w as slot_n, avg(mean_us) over w as slot_mean, stddev_pop(mean_us) over w as slot_std from ls window w as (partition by {_KEY}, slot order by ts_us, trace_id rows unbounded preceding))"""
_OPKEY = ["environment", "service", "operation"]


def _q(select: str, *parts: str, **more: str) -> str:
    return sql("with " + ", ".join(parts) + " " + select, **more)


def ops(spark, d):
    return M.op_stats(spans(spark, d))


@query(_q("select environment, trace_id, service, operation, round(mean_us, 6) as mean_us, n, errors, ts_us from ops", _OPS))
def a_trace_op_stats(spark, d):
    return ops(spark, d).withColumn("mean_us", F.round("mean_us", 6))


_QS = f"qs as (select environment, trace_id, service, db_system as db, {_TEMPLATE.format('db_statement')} as template, avg(duration_us) as mean_us, count(*) as n, min(start_us) as ts_us from spans where db_statement <> '' and duration_us > 0 group by 1, 2, 3, 4, 5), qq as (select *, substr(sha1(service || chr(0) || db || chr(0) || template), 1, 16) as query_hash from qs)"


@query(_q("select trace_id, query_hash, round(mean_us, 6) as mean_us, n from qq", _QS))
def a_trace_query_stats(spark, d):
    return M.query_stats(spans(spark, d)).select("trace_id", "query_hash", F.round("mean_us", 6).alias("mean_us"), "n")


@query(_q("select trace_id, service, operation, nth::int as nth, learning from ls", _OPS, _LEARN))
def w_learn_phase(spark, d):
    return M.with_phase(ops(spark, d), _OPKEY, 30).select("trace_id", "service", "operation", "nth", "learning")


@query(_q("select trace_id, service, operation, round(base_mean, 3) as base_mean, round(base_std, 3) as base_std from ls", _OPS, _LEARN))
def w_baseline_stats(spark, d):
    return M.with_learn_stats(stored(ops(spark, d), "op-stats"), _OPKEY, "mean_us", 30).select("trace_id", "service", "operation", F.round("base_mean", 3).alias("base_mean"), F.round("base_std", 3).alias("base_std"))


@query(_q("select trace_id, service, operation, round(rolling, 3) as rolling from ls", _OPS, _LEARN))
def w_rolling_mean(spark, d):
    return M.with_rolling_mean(ops(spark, d), _OPKEY, "mean_us", 2 * DAY).select("trace_id", "service", "operation", F.round("rolling", 3).alias("rolling"))


@query(_q("select trace_id, service, operation, slot, slot_n, round(slot_mean, 3) as slot_mean, round(slot_std, 2) as slot_std from se", _OPS, _LEARN))
def w_seasonal(spark, d):
    return M.with_seasonal_stats(ops(spark, d), _OPKEY, "mean_us").select("trace_id", "service", "operation", "slot", "slot_n", F.round("slot_mean", 3).alias("slot_mean"), F.round("slot_std", 2).alias("slot_std"))


@query(_q("select trace_id, service, operation, buckets, round(rate, 9) as rate from ls", _OPS, _LEARN))
def w_rolling_error_rate(spark, d):
    return M.with_error_rate(ops(spark, d), _OPKEY, 2 * DAY).select("trace_id", "service", "operation", "buckets", F.round("rate", 9).alias("rate"))


@query(_q(f"select trace_id, service, operation, round((sum(n) over (partition by environment, service order by ts_us range between {DAY * 1000000 - 1} preceding and current row)) / 1440.0, 9) as per_min from ops", _OPS))
def w_spans_per_min(spark, d):
    return M.with_spans_per_min(ops(spark, d), DAY).select("trace_id", "service", "operation", F.round("per_min", 9).alias("per_min"))


@query(sql(f"select span_id, round((count(*) over (partition by environment, sig_hash order by epoch_us(event_time) range between {DAY * 1000000 - 1} preceding and current row)) / 1440.0, 9) as per_min from sigs"))
def w_error_sig_rate(spark, d):
    return M.with_sig_rate(sigs(spark, d), DAY).select("span_id", F.round("per_min", 9).alias("per_min"))


@query(_q("""select trace_id, service, operation, ts_us, round(rolling, 3) as rolling, round(z, 6) as z from (select *, case when slot_n >= 30 then slot_mean else base_mean end as expected,
    (rolling - case when slot_n >= 30 then slot_mean else base_mean end) / greatest(case when slot_n >= 30 then slot_std else base_std end, 0.001) as z from se where not learning) where z >= 0.5 and rolling > expected""", _OPS, _LEARN))
def d_latency(spark, d):
    return M.latency_anomalies(spans(spark, d), 2 * DAY, 30, 0.5).select("trace_id", "service", "operation", "ts_us", F.round("rolling", 3).alias("rolling"), F.round("z", 6).alias("z"))


@query(_q("select trace_id, service, operation, buckets, round(rate, 9) as rate from ls where buckets >= 10 and rate >= 0.05", _OPS, _LEARN))
def d_error_rate(spark, d):
    return M.error_rate_anomalies(spans(spark, d), 2 * DAY).select("trace_id", "service", "operation", "buckets", F.round("rate", 9).alias("rate"))


@query(_q("""select trace_id, query_hash, round(rolling, 3) as rolling, round(z, 6) as z from (select *, (rolling - base_mean) / greatest(base_std, 0.001) as z from (select *, avg(mean_us) filter (where nth <= 10) over (partition by environment, query_hash) as base_mean,
    stddev_pop(mean_us) filter (where nth <= 10) over (partition by environment, query_hash) as base_std, avg(mean_us) over (partition by environment, query_hash order by ts_us range between 432000000000 preceding and current row) as rolling
    from (select *, row_number() over (partition by environment, query_hash order by ts_us, trace_id) as nth from qq)) where nth > 10) where z >= 0.3 and rolling > base_mean""", _QS))
def d_slow_query(spark, d):
    return M.slow_queries(spans(spark, d), 5 * DAY, 10, 0.3).select("trace_id", "query_hash", F.round("rolling", 3).alias("rolling"), F.round("z", 6).alias("z"))


@query(_q("select environment, service, db, template, query_hash, min(ts_us) as first_us from qq group by 1, 2, 3, 4, 5 having min(ts_us) >= epoch_us(timestamp '2024-01-01 06:00:00') and template not like '%t1%'", _QS))
def d_new_query(spark, d):
    known = M.query_stats(spans(spark, d)).where("template like '%t1%'")
    return M.new_query_templates(spans(spark, d), "2024-01-01 06:00:00", known)


@query()
def d_throughput_drop(spark, d):
    f = stored(fps(spark, d), "fingerprints")
    return M.throughput_drops(f, 5 * DAY, lambda df: stored(df, "throughput"), DAY, drop=0.8, learn=20, rearm=0.9)


@query(spike_sql("sigs", str(2 * DAY * 1_000_000), 4, 2, "semi join ebase b using (environment, sig_hash)"))
def d_error_spike(spark, d):
    s = stored(sigs(spark, d), "signatures")
    return M.error_rate_spikes(s, stored(E.learn_error(learn_window(s, "event_time")), "errors"), 2 * DAY, 2.0, 4).drop("span_id")


_SNAPSHOT = f"""sn as (select *, sum(errors) over w as bad, sum(n) over w as total, (sum(n) over (partition by {_KEY}))::bigint as spans, row_number() over (partition by {_KEY} order by ts_us desc, trace_id desc) as r
      from ls window w as (partition by {_KEY} order by ts_us range between {2 * DAY * 1000000} preceding and current row)),
    oz as (select *, case when learning then 0.0 else (rolling - base_mean) / greatest(base_std, 0.001) end as z from sn where r = 1),
    op as (select environment, service, operation, rolling as latency_us, case when not learning then base_mean end as baseline_us, z, bad, total, bad / total as error_rate, spans,
      case when learning then 0 when z >= 3 or rate >= 0.05 then 3 when z >= 3 * 0.6 or rate >= 0.01 then 2 else 1 end as rank from oz),
    sv as (select * exclude (w) from (select environment, service, operation, latency_us, baseline_us, z, rank, row_number() over (partition by environment, service order by rank desc, z desc, operation desc) as w, sum(bad) over s / sum(total) over s as error_rate,
      (sum(spans) over s)::bigint as spans, count(*) over s as parts, count(*) filter (where rank = 2) over s as warn, count(*) filter (where rank = 3) over s as anomalies from op window s as (partition by environment, service)) where w = 1),
    en as (select environment, arg_max(service, (rank, z, service)) as service, coalesce(sum(latency_us) filter (where baseline_us is not null), 0.0) / count(*) as latency_us, coalesce(sum(error_rate) filter (where baseline_us is not null), 0.0) / count(*) as error_rate,
      sum(spans)::bigint as spans, count(*) as parts, count(*) filter (where rank = 2) as warn, count(*) filter (where rank = 3) as anomalies from sv group by 1),
    lv as (select 'operation' as level, environment, service, operation, latency_us, baseline_us, z, error_rate, spans, rank, 0::bigint as parts, 0::bigint as warn, 0::bigint as anomalies from op
      union all select 'service', environment, service, operation, latency_us, baseline_us, z, error_rate, spans, rank, parts, warn, anomalies from sv
      union all select 'environment', environment, service, '', latency_us, null, z, error_rate, spans, rank, parts, warn, anomalies from (select en.*, s.z, s.rank from en join sv s using (environment, service)))"""


@query(_q("""select level, environment, service, operation, round(latency_us / 1000, 3) as latency_ms, round(baseline_us / 1000, 3) as baseline_ms, round(z, 6) as z, round(error_rate, 9) as error_rate, spans, ['learning', 'ok', 'warn', 'anomaly'][rank + 1] as status,
    parts, warn, anomalies from lv""", _OPS, _LEARN, _SNAPSHOT))
def a_service_metrics(spark, d):
    m = M.metrics_snapshot(spans(spark, d), 2 * DAY)
    ms = [F.round(F.col(f"{c}_us") / 1000, 3).alias(f"{c}_ms") for c in ("latency", "baseline")]
    return m.select("level", "environment", "service", "operation", *ms, F.round("z", 6).alias("z"), F.round("error_rate", 9).alias("error_rate"), "spans", "status", "parts", "warn", "anomalies")


_SLO = "select environment, service, avg(is_error::int) as error_rate, list_sort(list(duration_us))[ceil(0.99::double * count(*))::bigint]::double as p99_us, count(*) / greatest((max(start_us) - min(start_us)) / 60000000.0, 1.0) as per_min from spans group by 1, 2"
_SLO_EXACT = "select environment, service, avg(is_error::int) as error_rate, quantile_cont(duration_us, 0.99) as p99_us, count(*) / greatest((max(start_us) - min(start_us)) / 60000000.0, 1.0) as per_min from spans group by 1, 2"


@query(sql(f"select environment, service, error_rate, round(p99_us, 3) as p99_us, round(per_min, 9) as per_min from ({_SLO_EXACT})"))
def a_slo(spark, d):
    return M.exact_slo_inputs(spans(spark, d)).select("environment", "service", "error_rate", F.round("p99_us", 3).alias("p99_us"), F.round("per_min", 9).alias("per_min"))


@query(sql(f"""select environment, service, round(error_rate / (1 - 0.93), 6) as burn, round(43200 * (1 - 0.93), 6) as budget_min, round(43200 * (1 - 0.93) / nullif(error_rate / (1 - 0.93), 0), 6) as breach_min,
    case when error_rate / (1 - 0.93) >= 14.4 then 'CRITICAL' when error_rate / (1 - 0.93) >= 6 then 'HIGH' when error_rate / (1 - 0.93) >= 2 then 'MEDIUM' else 'LOW' end as severity,
    case when p99_us / 1000 >= 6e7 then 'BREACH' when p99_us / 1000 >= 3e7 then 'WARN' else 'OK' end as p99_status from ({_SLO})"""))
def s_slo_budget(spark, d):
    return M.slo_budget(M.slo_inputs(spans(spark, d)), 0.93, 3e7)


@query(sql("select environment, service, max(e) as max_errors, max(n) as max_total, round(max(e) / max(n), 9) as rate, round(max(e) / max(n) / 0.005, 9) as burn from (select environment, service, start_us // 300000000 as b, sum(is_error::int)::bigint as e, count(*) as n from spans group by 1, 2, 3) group by 1, 2"))
def a_burn_5m(spark, d):
    return M.burn_status(spans(spark, d))


_TRAFFIC = "select environment, count(*) / greatest((max(s) - min(s)) / 60000000.0, 1.0) as per_min, avg(bad::int) as error_ratio, avg(n) as mean_spans from (select environment, trace_id, count(*) as n, bool_or(is_error) as bad, min(start_us) as s from spans group by 1, 2) group by 1"


@query(sql(f"select environment, round(per_min, 9) as per_min, round(error_ratio, 9) as error_ratio, round(mean_spans, 9) as mean_spans from ({_TRAFFIC})"))
def a_traffic_profile(spark, d):
    return M.traffic_profile(spans(spark, d)).select("environment", *[F.round(c, 9).alias(c) for c in ("per_min", "error_ratio", "mean_spans")])


_PROFILE = f"select environment, case when per_min < 2 then 'LOW' when per_min >= 20 then 'HIGH' else 'MEDIUM' end as traffic, case when error_ratio < 0.02 then 'QUIET' when error_ratio >= 0.15 then 'NOISY' else 'NORMAL' end as errors, case when s <= 3 then 'SIMPLE' when s >= 8 then 'COMPLEX' else 'MODERATE' end as topology from ({_TRAFFIC}) join (select environment, count(distinct service) as s from spans group by 1) using (environment)"


#: The topology summary of edges ``te``; purchases are seen from outside only, as a database.
_NODES_SQL = """tn as (select distinct environment, caller, case when callee = 'purchase' then 'mysql:purchase' else callee end as callee from te where caller <> 'purchase'),
    sv as (select distinct environment, service from spans where service <> 'purchase'),
    nc as (select environment, service, coalesce(i.n, 0) as callers, coalesce(o.n, 0) as callees, sv.own is null as inferred from (select environment, caller as service, count(*) as n from tn group by 1, 2) o
      full join (select environment, callee as service, count(*) as n from tn group by 1, 2) i using (environment, service) full join (select *, true as own from sv) sv using (environment, service)),
    nd as (select *, callers = 0 and not inferred as ingress, inferred and contains(service, ':') as db, callers >= 2 as shared, exists (select 1 from tn where tn.environment = nc.environment and tn.caller = nc.service and tn.callee = 'mysql:purchase') as calls_db from nc)"""


def _summary(spark, d):
    e = G.topology_edges(spans(spark, d)).where("caller <> 'purchase'").withColumn("callee", F.when(F.col("callee") == "purchase", "mysql:purchase").otherwise(F.col("callee")))
    return G.topology_summary(e, spans(spark, d).where("service <> 'purchase'"))


@query(sql(_PROFILE))
def s_onboarding_profile(spark, d):
    return M.environment_profile(M.traffic_profile(spans(spark, d)), T.environments(spans(spark, d)))


@query(sql(f"""with te as (select distinct environment, from_service as caller, to_service as callee from edges where from_service <> to_service), {_NODES_SQL}, pf as ({_PROFILE}), ln as (select environment, bool_or(callees > 0) as linked from nd group by 1)
    select environment, service, case traffic when 'HIGH' then 2 when 'LOW' then 10 else 5 end as watch_min, case traffic when 'HIGH' then 60 when 'LOW' then 240 else 120 end as learn_min,
    array_to_string(list_filter([case when not linked then 'MISSING_SERVICE' end, case when traffic = 'LOW' then 'SIGNATURE_VANISHED' end], lambda x: x is not null), ',') as disabled,
    case when db then 0.5 when ingress and traffic <> 'LOW' then 0.7 end::double as dominance, case when db or traffic = 'HIGH' then 1.5 end::double as spike_times, case when errors = 'NOISY' and not db then 4.0 end::double as error_spike_times
    from nd join pf using (environment) join ln using (environment)"""))
def s_onboarding_advice(spark, d):
    profile = M.environment_profile(M.traffic_profile(spans(spark, d)), T.environments(spans(spark, d)))
    return M.onboarding_advice(profile, _summary(spark, d))


_WIN = "wn as (select near || '-' || far as label, epoch_us(timestamp '2024-01-20') - far * 3600000000 as ws, epoch_us(timestamp '2024-01-20') - near * 3600000000 as we from (values (30, 90), (60, 120), (120, 240), (240, 360)) t(near, far))"
_SCORE = """sc as (select label, count(*) as traces, avg(bad::int) as error_rate, count(distinct seq) as variety from (select label, trace_id, string_agg(operation, '>' order by start_us, span_id) as seq, bool_or(is_error) as bad
    from spans join wn on start_us >= ws and start_us < we group by 1, 2) group by 1), sd as (select *, case when traces >= 10 then round(0.6 * (1 - error_rate) + 0.4 * least(variety / 50, 1.0), 9) end as score from sc)"""


def _windows(spark):
    return M.windows_before(spark, "2024-01-20", 3600)


@query(_q("select label, traces, round(error_rate, 9) as error_rate, variety, score from sd", _WIN, _SCORE))
def a_window_score(spark, d):
    return M.score_windows(spans(spark, d), _windows(spark)).withColumn("error_rate", F.round("error_rate", 9))


@query(_q("select label, traces, score from sd where score is not null order by score desc, label limit 1", _WIN, _SCORE))
def b_pick_window(spark, d):
    return M.pick_best_window(spans(spark, d), _windows(spark)).select("label", "traces", "score")


_BEST = "(select ws, we from sd join wn using (label) where score is not null order by score desc, label limit 1)"


@query(_q(f"""select 'trace' as kind, environment, fp_hash as hash, count(*) as n from fps join {_BEST} on epoch_us(trace_start) >= ws and epoch_us(trace_start) < we group by 2, 3 having count(*) >= 2
    union all select 'error', environment, sig_hash, count(*) from sigs join {_BEST} on epoch_us(event_time) >= ws and epoch_us(event_time) < we group by 2, 3 having count(*) >= 2""", _WIN, _SCORE))
def b_relearn_from_window(spark, d):
    w = stored(M.pick_best_window(spans(spark, d), _windows(spark)).join(_windows(spark), "label").select("start_us", "end_us"), "window")
    inside = lambda df, time: df.join(w, (F.unix_micros(time) >= F.col("start_us")) & (F.unix_micros(time) < F.col("end_us")))
    t = B.learn_trace(inside(fps(spark, d), "trace_start"), reset=True, bootstrap=True).select(F.lit("trace").alias("kind"), "environment", F.col("fp_hash").alias("hash"), F.col("occurrences").alias("n"))
    e = E.learn_error(inside(sigs(spark, d), "event_time")).select(F.lit("error").alias("kind"), "environment", F.col("sig_hash").alias("hash"), F.col("occurrences").alias("n"))
    return t.unionByName(e)


# ---- graph

_TE = "te as (select environment, from_service as caller, to_service as callee, min(t) as first_us, max(t) as last_us, count(*) as n from (select environment, trace_id, from_service, to_service, min(start_us) as t from edges where from_service <> to_service group by 1, 2, 3, 4) group by 1, 2, 3)"


def graph(spark, d, of=None):
    return G.topology_edges(spans(spark, d) if of is None else of)


def early_graph(spark, d):
    return G.topology_edges(spans(spark, d).where("start_us < 1704078000000000"))


_TB = "tb as (select distinct environment, from_service as caller, to_service as callee from edges where from_service <> to_service and start_us < 1704078000000000)"


@query(_q("select * from te", _TE))
def a_topology_edges(spark, d):
    return graph(spark, d)


@query(_q("select environment, service, callers, callees, inferred, ingress, db, calls_db, shared from nd", _TE, _NODES_SQL))
def a_topology_summary(spark, d):
    return _summary(spark, d)


@query(_q("select * from te where not exists (select 1 from tb where tb.environment = te.environment and tb.caller = te.caller and tb.callee = te.callee)", _TE, _TB))
def d_topology_drift(spark, d):
    return G.topology_drift(graph(spark, d), early_graph(spark, d))


_NODES = "select environment, caller as node from {0} union select environment, callee from {0}"


@query(_q(f"""select environment, 'node' as kind, node as name from (({_NODES.format('te')}) except ({_NODES.format('tb')})) union all
    select environment, 'edge', caller || '->' || callee from (select environment, caller, callee from te except select environment, caller, callee from tb)""", _TE, _TB))
def j_topology_merge(spark, d):
    return G.topology_delta(graph(spark, d), early_graph(spark, d))


@query(sql("select distinct environment, service from spans except select distinct environment, service from spans where start_us < 1704069000000000"))
def j_new_topology_services(spark, d):
    s = spans(spark, d)
    return G.new_services(s, s.where("start_us < 1704069000000000"))


@query(sql("""with c as (select environment, list(distinct service) as s from spans group by 1), p as (select environment, list(distinct service) as s from spans where start_us < 1704072600000000 group by 1),
    j as (select environment, c.s as cs, p.s as ps from c full join p using (environment)),
    k as (select environment, case when ps is null then 'new' when cs is null then 'removed' else 'updated' end as change, len(list_filter(coalesce(cs, []), lambda x: not list_contains(coalesce(ps, []), x))) + len(list_filter(coalesce(ps, []), lambda x: not list_contains(coalesce(cs, []), x))) as differ from j)
    select environment, change, differ::int as differ from k where differ > 0 or change <> 'updated'"""))
def j_env_diff(spark, d):
    s = spans(spark, d)
    return G.diff_environments(T.environments(s), T.environments(s.where("start_us < 1704072600000000")))


@query(sql("""with t as (select environment, fp_hash, occurrences, i as pos, split_part(toks[i], ':', 1) as service from pathsx, unnest(range(1, len(toks) + 1)) as r(i)),
    u as (select *, lag(service) over (partition by environment, fp_hash order by pos) as before, min(pos) over (partition by environment, fp_hash, service) as seen from t)
    select environment, before as caller, service as callee, sum(occurrences)::bigint as weight from u where before is not null and before <> service and pos = seen and before <> 'signup' and service <> 'signup' group by 1, 2, 3"""))
def a_topology_from_baseline(spark, d):
    return G.graph_from_baseline(base(spark, d), ("signup",))


_WALK = """wk as (select environment, origin, node, min(hops) as hops from (with recursive r(environment, origin, node, hops) as (select environment, service, service, 0 from starts union
    select r.environment, r.origin, tb.{1}, r.hops + 1 from r join tb on tb.environment = r.environment and tb.{0} = r.node{2}) select * from r) group by 1, 2, 3)"""


# without a bound: hops are those of the first round that meets a node, so a walk that grows by its own seen nodes ends
_CLIMB = """wk as (select environment, origin, node, min(hops) as hops from (with recursive r(environment, origin, node, hops, seen) as (select environment, service, service, 0, [service] from starts union
    select r.environment, r.origin, tb.{1}, r.hops + 1, list_append(r.seen, tb.{1}) from r join tb on tb.environment = r.environment and tb.{0} = r.node where not list_contains(r.seen, tb.{1})) select * from r) group by 1, 2, 3)"""


def _starts(spark, d):
    return early_graph(spark, d).select("environment", F.col("caller").alias("node")).distinct()


@query(_q("select environment, origin, node, hops::int as hops from wk", _TB, "starts as (select distinct environment, caller as service from tb)", _WALK.format("caller", "callee", " where r.hops < 3")))
def g_reachable(spark, d):
    return G.reachable(early_graph(spark, d), _starts(spark, d), 3)


@query(_q("select environment, callee, count(distinct caller) as callers from te where caller in ('view', 'click', 'error') and callee <> 'signup' group by 1, 2 having count(distinct caller) >= 2", _TE))
def g_shared_deps(spark, d):
    g = graph(spark, d)
    return G.shared_deps(g, g.where("caller in ('view', 'click', 'error')").select("environment", F.col("caller").alias("node")), ("signup",))


@query(_q("select environment, origin, node, hops::int as hops from wk", _TB, "starts as (select environment, min(callee) as service from tb group by 1)", _CLIMB.format("callee", "caller")))
def g_causal_chain(spark, d):
    e = early_graph(spark, d)
    roots = e.groupBy("environment").agg(F.min("callee").alias("node"))
    active = e.select("environment", F.col("caller").alias("service"))
    return G.causal_chain(e, active, roots)


def _acts(spark, d):
    """Anomalies on the services of the event spans: types by the day of the span."""
    s = spans(spark, d).where("is_error or service = 'signup'")
    return s.select("environment", F.when(F.col("is_error"), "error").otherwise("signup").alias("service"), F.when(F.col("operation") == "op0", "MISSING_SERVICE").when(F.col("service") == "signup", "NEW_FINGERPRINT").otherwise("LATENCY_ANOMALY").alias("anomaly_type"), (F.col("start_us") / 1000).cast("bigint").alias("ts_ms"), F.col("span_id").cast("bigint").alias("event_id"), F.concat_ws(" ", "service", "operation").alias("message"))


_ACTS = "ac as (select environment, service, case when operation = 'op0' then 'MISSING_SERVICE' when service = 'signup' then 'NEW_FINGERPRINT' else 'LATENCY_ANOMALY' end as anomaly_type, start_us // 1000 as ts_ms, span_id::bigint as event_id, service || ' ' || operation as message from spans where is_error or service = 'signup')"


@query(_q("""select distinct 'marker' as kind, tb.environment, tb.caller as service, 'NEW_FINGERPRINT' as anomaly_type, '' as caller from tb join ac on ac.environment = tb.environment and ac.service = tb.callee and ac.anomaly_type = 'MISSING_SERVICE' where not exists (select 1 from ac x where x.environment = tb.environment and x.service = tb.caller)
    union all select distinct 'node', environment, 'x' || service, '', case when exists (select 1 from tb where tb.environment = ac.environment and 'view' in (tb.caller, tb.callee)) then 'view' else '' end from ac""", _TB, _ACTS))
def g_caller_markers(spark, d):
    acts, e = _acts(spark, d), early_graph(spark, d)
    marks = G.caller_markers(acts, e).select(F.lit("marker").alias("kind"), "environment", "service", "anomaly_type", F.lit("").alias("caller"))
    strange = acts.withColumn("service", F.concat(F.lit("x"), "service")).withColumn("root_op", F.lit("view:op0"))
    nodes = G.unknown_nodes(strange, e).select(F.lit("node").alias("kind"), "environment", "service", F.lit("").alias("anomaly_type"), F.coalesce("caller", F.lit("")).alias("caller"))
    return marks.unionByName(nodes)


@query(_q("""select distinct a.environment, a.service from (select environment, service from ac where service = 'signup' group by 1, 2) a join wk on wk.environment = a.environment and wk.node = a.service and wk.hops > 0""",
    _TB, _ACTS, "starts as (select environment, min(callee) as service from tb group by 1)", _CLIMB.format("callee", "caller")))
def g_secondary(spark, d):
    e = early_graph(spark, d)
    soft = _acts(spark, d).where("service = 'signup'").withColumn("anomaly_type", F.lit("LATENCY_ANOMALY"))
    return G.secondary_services(e, soft, e.groupBy("environment").agg(F.min("callee").alias("node")))


_AFFECTED = """aa as (select environment, service, min(ts_ms) as first_ms, bool_or(anomaly_type = 'MISSING_SERVICE') as gone from ac group by 1, 2),
    ti as (select tb.*, b.first_ms - a.first_ms as lead from tb join aa a on a.environment = tb.environment and a.service = tb.caller join aa b on b.environment = tb.environment and b.service = tb.callee),
    starts as (select environment, service from aa)"""
_DEEPEST = """nx as (select environment, caller, arg_min(callee, (-w, callee)) as callee from (select ti.environment, ti.caller, ti.callee, (select count(distinct trace_id) from edges e where e.environment = ti.environment and e.from_service = ti.caller and e.to_service = ti.callee
      and e.start_us < 1704078000000000) as w from ti) group by 1, 2),
    dw as (select environment, origin, node from (with recursive r(environment, origin, node, seen, back) as (select environment, service, service, [service], false from starts union all
      select r.environment, r.origin, nx.callee, list_append(r.seen, nx.callee), list_contains(r.seen, nx.callee) from r join nx on nx.environment = r.environment and nx.caller = r.node where not r.back)
      select *, len(seen) as k from r) qualify row_number() over (partition by environment, origin order by k desc) = 1)"""
_CANDIDATES = """cn as (select environment, candidate, count(*) filter (where rule = 'deepest') as supporters, string_agg(distinct rule, ',' order by rule) as rules from (
    select environment, node as candidate, 'deepest' as rule from dw union all select environment, service, 'missing' from aa where gone
    union all select environment, caller, 'earlier' from ti group by 1, 2 having min(lead) >= 5000) group by 1, 2)"""
_TO_CANDIDATES = (_TB, _ACTS, _AFFECTED, _DEEPEST, _CANDIDATES)


@query(_q("select environment, candidate, supporters, rules from cn", *_TO_CANDIDATES))
def g_candidates(spark, d):
    return G.root_candidates(early_graph(spark, d), _acts(spark, d))


@query(_q("""select environment, candidate, round(least(w * 0.6 + case when cycles > 0 then 0 else greatest(callers, callees) / greatest(n - 1, 1) end * 0.25 + (1 - (f - lo) / greatest(hi - lo, 1)) * 0.01 + case when m then 0.3 else 0 end, 1.0), 9) as confidence from (
    select cn.environment, cn.candidate, wt.w, wt.f, wt.m, bd.lo, bd.hi, bd.n, (select count(*) from tb join aa on aa.environment = tb.environment and aa.service = tb.caller where tb.environment = cn.environment and tb.callee = cn.candidate) as callers,
    (select count(*) from tb join aa on aa.environment = tb.environment and aa.service = tb.callee where tb.environment = cn.environment and tb.caller = cn.candidate) as callees,
    (select count(*) from tb join aa on aa.environment = tb.environment and aa.service = tb.callee join tb r on r.environment = tb.environment and r.caller = tb.callee and r.callee = tb.caller where tb.environment = cn.environment and tb.caller = cn.candidate) as cycles
    from cn join wt on wt.environment = cn.environment and wt.service = cn.candidate join bd on bd.environment = cn.environment)""", *_TO_CANDIDATES,
    "wt as (select environment, service, max(case anomaly_type when 'MISSING_SERVICE' then 1.0 when 'LATENCY_ANOMALY' then 0.5 else 0.3 end::double) as w, min(ts_ms) as f, bool_and(anomaly_type = 'MISSING_SERVICE') as m from ac group by 1, 2)",
    "bd as (select environment, min(ts_ms) as lo, max(ts_ms) as hi, count(distinct service) as n from ac group by 1)"))
def g_confidence(spark, d):
    return G.confidence(early_graph(spark, d), _acts(spark, d), G.root_candidates(early_graph(spark, d), _acts(spark, d)))


_HYP = """kd as (select environment, service, max((anomaly_type = 'MISSING_SERVICE')::int) as m, max((anomaly_type = 'NEW_FINGERPRINT')::int) as fresh from ac group by 1, 2), dp as (select distinct environment, service from ac where ts_ms < 1704078000000),
    hy as (select t.environment as environment, 'shared_dependency' as kind, callee as cause, false as direct, 0.6::double as confidence, count(distinct caller) as explains from tb t join kd k on k.environment = t.environment and k.service = t.caller group by 1, 3 having count(distinct caller) >= 2
    union all select t.environment, 'downstream_failure', callee, max(x.m) = 1, case when max(x.m) = 1 then 0.9 else 0.7 end, count(distinct caller) from tb t join kd k on k.environment = t.environment and k.service = t.caller join kd x on x.environment = t.environment and x.service = t.callee group by 1, 3
    union all select k.environment, 'self_change', k.service, true, case when k.fresh = 1 then 0.8 else 0.65 end, 1 from kd k join dp on dp.environment = k.environment and dp.service = k.service
    union all select k.environment, 'self_change', k.service, false, 0.5, 1 from kd k where k.fresh = 1 and not exists (select 1 from dp where dp.environment = k.environment and dp.service = k.service) and not exists (select 1 from tb where tb.environment = k.environment and tb.caller = k.service)
    union all select t.environment, 'upstream_change', caller, false, 0.5, count(distinct callee) from tb t join kd k on k.environment = t.environment and k.service = t.callee join dp on dp.environment = t.environment and dp.service = t.caller group by 1, 3
    union all select t.environment, 'cascade', callee, false, 0.55, count(distinct caller) from tb t join kd k on k.environment = t.environment and k.service = t.caller join kd x on x.environment = t.environment and x.service = t.callee group by 1, 3 having count(distinct caller) >= 3)"""


@query(_q("select * from hy", _TB, _ACTS, _HYP))
def g_hypotheses(spark, d):
    return _hyp(spark, d).drop("place")


def _hyp(spark, d):
    a = _acts(spark, d)
    return G.hypotheses(early_graph(spark, d), a, a.where("ts_ms < 1704078000000"))


@query(_q("select *, (row_number() over (partition by environment order by direct desc, confidence desc, explains desc, kind, cause))::int as place from hy", _TB, _ACTS, _HYP))
def w_rank_hypotheses(spark, d):
    return _hyp(spark, d)


@query(_q("""select environment, service, string_agg(distinct anomaly_type, ',' order by anomaly_type) as types, count(*) as n, array_to_string(list(message order by ts_ms, event_id, message)[1:3], '; ') as messages from ac where service = 'error' group by 1, 2""", _ACTS))
def j_signal_to_graph(spark, d):
    return G.node_signals(_acts(spark, d), spans(spark, d).where("service = 'error'").select("environment", F.col("service").alias("node")))


# ---- events


def events(spark, d):
    return X.anomaly_events(spark, d)


_FAN = """fan as (select environment, service, tier, anomaly_type, ts_ms, event_id, services, hash from anomalies union all
    select environment, 'svc' || (k % 50), tier, anomaly_type, ts_ms, event_id, services, hash from anomalies where anomaly_type = 'MISSING_SERVICE' and 'svc' || (k % 50) <> service)"""
_CORR = f"""cr as (select environment, service, ts_ms // {24 * HOUR} as bucket, list_sort(list(distinct tier)) as t, count(*) as event_count, string_agg(distinct anomaly_type, ',' order by anomaly_type) as anomaly_types, min(ts_ms) as earliest_ms, max(ts_ms) as latest_ms from fan group by 1, 2, 3 having count(distinct tier) >= 2),
    co as (select *, case when len(t) = 3 then 'MULTI_TIER' when list_contains(t, 'tier2') and list_contains(t, 'tier3') then 'TIER2_TIER3' when list_contains(t, 'tier2') then 'TIER1_TIER2' else 'TIER1_TIER3' end as corr_type from cr),
    cd as (select c.*, d.version, d.ts_ms as deploy_ms, row_number() over (partition by c.environment, c.service, c.bucket order by abs(d.ts_ms - c.earliest_ms), d.version, d.ts_ms) as r from co c left join deploys d on d.environment = c.environment and d.service = c.service and abs(d.ts_ms - c.earliest_ms) <= 3600000)"""


def corr(spark, d):
    return K.correlate(events(spark, d), X.deployments(spark, d), 24 * HOUR)


@query(_q("select environment, service, event_id from fan", _FAN))
def j_missing_fanout(spark, d):
    return K.fan_out_missing(events(spark, d)).select("environment", "service", "event_id")


_SEV = "case when corr_type = 'MULTI_TIER' then case when version is null then 'Critical' else 'Major' end else case when version is null then 'Major' else 'Minor' end end as severity"


@query(_q(f"select environment, service, bucket, array_to_string(t, ',') as tiers, event_count, anomaly_types, corr_type, {_SEV}, (latest_ms - earliest_ms) // 1000 as time_span_s from cd where r = 1", _FAN, _CORR))
def a_correlate(spark, d):
    return corr(spark, d).select("environment", "service", "bucket", "tiers", "event_count", "anomaly_types", "corr_type", "severity", "time_span_s")


@query(_q("select environment, service, bucket, version, deploy_ms from cd where r = 1 and version is not null", _FAN, _CORR))
def j_deployment_asof(spark, d):
    return corr(spark, d).where("version is not null").select("environment", "service", "bucket", "version", "deploy_ms")


@query(_q(f"select environment, service, bucket, {_SEV}, event_count from cd where r = 1", _FAN, _CORR))
def t_order_correlations(spark, d):
    return K.order_correlations(corr(spark, d)).select("environment", "service", "bucket", "severity", "event_count")


@query(sql(f"select event_id from anomalies a where not exists (select 1 from anomalies r where r.environment = a.environment and r.hash = a.hash and r.tier = 'tier1' and r.ts_ms >= a.ts_ms)"))
def j_recovered_anti(spark, d):
    e = events(spark, d)
    return K.drop_recovered(e, e.where("tier = 'tier1'")).select("event_id")


_CONF = "select event_id, exists (select 1 from anomalies c where c.tier = 'tier1' and c.environment = a.environment and c.service = a.service and abs(c.ts_ms - a.ts_ms) <= 3600000) as confirmed, service, anomaly_type from anomalies a where tier <> 'tier1'"


def labelled(spark, d):
    e = events(spark, d)
    return K.classify_tp_fp(e.where("tier <> 'tier1'"), e.where("tier = 'tier1'"), HOUR)


@query(sql(f"select event_id, confirmed from ({_CONF})"))
def j_confirm_semi(spark, d):
    return labelled(spark, d).select("event_id", "confirmed")


_STATS = f"select service, sum(confirmed::int)::bigint as tp, sum((not confirmed)::int)::bigint as fp, count(*) as total, sum((anomaly_type = 'SPAN_COUNT_SPIKE')::int)::bigint as spikes, sum((anomaly_type = 'SPAN_COUNT_DROP')::int)::bigint as drops, sum((anomaly_type = 'SIGNATURE_SPIKE')::int)::bigint as error_spikes, round(sum((not confirmed)::int) / count(*), 9) as fp_rate from ({_CONF}) group by 1"


@query(sql(_STATS))
def a_tp_fp_stats(spark, d):
    return K.tp_fp_stats(labelled(spark, d))


@query(sql(f"""select service, way::int as way, round(least(greatest(0.6 + way * 0.15, 0.4), 0.9), 4)::double as missing_service_dominance_threshold, round(case when spikes > 0 then least(greatest(2.0 + way * 0.75, 1.5), 5.0) else 2.0 end, 4)::double as span_count_spike_multiplier,
    round(case when drops > 0 then least(greatest(0.5 - way * 0.15, 0.1), 0.9) else 0.5 end, 4)::double as span_count_drop_threshold, round(case when error_spikes > 0 then least(greatest(3.0 + way * 1.5, 2.0), 8.0) else 3.0 end, 4)::double as error_spike_multiplier
    from (select *, case when fp_rate >= 0.7 then 1 when fp_rate <= 0.2 then -1 else 0 end as way from ({_STATS}) where total >= 5) where way <> 0"""))
def s_adaptive_thresholds(spark, d):
    """Three runs on the same statistics, each from the thresholds of the one before."""
    stats = stored(K.tp_fp_stats(labelled(spark, d)), "stats")
    return K.tune_thresholds(stats, K.tune_thresholds(stats, K.tune_thresholds(stats)))


@query(sql("select anomaly_type, environment, service, count(*) as n from anomalies group by 1, 2, 3"))
def sink_anomaly_counts(spark, d):
    return K.anomaly_counts(events(spark, d))


@query(sql("select environment, round(count(*) / 43200.0, 9) as per_min from anomalies group by 1"))
def a_anomaly_rate(spark, d):
    return K.anomaly_rate(events(spark, d), 43200)


_IW = """ib as (select environment, ts_ms // 3600000 as b, count(*) as n from anomalies group by 1, 2 having count(*) >= 6), ig as (select *, sum(new) over (partition by environment order by b) as g from (select *, case when b - lag(b) over (partition by environment order by b) <= 2 then 0 else 1 end as new from ib)),
    iw as (select environment, (min(b) * 3600 - 300) * 1000 as start_ms, ((max(b) + 1) * 3600 + 300) * 1000 as end_ms, sum(n)::bigint as events from ig group by environment, g)"""


def windows(spark, d):
    return K.incident_windows(events(spark, d), 3600, 6)


@query(_q("select * from iw", _IW))
def a_incident_windows(spark, d):
    return windows(spark, d)


@query(_q("select b.environment, b.fp_hash, b.root_op, min(w.start_ms) as window_start from base b join iw w on w.environment = b.environment and epoch_us(b.first_seen) // 1000 between w.start_ms and w.end_ms group by 1, 2, 3", _IW))
def j_incident_window(spark, d):
    return B.stale_entries(base(spark, d), windows(spark, d))


_HEALTH = """select environment, 'STALE_BASELINE' as "check", '' as hash, '' as root_op from (select distinct environment from base)
    union all select distinct b.environment, 'STALE_ENTRIES', b.fp_hash, b.root_op from base b join iw w on w.environment = b.environment and epoch_us(b.first_seen) // 1000 between w.start_ms and w.end_ms
    union all select a.environment, 'NEAR_DUPLICATES', a.fp_hash, a.root_op from pathsx a join pathsx b on a.environment = b.environment and a.root_op = b.root_op and a.fp_hash < b.fp_hash
      where len(list_intersect(list_distinct(a.toks), list_distinct(b.toks))) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.85
    union all select environment, 'INCIDENT_ARTIFACTS', sig_hash, operation from ebase where error_type in ('503', 'java.net.ConnectException')"""


@query(_q(_HEALTH, _IW))
def b_health(spark, d):
    s = stored(T.resolve_parents(spans(spark, d), explicit=False), "parented")
    return B.health_check(stored(base(spark, d, s), "baseline"), stored(ebase(spark, d, s), "errors"), stored(windows(spark, d), "windows"), "2024-02-10")


def _sess(key: str, gap: int) -> str:
    return f"ss as (select *, sum(new) over (partition by {key} order by ts_ms, event_id) as session from (select *, case when ts_ms - lag(ts_ms) over (partition by {key} order by ts_ms, event_id) <= {gap} then 0 else 1 end as new from anomalies))"


@query(_q("select environment, 'INC-' || upper(substr(sha1(string_agg(distinct anomaly_type || ':' || service, '|' order by anomaly_type || ':' || service)), 1, 8)) as incident, min(ts_ms) as start_ms, count(*) as size from ss group by environment, session", _sess("environment", 600000)))
def w_gap_sessions(spark, d):
    return K.group_incidents(events(spark, d), 600_000)


@query(_q("select environment, service, anomaly_type, hash, min(ts_ms) as opened_ms, max(ts_ms) as last_ms, count(*) - 1 as suppressed from ss group by environment, service, anomaly_type, hash, session", _sess("environment, service, anomaly_type, hash", 24 * HOUR)))
def s_dedup_incidents(spark, d):
    return K.dedup_incidents(events(spark, d), 24 * HOUR)


@query(_q("select environment, min(ts_ms) as opened_ms, max(ts_ms) as closed_ms, max(ts_ms) + 300000 as expires_ms, count(*) as events, count(distinct service) as services from ss group by environment, session", _sess("environment", 900000)))
def s_problem_sessions(spark, d):
    return K.problem_sessions(events(spark, d), 900_000)


_FB = f"fb as (select environment, ts_ms // {24 * HOUR} as day, list_sort(list(distinct anomaly_type)) as types, list_sort(list(distinct service)) as services from anomalies group by 1, 2)"


def feedback(spark, d):
    return K.incident_feedback(events(spark, d))


@query(_q("""select environment, min(ts_ms) as start_ms, string_agg(distinct anomaly_type, ',' order by anomaly_type) as types, string_agg(distinct service, ',' order by service) as services,
    case when bool_or(anomaly_type = 'MISSING_SERVICE') or count(distinct tier) >= 2 then 'INCIDENT' else 'DEGRADED' end as severity from ss group by environment, session""", _sess("environment", 600000)))
def a_incident_feedback(spark, d):
    return K.incident_history(events(spark, d), 600_000).withColumn("types", joined("types")).withColumn("services", joined("services"))


_SIM = "select c.environment, c.day, p.environment as p_env, p.day as p_day, len(list_intersect(c.types, p.types)) + len(list_intersect(c.services, p.services)) as score from fb c join fb p on p.day < 19752 where c.day = 19752"


@query(_q(f"select environment, day, p_env, p_day, score, place::int as place from (select *, row_number() over (partition by environment, day order by score desc, p_env, p_day) as place from ({_SIM})) where place <= 5", _FB))
def j_similar_incidents(spark, d):
    f = feedback(spark, d)
    return K.similar_incidents(f.where("day = 19752"), f.where("day < 19752"))


@query(_q(f"select environment, p_env, p_day, place::int as place from (select *, row_number() over (partition by environment, day order by score desc, p_env, p_day) as place from ({_SIM})) where place <= 3", _FB))
def t_topn_similar(spark, d):
    f = feedback(spark, d)
    return K.similar_incidents(f.where("day = 19752"), f.where("day < 19752"), 3).select("environment", "p_env", "p_day", "place")


@query(_q(f"select environment, service, bucket from (select *, earliest_ms - lag(earliest_ms) over (partition by environment, service, corr_type order by earliest_ms) as gap from co) where gap is null or gap > {48 * HOUR}", _FAN, _CORR))
def j_suppress_seen(spark, d):
    c = K.correlate(events(spark, d), None, 24 * HOUR)
    return K.suppress_recent(c, ["environment", "service", "corr_type"], 48 * HOUR).select("environment", "service", "bucket")


@query(sql("select environment, ts_ms // 300000 as poll, count(*) as triggers from (select environment, ts_ms, ts_ms - lag(ts_ms) over (partition by environment order by ts_ms) as gap from anomalies where tier = 'tier1') where gap is null or gap > 600000 group by 1, 2"))
def b_relearn_trigger(spark, d):
    return K.relearn_trigger(events(spark, d).where("tier = 'tier1'"))


_FE = "fe as (select service, anomaly_type, environment, min(ts_ms) as first_ms, count(*) as n, case environment when 'dev' then 0 when 'staging' then 2 else 3 end as stage from anomalies group by 1, 2, 3)"


@query(_q("select service, anomaly_type, environment, first_ms, n from fe", _FE))
def w_env_first(spark, d):
    return K.first_by_environment(events(spark, d))


@query(_q(f"""select service, anomaly_type, array_to_string(e, '>') as progress, len(e) / 3 as share, coalesce(nx, '') as next_environment, hi - lo as spread_ms, case when nx = 'prod' then 'CRITICAL' else 'HIGH' end as severity from (select *, list_filter(['dev', 'staging', 'prod'], lambda x: not list_contains(e, x))[1] as nx from
    (select service, anomaly_type, list(first_ms order by stage) as t, list(environment order by stage) as e, max(first_ms) as hi, min(first_ms) as lo from fe group by 1, 2)) where len(t) >= 2 and t = list_sort(t) and hi - lo <= {72 * HOUR}""", _FE))
def s_propagation(spark, d):
    return K.detect_propagation(events(spark, d), 72 * HOUR)


_CROSS = """pk as (select environment, anomaly_type, service, root_op, min(ts_ms) as ms, regexp_replace(lower(service), '[-_0-9]', '', 'g') as core, trim(regexp_replace(root_op, '^[^:]*:', '')) as op from (select environment, anomaly_type, 'svc-' || case user_id % 4 when 0 then 'cart' when 1 then 'carts' when 2 then 'user' else 'x' end || (user_id % 3) as service, 'r:' || event_type_op as root_op, ts_ms
      from (select a.*, 'op' || (k % 2) as event_type_op from anomalies a)) group by 1, 2, 3, 4),
    mt as (select *, round(sv * 0.7 + ov * 0.3, 6) as score from (select s.anomaly_type, s.service as s_service, s.root_op as s_root_op, s.ms as s_ms, p.service as p_service, p.root_op as p_root_op, p.ms as p_ms,
      case when s.core = p.core then 1.0 when contains(s.core, p.core) or contains(p.core, s.core) then 0.7 else 0.0 end as sv, case when s.op = p.op then 1.0 when contains(s.op, p.op) or contains(p.op, s.op) then 0.5 else 0.0 end as ov
      from pk s join pk p on p.environment = 'prod' and s.anomaly_type = p.anomaly_type where s.environment = 'staging') where sv > 0),
    bm as (select * from (select *, row_number() over (partition by anomaly_type, s_service, s_root_op order by score desc, p_ms, p_root_op, p_service) as r from mt where score >= 0.7) where r = 1)"""


def _crossed(spark, d):
    e = X._events(spark, d).select("event_id", "user_id", "k")
    name = F.when(F.col("user_id") % 4 == 0, "cart").when(F.col("user_id") % 4 == 1, "carts").when(F.col("user_id") % 4 == 2, "user").otherwise("x")
    a = events(spark, d).drop("service", "root_op").join(e, "event_id")
    a = a.withColumn("service", F.concat(F.lit("svc-"), name, F.col("user_id") % 3)).withColumn("root_op", F.concat(F.lit("r:op"), F.col("k") % 2))
    return a.where("environment = 'staging'"), a.where("environment = 'prod'")


@query(_q("select anomaly_type, s_service, s_root_op, p_service, p_root_op, score::double as score from bm", _CROSS))
def j_cross_env_match(spark, d):
    return K.cross_env_match(*_crossed(spark, d)).drop("s_ms", "p_ms")


@query(_q("select s.anomaly_type, count(*) as staging, count(b.score) as matched, sum(coalesce((b.s_ms < b.p_ms)::int, 0))::bigint as early, sum((b.score is null)::int)::bigint as staging_only from (select * from pk where environment = 'staging') s left join bm b on b.anomaly_type = s.anomaly_type and b.s_service = s.service and b.s_root_op = s.root_op group by 1", _CROSS))
def s_cross_env(spark, d):
    return K.cross_env_report(*_crossed(spark, d))


_NEXT = """case when r.state = 'SPIKING' then case when o.rate < 1.0 and o.minute - r.spiked < 2 then 'NORMAL' when o.rate < 0.5 then 'RESOLVING' else 'SPIKING' end
    when r.state = 'RESOLVING' then case when o.rate >= 1.0 then 'SPIKING' when o.minute - r.calmed >= 2 then 'HEAL' else 'RESOLVING' end when o.rate >= 1.0 then 'SPIKING' else 'NORMAL' end"""


@query(sql(f"""select environment, minute, state from (with recursive o as (select *, row_number() over (partition by environment order by minute) as n from (select environment, ts_ms // 3600000 as minute, count(*) / 5 as rate from anomalies group by 1, 2)),
    r(environment, n, minute, state, spiked, calmed, before) as (select distinct environment, 0::bigint, 0::bigint, 'NORMAL', 0::bigint, 0::bigint, 'NORMAL' from o union all
    select environment, n, minute, state, case when before in ('NORMAL', 'HEAL') and state = 'SPIKING' then minute else spiked end, case when before = 'SPIKING' and state = 'RESOLVING' then minute else calmed end, before
      from (select o.environment, o.n, o.minute, {_NEXT} as state, r.spiked, r.calmed, r.state as before from r join o on o.environment = r.environment and o.n = r.n + 1)) select * from r) where state <> before"""))
def s_incident_state(spark, d):
    hourly = events(spark, d).groupBy("environment", F.floor(F.col("ts_ms") / HOUR).alias("minute")).agg((F.count("*") / 5).alias("rate"))
    return K.incident_states(hourly, 1.0, 0.5, 2)


@query(sql("select event_id from anomalies a where anomaly_type <> 'NEW_FINGERPRINT' or exists (select 1 from (select distinct environment, split_part(root_op, ':', 1) as s from anomalies where tier = 'tier2' and k < 30) r where r.environment = a.environment and r.s = a.service)"))
def s_noise_drop(spark, d):
    from spanwatch.operators.classify import drop_auto_noise

    k = X._events(spark, d).select("event_id", "k")
    roots = events(spark, d).join(k, "event_id").where("tier = 'tier2' and k < 30").select("environment", "root_op")
    return drop_auto_noise(events(spark, d), roots).select("event_id")


@query(sql("select environment, service, array_to_string(list(anomaly_type || ' on ' || service order by ts_ms, event_id)[1:3], '; ') as messages from anomalies group by 1, 2"))
def t_topk_messages(spark, d):
    return K.top_messages(events(spark, d), 3)


@query(sql("select 'tier1' as source, environment, service, event_id, anomaly_type from anomalies where tier = 'tier1' union all select 'other', environment, service, event_id, null from anomalies where tier <> 'tier1'"))
def set_union_events(spark, d):
    e = events(spark, d)
    one = e.where("tier = 'tier1'").select(F.lit("tier1").alias("source"), "environment", "service", "event_id", "anomaly_type")
    return K.union_events(one, e.where("tier <> 'tier1'").select(F.lit("other").alias("source"), "environment", "service", "event_id"))


@query(sql("""with v as (select environment, service, count(distinct fp_hash) as fps from (select environment, fp_hash, unnest(list_distinct(list_append(services, root_service))) as service from base) group by 1, 2), x as (select environment, service, bool_or(error_type in ('503', 'java.net.ConnectException')) as c from ebase group by 1, 2),
    te as (select distinct environment, from_service as caller, to_service as callee from edges where from_service <> to_service), i as (select environment, callee as service, count(*) as callers from te group by 1, 2), o as (select environment, caller as service, count(*) as callees from te group by 1, 2),
    r as (select environment, count(*) / 720.0 as h from anomalies group by 1),
    j as (select environment, service, greatest(least(case when not exists (select 1 from base b where b.environment = q.environment) then 20 when fps is null then 25 when fps = 1 then 30 when fps <= 3 then 20 when fps <= 8 then 10 else 5 end
      + case when not exists (select 1 from ebase b where b.environment = q.environment) then 5 when c then 25 else 0 end + case when callers is null and callees is null then 5 when coalesce(callers, 0) >= 4 then 25 when coalesce(callers, 0) >= 2 then 15 else 8 end
      + case when h >= 10 then 20 when h >= 3 then 12 when h >= 1 then 6 else 0 end + case service when 'view' then -5 when 'click' then 8 else 0 end, 100), 0)::int as score
      from (select * from v full join x using (environment, service) full join i using (environment, service) full join o using (environment, service) left join r using (environment)) q)
    select environment, service, score, case when score >= 75 then 'CRITICAL' when score >= 55 then 'HIGH' when score >= 35 then 'MEDIUM' else 'LOW' end as grade from j"""))
def s_deploy_risk(spark, d):
    tuned = spark.createDataFrame([("view", 0.8, 2.0), ("click", 0.5, 1.5)], "service string, missing_service_dominance_threshold double, span_count_spike_multiplier double")
    s = stored(T.resolve_parents(spans(spark, d), explicit=False), "parented")  # the parents serve all three
    return K.deployment_risk(stored(base(spark, d, s), "baseline"), stored(ebase(spark, d, s), "errors"), stored(graph(spark, d, s), "graph"), events(spark, d), 720, tuned)


@query(sql("""with te as (select distinct environment, from_service as caller, to_service as callee from edges where from_service <> to_service)
    select environment, service, fingerprints, mean_spans, root_ops, coalesce(callees, '') as callees, coalesce(callers, '') as callers, coalesce(error_types, '') as error_types from
    (select environment, split_part(root_op, ':', 1) as service, count(*) as fingerprints, round(avg(span_count), 6) as mean_spans, count(distinct root_op) as root_ops from base group by 1, 2)
    left join (select environment, caller as service, string_agg(callee, ',' order by callee) as callees from te group by 1, 2) using (environment, service)
    left join (select environment, callee as service, string_agg(caller, ',' order by caller) as callers from te group by 1, 2) using (environment, service)
    left join (select environment, service, string_agg(distinct error_type, ',' order by error_type) as error_types from ebase group by 1, 2) using (environment, service)"""))
def a_service_summary(spark, d):
    return K.service_summary(graph(spark, d), base(spark, d), ebase(spark, d))


@query()
def a_noise_support(spark, d):
    b = base(spark, d).withColumn("root_op", F.regexp_replace("root_op", ":op", ":/api/v"))
    return K.noise_suggestions(B.promote(b, "2024-02-10"))


@query("select c_custkey, c_name as part from customer where not contains(c_name, '0001') and not contains('Customer#000000042', c_name)")
def j_unknown_noise(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("part"))
    return K.unknown_patterns(c, ["0001", "Customer#000000042"])
