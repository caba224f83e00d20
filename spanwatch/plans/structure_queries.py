"""Queries on trace structure, errors, baselines and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwatch.config import STREAM
from spanwatch.operators import baseline as B
from spanwatch.operators import classify as C
from spanwatch.operators import errors as E
from spanwatch.operators import traces as T
from spanwatch.plans.base import CTES, joined, learn_window, spans, sql, stored, watch_window
from spanwatch.plans.registry import query
from spanwatch.sources import fixtures as X

AS_OF = "2024-02-10"


def fps(spark, d, known=None, of=None):
    """Fingerprints of all traces; ``of`` are their spans with parents, where several steps use these."""
    return T.fingerprint(spans(spark, d) if of is None else of, known_root_ops=known)


def fps_once(spark, d):
    """The fingerprints as a table, for queries that read them more than once."""
    return stored(fps(spark, d), "fingerprints")


def learnt(spark, d, of=None):
    return learn_window(fps(spark, d, of=of))


def base(spark, d, of=None):
    return B.learn_trace(learnt(spark, d, of))


def live(spark, d):
    """The watch window's fingerprints and the baseline of the days before. All traces are fingerprinted once; those of one
    span count where the baseline knows their root op."""
    every = stored(T.fingerprint(spans(spark, d), min_spans=1), "fingerprints")
    b = stored(B.learn_trace(learn_window(every.where("span_count >= 2"))), "baseline")
    known = b.select("environment", "root_op").distinct().withColumn("known", F.lit(True))
    w = watch_window(every).join(known, ["environment", "root_op"], "left").where("span_count >= 2 or known").select(*every.columns)
    return w, b


def watched(spark, d):
    return live(spark, d)[0]


def sigs(spark, d, of=None):
    return E.error_signatures(spans(spark, d) if of is None else of)


def ebase(spark, d, of=None):
    return E.learn_error(learn_window(sigs(spark, d, of), "event_time"))


def ecounts(spark, d):
    return E.watch_counts(watch_window(sigs(spark, d), "event_time"))


def errors_once(spark, d):
    """(signatures of the watch window, error baseline of the days before): all are made once."""
    every = stored(sigs(spark, d), "signatures")
    return watch_window(every, "event_time"), stored(E.learn_error(learn_window(every, "event_time")), "errors")


def _split(d, early: bool):
    return d.where(F.col("trace_start") < F.lit("2024-01-11").cast("timestamp")) if early else d.where(F.col("trace_start") >= F.lit("2024-01-11").cast("timestamp"))


def half(spark, d, early: bool, of=None):
    """The baseline of a part of the learn window; ``of`` are all fingerprints where several steps use them."""
    return B.learn_trace(_split(learnt(spark, d) if of is None else learn_window(of), early))


def halves(spark, d):
    f = fps_once(spark, d)
    return half(spark, d, True, f), half(spark, d, False, f)


def _half_sql(name: str, test: str) -> dict[str, str]:
    """The baseline of part of the learn window as expressions named ``name``0 to ``name``."""
    fix = lambda t: t.replace("from learnt", f"from (select * from learnt where trace_start {test} timestamp '2024-01-11')").replace("base0", name + "0").replace("base1", name + "1")
    return {name + "0": fix(CTES["base0"]), name + "1": fix(CTES["base1"]), name: fix(CTES["base"])}


_A, _B = _half_sql("ba", "<"), _half_sql("bb", ">=")

# ---- joins


@query(sql("select trace_id, span_id, parent from par"))
def j_parent(spark, d):
    return T.resolve_parents(spans(spark, d), explicit=False).select("trace_id", "span_id", "parent")


@query(sql("""select c.trace_id, c.span_id, coalesce(p.span_id, (select q.span_id from chat q where q.trace_id = c.trace_id and q.span_id <> c.span_id and q.start_us <= c.start_us
    and c.start_us < q.start_us + q.duration_us order by q.duration_us, q.start_us, q.span_id limit 1)) as parent from chat c left join chat p on p.trace_id = c.trace_id and p.span_id = c.parent_id"""))
def j_parent_explicit(spark, d):
    return T.resolve_parents(X.chat_spans(spark, d), explicit=True).select("trace_id", "span_id", "parent")


@query(sql("select s.span_id, u.call_path from sigs s join sig1 u using (trace_id, span_id)"))
def j_ancestors(spark, d):
    return T.call_path(T.resolve_parents(spans(spark, d), False), 5).where("is_error").select("span_id", "call_path")


@query(sql("select trace_id, span_id, from_frame, to_frame from edges"))
def j_edges(spark, d):
    return T.trace_edges(T.resolve_parents(spans(spark, d), False)).select("trace_id", "span_id", "from_frame", "to_frame")


_CROSS = "select * from (select *, row_number() over (partition by trace_id, from_frame, to_frame order by start_us, span_id) as nth from edges where from_service <> to_service) where nth = 1"


@query(sql(f"select trace_id, span_id, from_frame, to_frame from ({_CROSS})"))
def w_first_edge(spark, d):
    return T.trace_edges(T.resolve_parents(spans(spark, d), False), STREAM).select("trace_id", "span_id", "from_frame", "to_frame")


@query(sql("select f.trace_id, f.fp_hash, b.occurrences from fps f left join base b using (environment, fp_hash)"))
def j_baseline_lookup(spark, d):
    f = fps_once(spark, d)
    return C.lookup(f, B.learn_trace(learn_window(f))).select("trace_id", "fp_hash", F.col("stored.occurrences").alias("occurrences"))


_DOM = """select e.environment, e.root_op, e.service, count(*) as variants, min(t.total) as total from (select environment, root_op, unnest(services) as service from base) e
    join (select environment, root_op, count(*) as total from base group by 1, 2) t using (environment, root_op) group by 1, 2, 3 having count(*) / min(t.total) >= 0.6"""


@query(sql(f"""select w.trace_id, w.root_op, s.variants, s.hi::int as span_max, s.lo::int as span_min, m.dominant from watch w
    left join (select environment, root_op, count(*) as variants, max(span_count_max) as hi, min(span_count_min) as lo from base group by 1, 2) s using (environment, root_op)
    left join (select environment, root_op, string_agg(service, ',' order by service) as dominant from ({_DOM}) group by 1, 2) m using (environment, root_op)"""))
def j_root_op_stats(spark, d):
    return C.with_root_stats(*live(spark, d)).select("trace_id", "root_op", "variants", "span_max", "span_min", joined("dominant"))


@query(sql(
    """with t as (select environment, root_op, fp_hash, list_distinct(string_split(path, ' -> ')) as k from base)
    select a.environment, a.root_op, a.fp_hash as hash_a, b.fp_hash as hash_b, round(len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))), 6) as similarity
    from t a join t b on a.environment = b.environment and a.root_op = b.root_op and a.fp_hash < b.fp_hash where len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) >= 0.85"""))
def j_near_dupes(spark, d):
    return B.near_duplicates(base(spark, d))


_EDGES_OF = "(select coalesce(list(distinct t[i] || ' -> ' || t[i + 1]), []) from unnest(range(1, len(t))) as r(i) where t[i] <> t[i + 1])"
_PAIRS = f"""live as (select distinct on (environment, fp_hash) environment, fp_hash, root_op, path, services, span_count from watch w where not exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash) order by environment, fp_hash, trace_start, trace_id),
    le as (select *, {_EDGES_OF} as e from (select *, string_split(path, ' -> ') as t from live)),
    be as (select environment, root_op, fp_hash as base_hash, services as base_services, {_EDGES_OF} as be, span_count as base_span_count from (select *, string_split(path, ' -> ') as t from base)),
    pr as (select *, len(list_intersect(e, be)) / greatest(1, len(list_distinct(list_concat(e, be)))) as similarity from le join be using (environment, root_op)),
    best as (select * from (select *, row_number() over (partition by environment, fp_hash order by similarity desc, base_hash) as r from pr) where r = 1)"""


@query(sql(f"select * from (with {_PAIRS} select environment, fp_hash, base_hash, round(similarity, 6) as similarity from best)"))
def j_closest_baseline(spark, d):
    return _closest(spark, d).select("environment", "fp_hash", "base_hash", F.round("similarity", 6).alias("similarity"))


def _closest(spark, d):
    return B.closest_baseline(*live(spark, d))


_DIFF = "len(list_filter({a}, lambda x: not list_contains({b}, x)))"
_SET = "array_to_string(list_sort(list_filter({a}, lambda x: not list_contains({b}, x))), ',')"


@query(sql(f"""select * from (with {_PAIRS} select environment, fp_hash, root_op, base_hash, {_DIFF.format(a='e', b='be')} as added, {_DIFF.format(a='be', b='e')} as removed, len(list_intersect(e, be)) as common,
    span_count - base_span_count as span_delta, {_SET.format(a='services', b='base_services')} as added_services, {_SET.format(a='base_services', b='services')} as removed_services, round(similarity, 6) as similarity from best)"""))
def j_fingerprint_diff(spark, d):
    x = B.diff_fingerprints(_closest(spark, d))
    return x.select(*[F.col(c).cast("bigint").alias(c) if c in ("added", "removed", "common", "span_delta") else c for c in x.columns])


@query(sql("""select environment, fp_hash, coalesce(a.root_op, b.root_op) as root_op, case when b.fp_hash is null then 'added' when a.fp_hash is null then 'removed' else 'changed' end as change
    from ba a full join bb b using (environment, fp_hash) where a.fp_hash is null or b.fp_hash is null or a.path <> b.path or a.services <> b.services""", **_A, **_B))
def j_snapshot_diff(spark, d):
    return B.snapshot_diff(*halves(spark, d))


@query(sql("""select environment, fp_hash, case when a.fp_hash is null or b.occurrences > a.occurrences then b.occurrences else a.occurrences end as occurrences,
    case when a.fp_hash is null or b.occurrences > a.occurrences then b.span_count_max else a.span_count_max end as span_count_max from ba a full join bb b using (environment, fp_hash)""", **_A, **_B))
def j_merge_trace(spark, d):
    return B.merge_trace_baselines(*halves(spark, d)).select("environment", "fp_hash", "occurrences", "span_count_max")


_EH = {n: f"select environment, sig_hash, count(*) as occurrences from sigs where event_time < timestamp '2024-01-21' and event_time {t} timestamp '2024-01-11' group by 1, 2 having count(*) >= 2" for n, t in (("ea", "<"), ("eb", ">="))}


@query(sql("select environment, sig_hash, case when a.sig_hash is null or b.occurrences > a.occurrences then b.occurrences else a.occurrences end as occurrences from ea a full join eb b using (environment, sig_hash)", **_EH))
def j_merge_error(spark, d):
    s, mid = stored(learn_window(sigs(spark, d), "event_time"), "signatures"), F.lit("2024-01-11").cast("timestamp")
    return B.merge_error_baselines(E.learn_error(s.where(F.col("event_time") < mid)), E.learn_error(s.where(F.col("event_time") >= mid))).select("environment", "sig_hash", "occurrences")


@query(sql("select environment, fp_hash, occurrences, false as auto_promoted from ba union all select environment, fp_hash, occurrences, true from bb b where not exists (select 1 from ba a where a.environment = b.environment and a.fp_hash = b.fp_hash)", **_A, **_B))
def j_merge_promoted(spark, d):
    a, b = halves(spark, d)
    return B.add_promoted(a, B.promote(b, AS_OF)).select("environment", "fp_hash", "occurrences", "auto_promoted")


_COV = """select environment, root_op, coalesce(traces, 0) as traces, coalesce(matched, 0) as matched, coalesce(traces, 0) - coalesce(matched, 0) as unmatched, coalesce(n, 0) as entries from
    (select w.environment, w.root_op, count(*) as traces, count(b.fp_hash) as matched from watch w left join base b on b.environment = w.environment and b.fp_hash = w.fp_hash group by 1, 2) l
    full join (select environment, root_op, count(*) as n from base group by 1, 2) b using (environment, root_op)"""


@query(sql(_COV))
def j_coverage(spark, d):
    return B.coverage(*live(spark, d))


_STATUS = f"select *, round(matched * 100.0 / nullif(traces, 0), 1) as pct, case when traces = 0 then 'NO_TRAFFIC' when round(matched * 100.0 / traces, 1) >= 80 then 'GOOD' when round(matched * 100.0 / traces, 1) >= 50 then 'WARN' else 'LOW' end as status from ({_COV})"


@query(sql(f"""select *, (case status when 'LOW' then 0 when 'WARN' then 1 when 'NO_TRAFFIC' then 2 else 3 end)::int as rank, case when status = 'NO_TRAFFIC' and entries > 0 then 'known but idle: extend the window or drop it'
    when status = 'NO_TRAFFIC' then 'unknown and idle: nothing to do' when pct = 0 then 'nothing matches: learn anew' when pct < 50 then 'learn over 240 minutes' when pct < 80 then 'learn over 120 minutes' else 'covered' end as advice from ({_STATUS})"""))
def s_coverage_status(spark, d):
    return B.coverage_status(B.coverage(*live(spark, d)))


# ---- aggregates


@query(sql("select environment, trace_id, fp_hash, path, root_op, array_to_string(services, ',') as services, span_count::int as span_count, edge_count::int as edge_count from fps"))
def a_fingerprint(spark, d):
    return fps(spark, d).select("environment", "trace_id", "fp_hash", "path", "root_op", joined("services"), "span_count", "edge_count")


@query(sql("""select t.trace_id, substr(sha256(coalesce(e.path, t.root)), 1, 16) as fp_hash, coalesce(e.n, 0)::int as edge_count from
    (select trace_id, arg_min(service || ':' || operation, start_us) as root, count(*) as n from chat group by 1 having count(*) >= 2) t left join
    (select trace_id, string_agg(edge, ' -> ' order by start_us) as path, count(*) as n from (select c.trace_id, min(c.start_us) as start_us, p.service || ':' || p.operation || ' -> ' || c.service || ':' || c.operation as edge
      from chat c join chat p on p.span_id = c.parent_id and p.trace_id = c.trace_id where p.service <> c.service group by c.trace_id, edge) group by 1) e using (trace_id)"""))
def a_fingerprint_stream(spark, d):
    return T.fingerprint(X.chat_spans(spark, d), STREAM).select("trace_id", "fp_hash", "edge_count")


@query(sql("select span_id, sig_hash, service, error_type, http_status, db_system, operation, call_path from sigs"))
def a_error_signatures(spark, d):
    return sigs(spark, d).select("span_id", "sig_hash", "service", "error_type", "http_status", "db_system", "operation", "call_path")


@query(sql("select environment, fp_hash, root_op, occurrences, span_count_min::int as span_count_min, span_count_max::int as span_count_max, array_to_string(services, ',') as services from base"))
def a_learn_trace(spark, d):
    return base(spark, d).select("environment", "fp_hash", "root_op", "occurrences", "span_count_min", "span_count_max", joined("services"))


@query(sql("""select environment, fp_hash, a.occurrences + n.n as occurrences, least(a.span_count_min, n.lo)::int as span_count_min from ba a join
    (select environment, fp_hash, count(*) as n, min(span_count) as lo from learnt where trace_start >= timestamp '2024-01-11' group by 1, 2) n using (environment, fp_hash)""", **_A))
def a_learn_again(spark, d):
    """A second run on a baseline, before new hashes are admitted: entries of the first that were seen again."""
    f = fps_once(spark, d)
    old = stored(half(spark, d, True, f), "baseline")
    again = B.learn_trace(_split(learn_window(f), False), prev=old, min_occurrences=2**31)
    return again.join(old.select("environment", "fp_hash"), ["environment", "fp_hash"], "left_semi").select("environment", "fp_hash", "occurrences", "span_count_min")


@query(sql("select environment, fp_hash, occurrences from base0 where occurrences > 1"))
def a_learn_bootstrap(spark, d):
    return B.learn_trace(learnt(spark, d), bootstrap=True).select("environment", "fp_hash", "occurrences")


@query(sql("select environment, sig_hash, service, error_type, operation, call_path, occurrences from ebase"))
def a_learn_error(spark, d):
    return ebase(spark, d).select("environment", "sig_hash", "service", "error_type", "operation", "call_path", "occurrences")


@query(sql("""with t as (select * from base1 where root_service in ('view', 'click')) select environment, fp_hash from t where len(list_filter(services, lambda x: x <> root_service)) > 0
    and not exists (select 1 from t r where r.environment = t.environment and list_contains(list_filter(t.services, lambda x: x <> t.root_service), r.root_service))"""))
def a_infra_only(spark, d):
    """Entries of two services that call only services which start none of these traces."""
    every = B.learn_trace(learnt(spark, d), bootstrap=True).where("occurrences >= 3 and (root_op like 'view:%' or root_op like 'click:%')")
    return every.select("environment", "fp_hash").exceptAll(B.drop_infra_only(every).select("environment", "fp_hash"))


@query(sql(_DOM))
def a_dominant_services(spark, d):
    return B.dominant_services(base(spark, d))


_AUTO = f"""select d.environment, d.root_op, bool_or(p.own is not null) as peer, string_agg(d.service, ',' order by d.service) as because from ({_DOM}) d
    left join (select environment, split_part(root_op, ':', 1) as service, sum(occurrences) as own from base group by 1, 2 having sum(occurrences) >= 9) p using (environment, service)
    where d.service <> split_part(d.root_op, ':', 1) and (p.own is not null or (d.total >= 2 and (d.total - d.variants) / d.total >= 0.2)) group by 1, 2"""


@query(sql(_AUTO))
def a_auto_no_missing(spark, d):
    return B.auto_no_missing(base(spark, d))


@query(sql("select environment, root_op, max(span_count_max)::int as span_max, min(span_count_min)::int as span_min from base group by 1, 2"))
def a_span_bounds(spark, d):
    return B.span_bounds(base(spark, d))


@query(sql("select environment, root_op, list_sort(list(span_count))[1 + floor((count(*) - 1) * 0.10)::int]::int as p10 from base group by 1, 2"))
def a_p10_span_count(spark, d):
    return B.p10_span_count(base(spark, d))


@query(sql("select environment, root_op, max(span_count)::int as max_span_count from base where occurrences >= 5 group by 1, 2"))
def a_max_span_count(spark, d):
    return B.max_span_count(base(spark, d), 5)


@query(sql("select distinct environment, root_op from base where occurrences >= 5"))
def a_established_root_ops(spark, d):
    return B.established_root_ops(base(spark, d), 5)


@query(sql("select environment, root_op, array_to_string(list_sort(list(distinct s)), ',') as services from (select environment, root_op, unnest(services) as s from base where occurrences >= 4) group by 1, 2"))
def a_services_for_root_op(spark, d):
    return B.services_for_root_op(base(spark, d), 4).select("environment", "root_op", joined("services"))


@query(sql("select environment, root_op, array_to_string(list_sort(list(distinct s)), ',') as seen from (select environment, root_op, unnest(services) as s from watch) group by 1, 2"))
def a_watch_services(spark, d):
    return C.watch_services(watched(spark, d)).select("environment", "root_op", joined("seen"))


@query(sql("select * from ecounts"))
def a_watch_counts(spark, d):
    return ecounts(spark, d)


@query(sql("select environment, root_op, count(*) as fingerprints from base group by 1, 2"))
def a_fps_per_root_op(spark, d):
    return B.fps_per_root_op(base(spark, d))


@query(sql("select environment, array_to_string(list_sort(list(distinct service)), ',') as services from spans group by 1"))
def a_environments(spark, d):
    return T.environments(spans(spark, d)).select("environment", joined("services"))


@query(sql("select distinct environment, split_part(root_op, ':', 1) as service from fps"))
def a_distinct(spark, d):
    return fps(spark, d).select("environment", F.substring_index("root_op", ":", 1).alias("service")).distinct()


@query(sql("""with g as (select s.environment, s.service, s.error_type, count(distinct s.sig_hash) as signatures, min(s.sig_hash) as representative, list_sort(list(distinct s.operation)) as o, count(distinct s.call_path) as call_paths
    from sigs s where s.event_time >= timestamp '2024-01-21' and not exists (select 1 from ebase b where b.environment = s.environment and b.sig_hash = s.sig_hash) group by 1, 2, 3)
    select environment, service, error_type, signatures, representative, array_to_string(o[1:3], ', ') || case when len(o) > 3 then ' (+' || (len(o) - 3) || ' more)' else '' end as operations, call_paths from g"""))
def a_group_new_errors(spark, d):
    now, known = errors_once(spark, d)
    return E.group_new_errors(now.join(known.select("environment", "sig_hash"), ["environment", "sig_hash"], "left_anti"))


@query(sql("""with r as (select *, db_system <> '' as db, row_number() over (partition by trace_id order by case when db_system <> '' then 0 else 1 end, start_us, span_id) as nth from par)
    select trace_id, (max(start_us + duration_us) - min(start_us)) / 1000 as duration_ms, count(*) as span_count, string_agg(distinct service, ',' order by service) as services, arg_min(frame, (start_us, span_id)) as root,
    coalesce(string_agg(frame, ',' order by frame) filter (where nth <= 2 and is_error), '') as error_spans, coalesce(string_agg(frame, ',' order by frame) filter (where nth <= 2 and db), '') as db_spans from r group by 1"""))
def a_trace_summary(spark, d):
    return T.trace_summary(spans(spark, d), 2).drop("environment")


@query(sql("""select b.environment, count(*) as fingerprints, sum(occurrences)::bigint as occurrences, count(distinct split_part(root_op, ':', 1)) as root_services, count(*) as pending, coalesce(min(e.n), 0) as signatures, coalesce(min(e.c), '') as contaminated,
    floor(epoch(timestamp '2024-02-10' - max(last_seen)) / 86400)::bigint as age_days, floor(epoch(timestamp '2024-02-10' - max(last_seen)) / 86400) > 7 as stale from base b left join
    (select environment, count(*) as n, string_agg(distinct service, ',' order by service) filter (where error_type in ('503', 'java.net.ConnectException')) as c from ebase group by 1) e on e.environment = b.environment group by 1"""))
def a_baseline_summary(spark, d):
    return B.baseline_summary(base(spark, d), ebase(spark, d), AS_OF)


# ---- decisions

_DECIDE = f"""dom as (select environment, root_op, list(service) as dominant from ({_DOM}) group by 1, 2),
    st as (select environment, root_op, max(span_count_max) as hi, min(span_count_min) as lo, list_distinct(flatten(list(services))) as svc from base group by 1, 2),
    ws as (select environment, root_op, list_distinct(flatten(list(services))) as seen from watch group by 1, 2),
    dc as (select w.*, split_part(w.root_op, ':', 1) as service, b.occurrences, st.hi, st.lo, st.svc, ws.seen, list_sort(list_filter(coalesce(dom.dominant, []), lambda x: not list_contains(w.services, x))) as missing
      from watch w left join base b on b.environment = w.environment and b.fp_hash = w.fp_hash left join st on st.environment = w.environment and st.root_op = w.root_op
      left join dom on dom.environment = w.environment and dom.root_op = w.root_op left join ws on ws.environment = w.environment and ws.root_op = w.root_op),
    vd as (select *, case when occurrences is null then case when len(missing) > 0 then case when len(list_filter(missing, lambda x: not list_contains(seen, x))) = 0 then 'OVERRIDE' else 'MISSING_SERVICE' end else 'NEW_FINGERPRINT' end
      when len(list_filter(services, lambda x: not list_contains(svc, x))) > 0 then 'NEW_SERVICE' when hi > 0 and span_count > hi * 2 then 'SPAN_COUNT_SPIKE' when lo >= 4 and span_count < lo * 0.5 then 'SPAN_COUNT_DROP'
      when len(missing) > 0 then case when len(list_filter(missing, lambda x: not list_contains(seen, x))) = 0 then 'OVERRIDE' else 'MISSING_SERVICE' end end as verdict from dc)"""


@query(sql(f"select * from (with {_DECIDE} select environment, trace_id, fp_hash, root_op, service, verdict as anomaly_type, case when verdict = 'MISSING_SERVICE' then array_to_string(missing, ',') else '' end as missing_services, span_count::int as span_count from vd where verdict is not null and verdict <> 'OVERRIDE')"))
def d_trace_anomaly(spark, d):
    return C.classify_traces(*live(spark, d)).drop("trace_start")


@query(sql(f"select * from (with {_DECIDE} select environment, root_op, count(*) as traces, array_to_string(list_sort(list_distinct(flatten(list(missing)))), ',') as optional_services from vd where verdict = 'OVERRIDE' group by 1, 2)"))
def d_optional_path(spark, d):
    return C.override_suggestions(*live(spark, d))


@query(sql(f"select * from (with {_DECIDE} select environment, fp_hash, trace_id, verdict as anomaly_type from (select *, row_number() over (partition by environment, fp_hash order by trace_start, trace_id) as r from vd where verdict is not null and verdict <> 'OVERRIDE') where r = 1)"))
def w_first_per_hash(spark, d):
    return C.first_per_hash(C.classify_traces(*live(spark, d))).select("environment", "fp_hash", "trace_id", "anomaly_type")


_LAST_DAY = "timestamp '2024-01-30 18:00:00'"


@query(sql(f"""select g.environment, g.root_op, substr(sha256('SILENT:' || g.root_op), 1, 16) as fp_hash, m.missing_services, g.occurrences from
    (select b.environment, b.root_op, sum(b.occurrences)::bigint as occurrences, bool_and(len(list_filter(services, lambda x: x <> root_service)) > 0 and not exists (select 1 from base r where r.environment = b.environment and list_contains(list_filter(b.services, lambda x: x <> b.root_service), r.root_service))) as infra
     from base b group by 1, 2) g join (select environment, root_op, string_agg(service, ',' order by service) as missing_services from ({_DOM}) group by 1, 2) m using (environment, root_op)
    where g.occurrences >= 4 and not g.infra and not exists (select 1 from watch w where w.environment = g.environment and w.root_op = g.root_op and w.trace_start >= {_LAST_DAY})"""))
def d_silent_root_op(spark, d):
    w, b = live(spark, d)
    return C.silent_root_ops(w.where(F.col("trace_start") >= F.lit("2024-01-30 18:00:00").cast("timestamp")), b)


@query(sql("select * from (select c.environment, c.sig_hash, c.service, c.n, b.occurrences, case when b.sig_hash is null then 'NEW_ERROR_SIGNATURE' when b.occurrences >= 5 and c.n > b.occurrences * 0.3 then 'SIGNATURE_SPIKE' end as anomaly_type from ecounts c left join ebase b using (environment, sig_hash)) where anomaly_type is not null"))
def d_error_anomaly(spark, d):
    now, known = errors_once(spark, d)
    return E.classify_errors(E.watch_counts(now), known, learn_runs=10)


@query(sql(
    """with s as (select environment, sig_hash, service, occurrences, occurrences / sum(occurrences) over (partition by environment, service) as share from ebase)
    select environment, sig_hash, service, occurrences, round(share, 9) as share from s where share >= 0.002 and not exists (select 1 from ecounts c where c.environment = s.environment and c.sig_hash = s.sig_hash)
    and (not exists (select 1 from ecounts c where c.environment = s.environment) or exists (select 1 from ecounts c where c.environment = s.environment and c.service = s.service))"""))
def d_error_vanished(spark, d):
    now, known = errors_once(spark, d)
    v = E.vanished_signatures(known, stored(E.watch_counts(now), "counts"), 0.002)
    return v.withColumn("share", F.round("share", 9))


_P10 = "select environment, root_op, list_sort(list(span_count))[1 + floor((count(*) - 1) * 0.10)::int] as p10 from base group by 1, 2"


@query(sql(f"select w.environment, w.trace_id, w.fp_hash from watch w left join ({_P10}) p using (environment, root_op) where exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash) or w.span_count >= coalesce(p.p10, 0)"))
def d_partial_guard(spark, d):
    return C.drop_partial(*live(spark, d)).select("environment", "trace_id", "fp_hash")


_STREAM = f"select w.environment, w.trace_id, w.fp_hash, w.root_op, 'NEW_FINGERPRINT' as anomaly_type, w.trace_start from watch w left join ({_P10}) p using (environment, root_op) where not exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash) and w.span_count >= coalesce(p.p10, 0)"


@query(sql(f"select environment, trace_id, fp_hash, root_op, anomaly_type from ({_STREAM})"))
def d_stream_structure(spark, d):
    return C.classify_traces_stream(*live(spark, d))


@query(sql("""select f.environment, f.fp_hash, epoch_us(min(f.trace_start)) as restored_us, count(*) as traces from fps f join (select environment, fp_hash, min(trace_start) as t from learnt where trace_start < timestamp '2024-01-11' group by 1, 2) d using (environment, fp_hash)
    where f.trace_start > d.t and exists (select 1 from bb b where b.environment = f.environment and b.fp_hash = f.fp_hash) group by 1, 2""", **_B))
def d_restored(spark, d):
    f = fps_once(spark, d)
    r = C.restored(f, _split(learn_window(f), True), half(spark, d, False, f))
    return r.select("environment", "fp_hash", F.unix_micros("restored_at").alias("restored_us"), "traces")


@query(sql("""with g as (select environment, root_op, trace_start, floor((epoch_us(coalesce(lead(trace_start) over (partition by environment, root_op order by trace_start, trace_id), timestamp '2024-02-10')) - epoch_us(trace_start)) / 1000000)::bigint as silence_s
    from fps f where exists (select 1 from base b where b.environment = f.environment and b.root_op = f.root_op and not (len(list_filter(b.services, lambda x: x <> b.root_service)) > 0
      and not exists (select 1 from base r where r.environment = b.environment and list_contains(list_filter(b.services, lambda x: x <> b.root_service), r.root_service))))) select environment, root_op, epoch_us(trace_start) as last_us, silence_s from g where silence_s >= 4 * 10800"""))
def d_missing_stream(spark, d):
    f = fps_once(spark, d)
    m = C.missing_root_ops(f, B.learn_trace(learn_window(f)), 10800, AS_OF)
    return m.select("environment", "root_op", F.unix_micros("last_seen").alias("last_us"), "silence_s")


# ---- upkeep


@query(sql("""with n as (select distinct environment, fp_hash from watch w where not exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash)),
    m as (select distinct environment, sig_hash from sigs s where event_time >= timestamp '2024-01-21' and not exists (select 1 from ebase b where b.environment = s.environment and b.sig_hash = s.sig_hash))
    select 'trace' as kind, environment, fp_hash as hash, coalesce(b.occurrences, 1) as occurrences, (case when n.fp_hash is null then 0 else 1 end)::int as watch_hits, n.fp_hash is not null as auto_promoted from base b full join n using (environment, fp_hash)
    union all select 'error', environment, sig_hash, coalesce(b.occurrences, 1), (case when m.sig_hash is null then 0 else 1 end)::int, m.sig_hash is not null from ebase b full join m using (environment, sig_hash)"""))
def b_watch_hits(spark, d):
    w, b = live(spark, d)
    new = w.join(b.select("environment", "fp_hash"), ["environment", "fp_hash"], "left_anti")
    t = B.apply_watch_hits(b, new, AS_OF, threshold=1).select(F.lit("trace").alias("kind"), "environment", F.col("fp_hash").alias("hash"), "occurrences", "watch_hits", "auto_promoted")
    now, known = errors_once(spark, d)
    fresh = now.join(known.select("environment", "sig_hash"), ["environment", "sig_hash"], "left_anti")
    e = E.apply_watch_hits(known, fresh, AS_OF, threshold=1)
    return t.unionByName(e.select(F.lit("error").alias("kind"), "environment", F.col("sig_hash").alias("hash"), "occurrences", "watch_hits", "auto_promoted"))


@query(sql("""select environment, fp_hash, min(root_op) as root_op, count(*) as detections, 1 as occurrences, not starts_with(min(root_op), 'view') as no_missing_service from watch w
    where not exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash) group by 1, 2 having count(*) >= 2 or min(trace_start) < timestamp '2024-01-23'"""))
def b_promote_stream(spark, d):
    return B.promote_by_count(*live(spark, d), 2, "view", "2024-01-23")


@query(sql("select environment, fp_hash, starts_with(root_op, 'view') as auto_promoted, case when starts_with(root_op, 'view') then 1707523200000000 end as promoted_us from base where starts_with(root_op, 'view')"))
def b_promote_manual(spark, d):
    p = B.promote(base(spark, d).where("root_op like 'view%'"), AS_OF)
    return p.select("environment", "fp_hash", "auto_promoted", F.unix_micros("promoted_at").alias("promoted_us"))


@query(sql("select environment, fp_hash, case when a >= 22 then greatest(floor(occurrences / 2), 1)::bigint else occurrences end as occurrences from (select *, floor((epoch_us(timestamp '2024-02-12') - epoch_us(last_seen)) / 86400000000) as a from base) where a < 25"))
def b_decay(spark, d):
    return B.decay(base(spark, d), "2024-02-12", 22, 25).select("environment", "fp_hash", "occurrences")


@query(sql(f"select b.environment, b.fp_hash, a.root_op is not null as no_missing_service from base b left join ({_AUTO}) a using (environment, root_op)"))
def b_overrides(spark, d):
    b = base(spark, d)
    flags = B.auto_no_missing(b).select("environment", "root_op", F.lit(True).alias("no_missing_service"))
    return B.apply_overrides(b, flags).select("environment", "fp_hash", "no_missing_service")


@query(sql(f"select environment, root_op, environment <> 'dev' as no_missing_service from ({_AUTO}) where environment <> 'prod'"))
def b_override_edit(spark, d):
    flags = B.auto_no_missing(base(spark, d)).select("environment", "root_op", F.lit(True).alias("no_missing_service"))
    edited = B.set_override(flags, flags.where("environment = 'dev'").withColumn("no_missing_service", F.lit(False)))
    return B.clear_override(edited, flags.where("environment = 'prod'"))


@query(sql("""select b.environment, b.fp_hash, b.occurrences, true as auto_promoted from (select *, split_part(root_op, ':', 1) as rs from base0) b where len(list_filter(services, lambda x: x <> rs)) = 0 or exists
    (select 1 from base0 r where r.environment = b.environment and list_contains(list_filter(b.services, lambda x: x <> b.rs), split_part(r.root_op, ':', 1)))"""))
def b_bootstrap_stream(spark, d):
    return B.bootstrap_baseline(learnt(spark, d)).select("environment", "fp_hash", "occurrences", "auto_promoted")


@query(sql("select environment, fp_hash, count(*) as n from watch w where not exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash) group by 1, 2"))
def b_prune_seen(spark, d):
    w, b = live(spark, d)
    return B.prune_seen(w.groupBy("environment", "fp_hash").agg(F.count("*").alias("n")), b)


@query(sql("select environment, fp_hash from base where occurrences >= 4"))
def b_auto_fix(spark, d):
    return B.auto_fix(base(spark, d).withColumn("occurrences", F.col("occurrences") - 2)).select("environment", "fp_hash")


@query(sql("select environment, warning from (select environment, unnest(['stale', 'contaminated', 'pending']) as warning from (select distinct environment from base))"))
def b_health_brief(spark, d):
    return B.health_brief(B.baseline_summary(base(spark, d), ebase(spark, d), AS_OF))


# ---- sorts, sets, scans


@query(sql("select trace_id, string_agg(span_id, ',' order by start_us, span_id) as ids from spans group by 1"))
def t_spans_by_start(spark, d):
    return T.ordered_spans(spans(spark, d)).select("trace_id", F.array_join(F.transform("spans", lambda s: s["span_id"]), ",").alias("ids"))


@query(sql("select environment, fp_hash, root_op, occurrences from base order by root_op, occurrences desc, fp_hash"))
def t_order_patterns(spark, d):
    return B.list_patterns(base(spark, d)).select("environment", "fp_hash", "root_op", "occurrences")


@query(sql("select environment, fp_hash, case when b.fp_hash is null then 'added' when a.fp_hash is null then 'removed' else 'both' end as side from (select distinct environment, fp_hash, fp_hash as h from ba) a full join (select distinct environment, fp_hash, fp_hash as h from bb) b using (environment, fp_hash)".replace("b.fp_hash is null", "b.h is null").replace("a.fp_hash is null", "a.h is null"), **_A, **_B))
def set_hash_diff(spark, d):
    return B.hash_diff(*halves(spark, d))


@query(sql("""select environment, fp_hash, array_to_string(list_sort(list_filter(services, lambda x: x not in ('view', 'click'))), ',') as less, array_to_string(list_sort(list_distinct(list_concat(services, ['view', 'click']))), ',') as u,
    len(list_filter(services, lambda x: x not in ('view', 'click'))) = 0 as sub, len(list_intersect(services, ['view', 'click'])) = 0 as apart from base"""))
def set_services(spark, d):
    s, o = F.col("services"), F.array(F.lit("view"), F.lit("click"))
    return base(spark, d).select("environment", "fp_hash", joined(F.array_sort(F.array_except(s, o)), "less"), joined(F.array_sort(F.array_union(s, o)), "u"), (F.size(F.array_except(s, o)) == 0).alias("sub"), (~F.arrays_overlap(s, o)).alias("apart"))


@query(sql("""select environment, fp_hash, array_to_string(list_sort(list_concat(list_filter(services, lambda x: x not in ('view', 'click')), list_filter(['view', 'click'], lambda x: not list_contains(services, x)))), ',') as s from base"""))
def set_symmetric(spark, d):
    s, o = F.col("services"), F.array(F.lit("view"), F.lit("click"))
    return base(spark, d).select("environment", "fp_hash", joined(F.array_sort(F.array_union(F.array_except(s, o), F.array_except(o, s))), "s"))


_SCAN = "select environment, trace_id, min(event_time) as t from spans where event_time >= timestamp '2024-01-05' and event_time < timestamp '2024-01-25' and environment = 'prod' group by 1, 2 having bool_or(service in ('error', 'signup')) order by t desc, trace_id limit 200"


@query(sql(f"select environment, trace_id, epoch_us(t) as start_us from ({_SCAN})"))
def src_window_scan(spark, d):
    return T.scan_traces(spans(spark, d), ["error", "signup"], "2024-01-05", "2024-01-25", "prod", 200).select("environment", "trace_id", F.unix_micros("trace_start").alias("start_us"))


@query(sql(f"select environment, trace_id from ({_SCAN.replace('limit 200', 'limit 20')})"))
def t_limit_traces(spark, d):
    return T.scan_traces(spans(spark, d), ["error", "signup"], "2024-01-05", "2024-01-25", "prod", 20).select("environment", "trace_id")


@query(sql("select distinct environment, trace_id from (select environment, trace_id, row_number() over (partition by service order by min(event_time) desc, trace_id) as r from spans group by environment, trace_id, service) where r <= 200"))
def src_per_service_quota(spark, d):
    return T.sample_per_service(spans(spark, d), 200)


@query(sql("select trace_id, span_id from spans s where exists (select 1 from spans e where e.trace_id = s.trace_id and e.is_error)"))
def src_error_traces(spark, d):
    return T.scan_error_traces(spans(spark, d)).select("trace_id", "span_id")


@query(sql("select b.environment, b.fp_hash, case when b.environment = 'dev' then 0.9 else 0.6 end as limit_value from base b"))
def src_thresholds(spark, d):
    b = stored(base(spark, d), "baseline")
    t = b.select("environment").distinct().where("environment = 'dev'").select(F.col("environment").alias("service"), F.lit(0.9).alias("missing_service_dominance_threshold"))
    out = B.with_threshold(b, t, "missing_service_dominance_threshold", 0.6, "environment")
    return out.select("environment", "fp_hash", F.col("missing_service_dominance_threshold").alias("limit_value"))


@query(sql("""select environment, split_part(root_op, ':', 1) as service, state, count(*) as n from (
    select distinct w.environment, w.root_op, w.fp_hash, case when exists (select 1 from base b where b.environment = w.environment and b.root_op = w.root_op) then 'drifted' else 'new' end as state from watch w where not exists (select 1 from base b where b.environment = w.environment and b.fp_hash = w.fp_hash)
    union all select distinct b.environment, b.root_op, '', 'vanished' from base b where not exists (select 1 from watch w where w.environment = b.environment and w.root_op = b.root_op)) group by 1, 2, 3"""))
def s_drift_report(spark, d):
    return B.drift_report(*live(spark, d))


@query(sql("""select b.environment, floor((epoch_us(timestamp '2024-02-10') - epoch_us(b.loaded)) / 3600000000)::bigint as age_h, count(*) as promotions from (select environment, max(last_seen) as loaded from base group by 1) b
    join watch w on w.environment = b.environment and w.trace_start > b.loaded where not exists (select 1 from base x where x.environment = w.environment and x.fp_hash = w.fp_hash) group by 1, 2"""))
def d_stale_baseline(spark, d):
    w, b = live(spark, d)
    loaded = b.groupBy("environment").agg(F.max("last_seen").alias("loaded_at"))
    found = w.join(b.select("environment", "fp_hash"), ["environment", "fp_hash"], "left_anti").select("environment", F.col("trace_start").alias("ts"))
    return B.stale_baseline(loaded, found, AS_OF)
