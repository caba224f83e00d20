"""Queries of the scalar functions, over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwatch.functions import scalars as S
from spanwatch.operators import errors as E
from spanwatch.plans.base import learn_window, spans, sql
from spanwatch.plans.registry import query
from spanwatch.sources import fixtures as X


def _like(column: str, parts) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in parts) + ")"


_PAGES = "select page_id, url, case page_id % 5 when 0 then '/health' when 1 then '/actuator/info' when 2 then '/api/items/' || page_id when 3 then '/Status' else url end as op from pages"


def _ops(spark, d):
    p = X.table(spark, d, "pages")
    k = F.col("page_id") % 5
    op = F.when(k == 0, "/health").when(k == 1, "/actuator/info").when(k == 2, F.concat(F.lit("/api/items/"), "page_id")).when(k == 3, "/Status").otherwise(F.col("url"))
    return p.select("page_id", "url", op.alias("op"))


@query(f"with p as ({_PAGES}) select page_id, {_like('lower(op)', S.NOISE)} as noise from p")
def f_is_noise_op(spark, d):
    return _ops(spark, d).select("page_id", S.is_noise(F.col("op")).alias("noise"))


@query(sql(f"select trace_id, bool_or({_like('lower(operation)', S.NOISE)}) and count(*) <= 3 as short_noise, count(*) as n from spans group by trace_id"))
def f_short_trace_noise(spark, d):
    noisy = F.max(S.is_noise(F.col("operation")))
    return spans(spark, d).groupBy("trace_id").agg((noisy & (F.count("*") <= 3)).alias("short_noise"), F.count("*").alias("n"))


_TAGS = """case when k % 4 = 0 then 'TRUE' when k % 4 = 1 then 'true' else '' end as e, case when k % 5 = 0 then 'error' when k % 5 = 1 then 'ERROR' else 'OK' end as o,
    case when k % 6 = 0 then '404' when k % 6 = 1 then '500' when k % 6 = 2 then 'x' else cast(200 + k * 5 as varchar) end as c"""


def _tagged(spark, d):
    k = F.col("k")
    e = X._events(spark, d)
    tags = F.create_map(
        F.lit("error"), F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "true").otherwise(""), F.lit("otel.status_code"), F.when(k % 5 == 0, "error").when(k % 5 == 1, "ERROR").otherwise("OK"),
        F.lit("http.status_code"), F.when(k % 6 == 0, "404").when(k % 6 == 1, "500").when(k % 6 == 2, "x").otherwise((200 + k * 5).cast("string")),
    )
    return e.select("event_id", tags.alias("tags"))


@query(sql(f"select event_id, lower(e) in ('true', '1') or upper(o) = 'ERROR' or (regexp_full_match(c, '[0-9]+') and coalesce(try_cast(c as bigint), 0) >= 500) as bad from (select *, {_TAGS} from ev)"))
def f_is_error_batch(spark, d):
    return _tagged(spark, d).select("event_id", S.is_error(F.col("tags"), "batch").alias("bad"))


@query(sql(f"select event_id, e = 'true' or o = 'ERROR' as bad from (select *, {_TAGS} from ev)"))
def f_is_error_stream(spark, d):
    return _tagged(spark, d).select("event_id", S.is_error(F.col("tags"), "stream").alias("bad"))


@query(sql(f"select event_id, lower(e) in ('true', '1') or upper(o) = 'ERROR' or c like '4%' or c like '5%' as bad from (select *, {_TAGS} from ev)"))
def f_is_error_scoring(spark, d):
    return _tagged(spark, d).select("event_id", S.is_error(F.col("tags"), "scoring").alias("bad"))


@query(sql("select span_id, coalesce(nullif(exception_type, ''), nullif(http_status, ''), 'error') as kind from spans"))
def f_error_type(spark, d):
    return spans(spark, d).select("span_id", S.error_type(F.col("tags")).alias("kind"))


@query(f"with p as ({_PAGES}) select page_id, 'GET ' || op in ({', '.join(repr(x) for x in S.EXCLUDED_ERROR_OPS)}) as batch, {_like('lower(op)', S.NOISE)} as stream from p")
def f_excluded_error_op(spark, d):
    get = F.concat(F.lit("GET "), F.col("op"))
    return _ops(spark, d).select("page_id", S.error_op_excluded(get).alias("batch"), S.error_op_excluded(get, "stream").alias("stream"))


@query("select page_id, substr(sha256(url), 1, 16) as fp, substr(sha256('SILENT:' || url), 1, 16) as silent from pages")
def f_fp_hash(spark, d):
    u = F.col("url")
    return X.table(spark, d, "pages").select("page_id", S.fp_hash(u).alias("fp"), S.silent_hash(u).alias("silent"))


@query("select page_id, substr(sha256('SILENT:' || url), 1, 16) as silent from pages")
def f_silent_hash(spark, d):
    return X.table(spark, d, "pages").select("page_id", S.silent_hash(F.col("url")).alias("silent"))


@query(sql("select span_id, sig_hash from sigs"))
def f_sig_hash(spark, d):
    return E.error_signatures(spans(spark, d)).select("span_id", "sig_hash")


_TEMPLATE = r"upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\bIN\s*\([^)]+\)', 'IN (?)', 'gi'), '''[^'']*''', '?', 'g'), '\b\d+\b', '?', 'g'), '\s+', ' ', 'g')))"


@query(sql(f"select span_id, {_TEMPLATE.format('db_statement')} as template from spans where db_statement <> ''"))
def f_query_template(spark, d):
    s = spans(spark, d).withColumn("stmt", F.element_at("tags", "db.statement")).where("stmt <> ''")
    return s.select("span_id", S.query_template(F.col("stmt")).alias("template"))


@query(sql(f"select span_id, substr(sha1(service || chr(0) || db_system || chr(0) || {_TEMPLATE.format('db_statement')}), 1, 16) as qh from spans where db_statement <> ''"))
def f_query_hash(spark, d):
    s = spans(spark, d).withColumn("stmt", F.element_at("tags", "db.statement")).where("stmt <> ''")
    return s.select("span_id", S.query_hash(F.col("service"), F.element_at("tags", "db.system"), S.query_template(F.col("stmt"))).alias("qh"))


@query(sql("select event_id, split_part(root_op, ':', 1) as service from anomalies"))
def f_service_of(spark, d):
    return X.anomaly_events(spark, d).select("event_id", S.service_of(F.col("root_op")).alias("service"))


@query(sql("select event_id, environment in ('prod', 'all') as strict, environment in ('dev', 'all') as loose from anomalies"))
def f_env_match(spark, d):
    e = F.col("environment")
    return X.anomaly_events(spark, d).select("event_id", S.env_match(e, "prod", False).alias("strict"), S.env_match(e, "dev").alias("loose"))


@query("select event_id, (dayofweek(ts) * 24 + hour(ts))::int as slot from events")
def f_seasonal_slot(spark, d):
    return X._events(spark, d).select("event_id", S.seasonal_slot(F.col("ts")).alias("slot"))


@query(sql("""select fp_hash, environment, (select coalesce(string_agg(p, ',' order by p), '') from
    (select distinct t.toks[i] || ' -> ' || t.toks[i + 1] as p from unnest(range(1, len(t.toks))) as r(i) where t.toks[i] <> t.toks[i + 1])) as e from pathsx t"""))
def f_path_edges(spark, d):
    return _base(spark, d).select("environment", "fp_hash", F.array_join(F.array_sort(S.path_edges(F.col("path"))), ",").alias("e"))


@query(sql("select environment, fp_hash, array_to_string(list_sort(list_distinct(toks)), ',') as toks from pathsx"))
def f_path_tokens(spark, d):
    return _base(spark, d).select("environment", "fp_hash", F.array_join(F.array_sort(S.path_tokens(F.col("path"))), ",").alias("toks"))


@query(sql("""select a.fp_hash, a.environment, round(len(list_intersect(list_distinct(a.toks), list_distinct(b.toks))) / len(list_distinct(list_concat(a.toks, b.toks))), 6) as j
    from pathsx a join (select environment, root_op, toks, row_number() over (partition by environment, root_op order by fp_hash) as rn from pathsx) b on a.environment = b.environment and a.root_op = b.root_op and b.rn = 1"""))
def f_jaccard(spark, d):
    b = _base(spark, d).withColumn("t", S.path_tokens(F.col("path")))
    first = b.groupBy("environment", "root_op").agg(F.min_by("t", "fp_hash").alias("u"))
    return b.join(first, ["environment", "root_op"]).select("environment", "fp_hash", F.round(S.jaccard(F.col("t"), F.col("u")), 6).alias("j"))


@query("select c_custkey, regexp_replace(lower(c_name), '[-_0-9]', '', 'g') as core from customer")
def f_service_core(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", S.service_core(F.col("c_name")).alias("core"))


@query(sql("select event_id, case environment when 'dev' then 0 when 'staging' then 2 when 'prod' then 3 end::int as tier, case environment when 'prod' then 0 when 'dev' then 1 else 2 end::int as own from ev"))
def f_pipeline_tier(spark, d):
    e = F.col("environment")
    return X.event_spans(spark, d).select(F.col("span_id").cast("bigint").alias("event_id"), S.pipeline_tier(e).alias("tier"), S.pipeline_tier(e, ["prod", "dev"]).alias("own"))


@query(r"select o_orderkey, regexp_replace(o_orderpriority || '-' || o_orderkey, '(?:-[^-]*){1,2}$', '') as svc from orders")
def f_pod_to_service(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", S.pod_to_service(F.concat_ws("-", "o_orderpriority", "o_orderkey")).alias("svc"))


@query(f"select page_id, contains(url, ':') or {_like('lower(url)', S.DATABASES)} as db, {_like('lower(html)', [x.lower() for x in S.INCIDENT_ERRORS])} as incident from pages")
def f_is_db_node(spark, d):
    return X.table(spark, d, "pages").select("page_id", S.is_db_node(F.col("url")).alias("db"), S.is_incident_artifact(F.col("html")).alias("incident"))


@query(sql(f"select span_id, {_like('lower(exception_type || http_status)', [x.lower() for x in S.INCIDENT_ERRORS])} as artifact from spans"))
def f_is_incident_artifact(spark, d):
    t = F.concat(F.element_at("tags", "exception.type"), F.element_at("tags", "http.status_code"))
    return spans(spark, d).select("span_id", S.is_incident_artifact(t).alias("artifact"))


@query(
    f"""with p as ({_PAGES}), q as (select *, list_filter(string_split(op, '/'), lambda x: x <> '') as parts, regexp_replace(regexp_replace(op, '/\\{{[^}}]+\\}}', '/{{*}}', 'g'), '/[0-9]+', '/{{*}}', 'g') as clean from p)
    select page_id, array_to_string(list_filter([case when len(parts) >= 1 then '/' || parts[1] || '/' end, case when len(parts) >= 2 then '/' || parts[1] || '/' || parts[2] end,
      case when clean <> op and length(clean) > 3 then clean end], lambda x: x is not null), ' ') as candidates from q where contains(op, '/')"""
)
def f_noise_candidates(spark, d):
    o = _ops(spark, d).where(F.col("op").contains("/"))
    return o.select("page_id", F.array_join(S.noise_candidates(F.col("op")), " ").alias("candidates"))


@query("select event_id, case when floor(value) * 10 >= 1000 then printf('%.2fs', floor(value) / 100) else printf('%.1fms', floor(value) * 10) end as ms, case when length(props) > 8 then substr(props, 1, 8) || '...' else props end as cut from events")
def f_format(spark, d):
    e = X._events(spark, d)
    return e.select("event_id", S.fmt_ms(F.floor("value") * 10000).alias("ms"), S.truncate(F.col("props"), 8).alias("cut"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'core' when starts_with(c_mktsegment, 'AUTO') then 'edge' when ends_with(c_mktsegment, 'Y') then 'data' else 'unknown' end as grp from customer")
def f_app_group(spark, d):
    rules = [("core", "is", "BUILDING"), ("edge", "prefix", "AUTO"), ("data", "suffix", "Y")]
    return X.table(spark, d, "customer").select("c_custkey", S.classify_service(F.col("c_mktsegment"), rules).alias("grp"))


@query(sql("select event_id, coalesce(nullif(case when k % 3 = 0 then event_type else '' end, ''), nullif(case when k % 3 = 1 then 'new' || k else '' end, ''), nullif(split_part(case when k % 2 = 0 then 'r' || k || ':op' else '' end, ':', 1), ''), 'listed' || k) as svc from ev"))
def f_event_service(spark, d):
    k = F.col("k")
    e = X._events(spark, d)
    dims = F.create_map(F.lit("service"), F.when(k % 3 == 0, F.col("event_type")).otherwise(""), F.lit("root_operation"), F.when(k % 2 == 0, F.concat(F.lit("r"), k, F.lit(":op"))).otherwise(""))
    props = F.create_map(F.lit("new_service"), F.when(k % 3 == 1, F.concat(F.lit("new"), k)).otherwise(""), F.lit("services"), F.concat(F.lit("listed"), k, F.lit(",other")))
    return e.select("event_id", S.event_service(dims, props).alias("svc"))


def _base(spark, d):
    from spanwatch.operators.baseline import learn_trace
    from spanwatch.operators.traces import fingerprint

    return learn_trace(learn_window(fingerprint(spans(spark, d))))
