"""Shared steps of the registered queries, in PySpark and as common table expressions of DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwatch.lineage import shared_path, stored  # noqa: F401
from spanwatch.sources import fixtures as X

CTES = dict(X.SQL)
CTES["held"] = """select s.trace_id, s.span_id, p.span_id as pid, row_number() over (partition by s.trace_id, s.span_id order by p.duration_us, p.start_us, p.span_id) as rn
    from spans s join spans p on s.trace_id = p.trace_id and s.span_id <> p.span_id and p.start_us <= s.start_us and s.start_us < p.start_us + p.duration_us"""
CTES["par"] = "select s.*, h.pid as parent, s.service || ':' || s.operation as frame from spans s left join (select * from held where rn = 1) h using (trace_id, span_id)"
CTES["roots"] = "select * from (select trace_id, frame as root_op, row_number() over (partition by trace_id order by parent is not null, start_us, span_id) as rn from par) where rn = 1"
CTES["edges"] = "select c.environment, c.trace_id, c.span_id, c.start_us, c.event_time, p.service as from_service, c.service as to_service, p.frame as from_frame, c.frame as to_frame from par c join par p on c.trace_id = p.trace_id and c.parent = p.span_id"
CTES["paths"] = "select trace_id, string_agg(from_frame || ' -> ' || to_frame, ' -> ' order by start_us, span_id) as edges, count(*) as edge_count from edges group by trace_id"
CTES["fps1"] = """select t.environment, t.trace_id, substr(sha256(coalesce(p.edges, r.root_op)), 1, 16) as fp_hash, coalesce(p.edges, r.root_op) as path, r.root_op, t.services,
    t.span_count, coalesce(p.edge_count, 0) as edge_count, t.trace_start from
    (select environment, trace_id, list_sort(list(distinct service)) as services, count(*) as span_count, min(event_time) as trace_start from spans group by 1, 2) t
    join roots r using (trace_id) left join paths p using (trace_id)"""
CTES["fps"] = "select * from fps1 where span_count >= 2"
CTES["learnt"] = f"select * from fps where trace_start < timestamp '{X.LEARN_UNTIL}'"
CTES["base0"] = """select environment, fp_hash, min(path) as path, arg_min(root_op, (trace_start, trace_id)) as root_op, arg_min(services, (trace_start, trace_id)) as services, arg_min(span_count, (trace_start, trace_id)) as span_count, min(span_count) as span_count_min, max(span_count) as span_count_max,
    min(edge_count) as edge_count, count(*) as occurrences, min(trace_start) as first_seen, max(trace_start) as last_seen from learnt group by 1, 2"""
CTES["base1"] = "select *, split_part(root_op, ':', 1) as root_service from base0 where occurrences >= 3"
CTES["base"] = """select b.* from base1 b where len(list_filter(services, lambda x: x <> root_service)) = 0
    or exists (select 1 from base1 r where r.environment = b.environment and list_contains(list_filter(b.services, lambda x: x <> b.root_service), r.root_service))"""
CTES["watch"] = f"select * from fps1 f where trace_start >= timestamp '{X.LEARN_UNTIL}' and (span_count >= 2 or exists (select 1 from base b where b.environment = f.environment and b.root_op = f.root_op))"
CTES["sig1"] = """with recursive up(trace_id, span_id, node, depth, call_path) as (
    select trace_id, span_id, parent, 0, '' from par where is_error
    union all select u.trace_id, u.span_id, p.parent, u.depth + 1, case when u.call_path = '' then p.frame else p.frame || ' -> ' || u.call_path end from up u join par p on p.trace_id = u.trace_id and p.span_id = u.node where u.depth < 5)
    select trace_id, span_id, arg_max(call_path, depth) as call_path from up group by 1, 2"""
CTES["sigs"] = """select *, substr(sha256(service || '|' || error_type || '|' || http_status || '|' || operation || '|' || call_path), 1, 16) as sig_hash from
    (select p.environment, p.trace_id, p.span_id, p.service, coalesce(nullif(p.exception_type, ''), nullif(p.http_status, ''), 'error') as error_type, p.http_status, p.db_system, p.operation, u.call_path, p.event_time
     from par p join sig1 u using (trace_id, span_id) where p.is_error)"""
CTES["ebase"] = f"select environment, sig_hash, min(service) as service, min(error_type) as error_type, min(operation) as operation, min(call_path) as call_path, count(*) as occurrences, min(event_time) as first_seen from sigs where event_time < timestamp '{X.LEARN_UNTIL}' group by 1, 2 having count(*) >= 2"
CTES["ecounts"] = f"select environment, sig_hash, service, count(*) as n from sigs where event_time >= timestamp '{X.LEARN_UNTIL}' group by 1, 2, 3"
CTES["pathsx"] = "select *, string_split(path, ' -> ') as toks from base"

_HEAVY = {"spans", "par", "fps1", "edges", "base", "watch", "sigs", "anomalies"}


def sql(select: str, **more: str) -> str:
    """A statement over the shared expressions (and ``more``, which may use them)."""
    parts = [f"{n} as {'materialized ' if n in _HEAVY else ''}({b})" for n, b in (CTES | more).items()]
    body = f"select * from ({select})" if select.lstrip().startswith("with ") else select
    return "with recursive " + ",\n".join(parts) + "\n" + body


def spike_sql(sigs: str, window_us: str, least: int, times: int, known: str = "") -> str:
    """Error spikes by lists of a signature's events in order: those of twice the window before each of them, and the rate of their older half
    where it first is one."""
    return sql(f"""with l as (select environment, sig_hash, span_id, epoch_us(event_time) as ts, row_number() over w as rn, list(epoch_us(event_time)) over (w rows unbounded preceding) as every
      from {sigs} s {known} window w as (partition by environment, sig_hash order by epoch_us(event_time), trace_id, span_id)),
    h as (select * exclude (every), list_filter(every, lambda x: x > ts - 2 * {window_us}) as held, len(list_filter(every, lambda x: x > ts - {window_us})) / ({window_us} / 60000000.0) as per_min from l),
    f as (select environment, sig_hash, rn as from_rn, half / ((held[half] - held[1]) / 60000000.0) as base_rate from (select *, len(held) // 2 as half from h)
      where len(held) >= {least} and half >= 2 and held[half] > held[1] qualify row_number() over (partition by environment, sig_hash order by rn) = 1)
    select environment, sig_hash, ts as ts_us, round(per_min, 9) as per_min, round(base_rate, 9) as base_rate from h join f using (environment, sig_hash) where rn >= from_rn and per_min >= base_rate * {times}""")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.event_spans(spark, sf_dir)


def learn_window(df: DataFrame, column: str = "trace_start") -> DataFrame:
    return df.where(F.col(column) < F.lit(X.LEARN_UNTIL).cast("timestamp"))


def watch_window(df: DataFrame, column: str = "trace_start") -> DataFrame:
    return df.where(F.col(column) >= F.lit(X.LEARN_UNTIL).cast("timestamp"))


def joined(column: str, alias: str | None = None, sep: str = ","):
    return F.array_join(column, sep).alias(alias or column)
