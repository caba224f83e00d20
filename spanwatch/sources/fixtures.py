"""Span tables seen in the sales and event tables, as PySpark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEARN_UNTIL = "2024-01-21"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans without explicit parents: a user's day is a trace, an event a span."""
    e = _events(spark, sf_dir)
    error = F.col("event_type") == "error"
    kind = F.when(error & (F.col("k") % 3 == 0), "java.net.ConnectException").when(error & (F.col("k") % 3 == 1), "java.sql.SQLException").otherwise("")
    status = F.when(error & (F.col("k") % 3 == 2), "503").otherwise("200")
    statement = F.when(
        F.col("event_type").isin("purchase", "signup"),
        F.concat(F.lit("SELECT * FROM t"), F.col("k") % 4, F.lit(" WHERE id = "), F.col("event_id"), F.lit(" AND name = 'u"), F.col("user_id"), F.lit("'")),
    ).otherwise("")
    tags = F.create_map(
        F.lit("exception.type"), kind, F.lit("http.status_code"), status, F.lit("db.statement"), statement,
        F.lit("db.system"), F.when(statement != "", "mysql").otherwise(""), F.lit("error"), error.cast("string"),
    )
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "dev").when(F.col("user_id") % 3 == 1, "staging").otherwise("prod").alias("environment"),
        F.concat(F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"), F.col("event_id").cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"), F.col("event_type").alias("service"), F.concat(F.lit("op"), F.col("k") % 2).alias("operation"),
        F.unix_micros("ts").alias("start_us"), (F.round(F.col("value") * 100).cast("bigint") * 1800000).alias("duration_us"), error.alias("is_error"),
        tags.alias("tags"), F.col("ts").alias("event_time"),
    )


def chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with explicit parents: a conversation is a trace, each turn the child of the one before."""
    c = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.col("conv_id"), F.lit("-"), turn)
    return c.select(
        F.lit("chat").alias("environment"), F.col("conv_id").cast("string").alias("trace_id"), name(F.col("turn")).alias("span_id"),
        F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"), F.col("role").alias("service"), F.concat(F.lit("turn"), F.col("turn") % 2).alias("operation"),
        (F.col("turn") * 1000000).alias("start_us"), (F.length("text") * 1000).cast("bigint").alias("duration_us"), F.lit(False).alias("is_error"),
        F.expr("cast(map() as map<string,string>)").alias("tags"), F.timestamp_micros(F.col("turn") * 1000000).alias("event_time"),
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many spans: an order is a trace, each of its lines a span."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    i = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    day = F.col("l_shipdate").cast("timestamp")
    return i.select(
        F.lit("orders").alias("environment"), F.col("l_orderkey").cast("string").alias("trace_id"), F.concat(F.col("l_orderkey"), F.lit("-"), F.col("n")).alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 8).alias("service"), F.concat("l_returnflag", "l_linestatus").alias("operation"),
        F.unix_micros(day).alias("start_us"), (F.col("l_quantity").cast("bigint") * 86400000000).alias("duration_us"), (F.col("l_returnflag") == "R").alias("is_error"),
        F.expr("cast(map() as map<string,string>)").alias("tags"), day.alias("event_time"),
    )


ANOMALY_TYPES = ("NEW_FINGERPRINT", "MISSING_SERVICE", "SPAN_COUNT_SPIKE", "SPAN_COUNT_DROP", "NEW_ERROR_SIGNATURE", "SIGNATURE_SPIKE", "LATENCY_ANOMALY")


def anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly events: environment, service, tier, anomaly_type, hash, services, message, ts_ms, event_id."""
    e = _events(spark, sf_dir).where("event_type <> 'signup'")
    kind = F.element_at(F.array(*map(F.lit, ANOMALY_TYPES)), F.col("k") % 7 + 1)
    service = F.concat(F.lit("svc"), F.col("user_id") % 50)
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "dev").when(F.col("user_id") % 3 == 1, "staging").otherwise("prod").alias("environment"), service.alias("service"),
        F.concat(F.lit("tier"), 1 + F.col("k") % 3).alias("tier"), kind.alias("anomaly_type"), F.col("k").cast("string").alias("hash"),
        F.when(kind == "MISSING_SERVICE", F.concat(service, F.lit(", svc"), F.col("k") % 50)).otherwise("").alias("services"),
        F.concat(kind, F.lit(" on "), service).alias("message"), F.concat(service, F.lit(":op"), F.col("k") % 2).alias("root_op"), F.unix_millis("ts").alias("ts_ms"), "event_id",
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'signup' and k < 10")
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "dev").when(F.col("user_id") % 3 == 1, "staging").otherwise("prod").alias("environment"),
        F.concat(F.lit("svc"), F.col("user_id") % 50).alias("service"), F.concat(F.lit("v"), F.col("k")).alias("version"), F.unix_millis("ts").alias("ts_ms"), "event_id",
    )


#: The same tables as common table expressions of DuckDB SQL.
SQL = {
    "ev": "select *, cast(json_extract(props, '$.k') as int) as k, case user_id % 3 when 0 then 'dev' when 1 then 'staging' else 'prod' end as environment from events",
    "spans": """select environment, user_id || '-' || strftime(ts, '%Y%m%d') as trace_id, cast(event_id as varchar) as span_id, cast(null as varchar) as parent_id,
        event_type as service, 'op' || (k % 2) as operation, epoch_us(ts) as start_us, cast(round(value * 100) as bigint) * 1800000 as duration_us, event_type = 'error' as is_error,
        case when event_type = 'error' and k % 3 = 0 then 'java.net.ConnectException' when event_type = 'error' and k % 3 = 1 then 'java.sql.SQLException' else '' end as exception_type,
        case when event_type = 'error' and k % 3 = 2 then '503' else '200' end as http_status,
        case when event_type in ('purchase', 'signup') then 'SELECT * FROM t' || (k % 4) || ' WHERE id = ' || event_id || ' AND name = ''u' || user_id || '''' else '' end as db_statement,
        case when event_type in ('purchase', 'signup') then 'mysql' else '' end as db_system, ts as event_time from ev""",
    "chat": """select 'chat' as environment, cast(conv_id as varchar) as trace_id, conv_id || '-' || turn as span_id, case when turn > 0 then conv_id || '-' || (turn - 1) end as parent_id,
        role as service, 'turn' || (turn % 2) as operation, turn * 1000000 as start_us, length(text) * 1000 as duration_us, false as is_error from conversations""",
    "anomalies": """select environment, 'svc' || (user_id % 50) as service, 'tier' || (1 + k % 3) as tier,
        ['NEW_FINGERPRINT', 'MISSING_SERVICE', 'SPAN_COUNT_SPIKE', 'SPAN_COUNT_DROP', 'NEW_ERROR_SIGNATURE', 'SIGNATURE_SPIKE', 'LATENCY_ANOMALY'][1 + k % 7] as anomaly_type,
        cast(k as varchar) as hash, case when k % 7 = 1 then 'svc' || (user_id % 50) || ', svc' || (k % 50) else '' end as services, 'svc' || (user_id % 50) || ':op' || (k % 2) as root_op, epoch_us(ts) // 1000 as ts_ms, event_id, user_id, k
        from ev where event_type <> 'signup'""",
    "deploys": "select environment, 'svc' || (user_id % 50) as service, 'v' || k as version, epoch_us(ts) // 1000 as ts_ms, event_id from ev where event_type = 'signup' and k < 10",
}
