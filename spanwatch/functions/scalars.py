"""Column expressions that the operators are made of. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of operations that mark registry traffic and health checks.
NOISE = (
    "/eureka/", "/apps/delta", "/apps/", "/register", "/peerreplication", "/v1/agent/", "/v1/health/", "/v1/catalog/", "/v1/kv/",
    "/registry/", "service_discovery", "/actuator", "/health", "/healthz", "/readyz", "/livez", "/ready", "/live", "/ping", "/status",
    "/_health", "/api/health",
)
# Operations whose errors do not count.
EXCLUDED_ERROR_OPS = (
    "GET /actuator/health", "GET /actuator/health/liveness", "GET /actuator/health/readiness", "GET /actuator/info", "GET /health",
    "GET /healthz", "GET /readyz", "GET /livez",
)
# Names of databases.
DATABASES = ("mysql", "postgres", "postgresql", "mongodb", "redis", "cassandra", "elasticsearch", "dynamo", "sqlite", "oracle", "sqlserver", "mssql", "mariadb", "cockroach")
# Error types seen while an incident runs.
INCIDENT_ERRORS = ("503", "502", "504", "java.net.ConnectException", "java.net.SocketTimeoutException", "CannotCreateTransactionException", "Connection refused", "ECONNREFUSED")
# Pipeline stages and the words that name them.
STAGES = ((0, ("local", "dev", "develop", "development")), (1, ("test", "testing", "ci", "qa")), (2, ("staging", "stage", "preprod", "pre-prod", "uat")), (3, ("prod", "production", "live")))
# Words that mark operations without a path as noise.
NOISE_WORDS = ("health", "ping", "ready", "live", "heartbeat", "status", "register", "registry", "eureka", "consul", "discover")


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    """One pattern names ``c`` once: a filter that Spark moves below a projection would work out its expression for every part anew."""
    return c.rlike("|".join(re.escape(p) for p in parts)) if parts else F.lit(False)


def filled(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def is_noise(operation: Column, extra: Sequence[str] = ()) -> Column:
    return contains_any(F.lower(operation), (*NOISE, *(x.lower() for x in extra)))


def is_error(tags: Column, profile: str = "batch", status: Column | None = None) -> Column:
    """Whether a span with these tags is an error: ``batch``, ``stream`` or ``scoring`` rules."""
    get = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    code = get("http.status_code")
    if profile == "stream":
        rule = (get("error") == "true") | (get("otel.status_code") == "ERROR")
        return rule if status is None else rule | F.coalesce(status, F.lit(False))
    named = F.lower(get("error")).isin("true", "1") | (F.upper(get("otel.status_code")) == "ERROR")
    if profile == "scoring":
        return named | code.rlike("^[45]")
    return named | (code.rlike("^[0-9]+$") & (F.coalesce(code.try_cast("bigint"), F.lit(500)) >= 500))


def error_type(tags: Column) -> Column:
    get = lambda k: filled(F.try_element_at(tags, F.lit(k)))
    return F.coalesce(get("exception.type"), get("error.type"), get("http.status_code"), F.lit("error"))


def error_op_excluded(operation: Column, profile: str = "batch") -> Column:
    return is_noise(operation) if profile == "stream" else operation.isin(*EXCLUDED_ERROR_OPS)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def fp_hash(path: Column) -> Column:
    return short_hash(path)


def sig_hash(service, error, http_status, operation, call_path) -> Column:
    return short_hash(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (service, error, http_status, operation, call_path)]))


def silent_hash(root_op: Column) -> Column:
    return short_hash(F.concat(F.lit("SILENT:"), root_op))


def query_template(statement: Column) -> Column:
    """A statement without its literals: lists after IN, quoted strings and whole numbers become ``?``."""
    t = F.regexp_replace(statement, r"(?i)\bIN\s*\([^)]+\)", "IN (?)")
    t = F.regexp_replace(F.regexp_replace(t, r"'[^']*'", "?"), r"\b\d+\b", "?")
    return F.upper(F.trim(F.regexp_replace(t, r"\s+", " ")))


def query_hash(service, db_system, template) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u0000", service, db_system, template)), 1, 16)


def service_of(root_op: Column) -> Column:
    return F.substring_index(root_op, ":", 1)


def operation_of(root_op: Column) -> Column:
    return F.regexp_replace(root_op, "^[^:]*:", "")


def event_service(dims: Column, props: Column, with_new: bool = True) -> Column:
    """The service an event is about: the first of its names that is filled."""
    d = lambda k: filled(F.try_element_at(dims, F.lit(k)))
    p = lambda k: filled(F.try_element_at(props, F.lit(k)))
    root = filled(service_of(F.coalesce(d("root_operation"), p("root_operation"), F.lit(""))))
    listed = filled(F.trim(F.substring_index(F.coalesce(p("services"), F.lit("")), ",", 1)))
    names = [d("service"), *([d("new_service"), p("new_service")] if with_new else []), root, p("service"), listed]
    return F.coalesce(*names)


def env_match(environment: Column, wanted: str | None, null_is_all: bool = True) -> Column:
    if wanted is None:
        return F.lit(True)
    return F.coalesce(environment.isin(wanted, "all"), F.lit(null_is_all))


def seasonal_slot(ts: Column) -> Column:
    return (F.dayofweek(ts) - 1) * 24 + F.hour(ts)


def path_tokens(path: Column) -> Column:
    return F.array_distinct(F.transform(F.split(path, " -> "), lambda t: F.trim(t)))


def path_edges(path: Column) -> Column:
    """Distinct ordered pairs of neighbouring tokens, as "a -> b"; a token with itself is no pair."""
    t = F.transform(F.split(path, " -> "), lambda t: F.trim(t))
    pairs = F.zip_with(t, F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.when(a != b, F.concat(a, F.lit(" -> "), b)))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def service_core(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_0-9]", "")


def pipeline_tier(environment: Column, pipeline: Sequence[str] | None = None) -> Column:
    if pipeline:
        at = F.array_position(F.array(*map(F.lit, pipeline)), environment)
        return F.when(at > 0, at - 1).otherwise(len(pipeline)).cast("int")
    low, out = F.lower(environment), F.lit(99)
    for tier, words in reversed(STAGES):
        out = F.when(contains_any(low, words), tier).otherwise(out)
    return out


def pod_to_service(pod: Column) -> Column:
    """A pod's name without its last two parts, or without the last if there are only two."""
    return F.regexp_replace(pod, "(?:-[^-]*){1,2}$", "")


def is_db_node(name: Column) -> Column:
    return name.contains(":") | contains_any(F.lower(name), DATABASES)


def is_incident_artifact(kind: Column) -> Column:
    return contains_any(F.lower(kind), [x.lower() for x in INCIDENT_ERRORS])


def noise_candidates(operation: Column) -> Column:
    """Parts of an operation that could mark it as noise."""
    parts = F.filter(F.split(operation, "/"), lambda p: p != "")
    part = lambda k: F.try_element_at(parts, F.lit(k))
    clean = F.regexp_replace(F.regexp_replace(operation, r"/\{[^}]+\}", "/{*}"), r"/[0-9]+", "/{*}")
    path = F.array(
        F.when(F.size(parts) >= 1, F.concat(F.lit("/"), part(1), F.lit("/"))), F.when(F.size(parts) >= 2, F.concat(F.lit("/"), part(1), F.lit("/"), part(2))),
        F.when((clean != operation) & (F.length(clean) > 3), clean),
    )
    words = F.filter(F.array(*[F.when(F.lower(operation).contains(w), F.lit(w)) for w in NOISE_WORDS]), lambda x: x.isNotNull())
    plain = F.when(F.size(words) > 0, words).when(F.length(operation) > 3, F.array(operation)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_compact(F.when(operation.contains("/"), path).otherwise(plain))


def fmt_ms(micros: Column) -> Column:
    ms = micros / 1000.0
    return F.when(ms >= 1000, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%.1fms", ms))


def truncate(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def classify_service(name: Column, rules: Sequence[tuple[str, str, str]], default: str = "unknown") -> Column:
    """First rule that fits: (group, "is" | "prefix" | "suffix", value)."""
    test = {"is": lambda v: name == v, "prefix": lambda v: name.startswith(v), "suffix": lambda v: name.endswith(v)}
    out = F.lit(default)
    for group, kind, value in reversed(list(rules)):
        out = F.when(test[kind](value), group).otherwise(out)
    return out
