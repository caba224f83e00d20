"""Structure of traces: parents, edges, call paths and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.config import BATCH, DEFAULTS, Profile
from spanwatch.functions import scalars as S
from spanwatch.lineage import stored

TRACE = ["environment", "trace_id"]
SHORT = 64  # spans of a trace that is worked on inside one row


def by_length(spans: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(short, long): traces of at most ``most`` spans (``SHORT``), a row each (environment, trace_id, spans: an array of the other columns), and
    the spans of longer ones, None if there are none.

    A short trace is shuffled once and then takes ``most`` steps a span at most; long ones go through sweeps and joins, whose rows no task has to
    hold together. Spans without environment or trace id count as long."""
    most, keys = SHORT if most is None else most, [F.col(c) for c in TRACE]
    sizes = spans.groupBy(*TRACE).agg(F.count("*").alias("n"))
    long = stored(sizes.where((F.col("n") > most) | keys[0].isNull() | keys[1].isNull()).select(keys[0].alias("long_environment"), keys[1].alias("long_trace")), "long-traces")
    rest = F.struct(*[c for c in spans.columns if c not in TRACE])
    gathered = lambda df: df.groupBy(*TRACE).agg(F.collect_list(rest).alias("spans"))
    if long.isEmpty():
        return gathered(spans), None
    same = keys[0].eqNullSafe(F.col("long_environment")) & keys[1].eqNullSafe(F.col("long_trace"))
    return gathered(spans.join(long, same, "left_anti")), stored(spans.join(long, same, "left_semi"), "long-spans")


def _placed(short: DataFrame, fields: list[str], explicit: bool) -> DataFrame:
    """``short`` with each of its spans' ``fields`` and ``parent``, which they may have already, by the rule of :func:`resolve_parents`."""

    def parent(s):
        if "parent" in fields:
            return s["parent"]
        holds = lambda p: (p["span_id"] != s["span_id"]) & (p["start_us"] <= s["start_us"]) & (s["start_us"] < p["start_us"] + p["duration_us"])
        order = F.transform(F.filter("spans", holds), lambda p: F.struct(p["duration_us"], p["start_us"], p["span_id"].alias("id")))
        held = F.array_min(order)["id"]
        return F.coalesce(F.when(F.exists("spans", lambda p: p["span_id"] == s["parent_id"]), s["parent_id"]), held) if explicit else held

    kept = [c for c in fields if c != "parent"]
    return short.withColumn("spans", F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in kept], parent(s).alias("parent"))))


def _above(name):
    """The span of the row's trace that ``name`` is the id of, null if there is none."""
    return F.try_element_at(F.filter("spans", lambda p: p["span_id"] == name), F.lit(1))


def short_traces(short: DataFrame, fields: list[str], explicit: bool) -> DataFrame:
    """``short`` (of :func:`by_length`) with its spans in order of start, each with ``parent`` and ``frame``. ``fields`` are theirs."""
    t = _placed(short, fields, explicit)  # further columns of ``short`` stay
    first = ["start_us", "span_id"]
    rest = [*(c for c in fields if c not in (*first, "parent")), "parent"]
    framed = lambda s: F.struct(*[s[c].alias(c) for c in (*first, *rest)], F.concat_ws(":", s["service"], s["operation"]).alias("frame"))
    return t.withColumn("spans", F.array_sort(F.transform("spans", framed)))


def short_call_paths(placed: DataFrame, wanted, frames: int) -> DataFrame:
    """(environment, trace_id, s, call_path): the spans ``s`` of ``placed`` (of :func:`short_traces`) that ``wanted(s)`` tells, by the rule of
    :func:`call_path`."""
    out, up = placed.select(*TRACE, "spans", F.explode(F.filter("spans", wanted)).alias("s")), "s"
    names = [f"above{n}" for n in range(frames)]
    for name in names:
        out = out.withColumn(name, _above(F.col(up)["parent"]))
        up = name
    return out.select(*TRACE, "s", F.concat_ws(" -> ", *[F.col(n)["frame"] for n in reversed(names)]).alias("call_path"))


def shortest_holders(spans: DataFrame) -> DataFrame:
    """(environment, trace_id, span_id, held): for each span that another one of its trace holds (start included, end not), the shortest of
    these (ties: earlier start, then span id). Span ids are unique in a trace.

    A sweep over starts and ends numbers the starts of a trace, so a span holds one run of numbers. Each run is cut into at most two aligned blocks
    for each power of two; of the spans that own a block only the shortest counts, and a span looks at the blocks around its own number.
    A trace of n spans takes n log n rows, however deep it nests, where a join of all with all takes n^2."""
    kinds = F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("kind")), F.struct((F.col("start_us") + F.col("duration_us")).alias("t"), F.lit(0).alias("kind")))
    events = spans.select(*TRACE, "span_id", "start_us", "duration_us", F.inline(kinds))
    swept = Window.partitionBy(*TRACE).orderBy("t", "kind", "span_id").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("starts", F.sum("kind").over(swept))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("starts")))
    runs = events.groupBy(*TRACE, "span_id").agg(F.min("start_us").alias("start_us"), F.min("duration_us").alias("duration_us"), (one(1) - 1).alias("own"), one(0).alias("until"))
    whole, equal = Window.partitionBy(*TRACE), Window.partitionBy(*TRACE, "start_us")
    runs = runs.withColumns({"from": F.min("own").over(equal), "last": F.max("own").over(whole)})
    # a run without the span's own number is two; of each power of two the blocks that no larger one takes in
    level = lambda n: F.explode(F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int")))
    sized = runs.where("until - `from` > 1").withColumn("level", level(F.expr("until - `from`")))
    up = lambda c: F.expr(f"shiftright({c} + shiftleft(1L, level) - 1, level)")
    down = lambda c: F.expr(f"shiftright({c}, level)")
    ends = sized.withColumns({"a1": up("`from`"), "b1": down("own"), "a2": up("own + 1"), "b2": down("until")})
    block = lambda at, a, b, edge: F.struct(F.expr(at).alias("block"), F.expr(f"{a} < {b} and {edge} % 2 = 1").alias("is_owned"))
    four = F.array(block("a1", "a1", "b1", "a1"), block("b1 - 1", "a1", "b1", "b1"), block("a2", "a2", "b2", "a2"), block("b2 - 1", "a2", "b2", "b2"))
    owned = ends.select(*TRACE, "level", "duration_us", "start_us", "span_id", F.inline(four)).where("is_owned")
    shortest = owned.groupBy(*TRACE, "level", "block").agg(F.min(F.struct("duration_us", "start_us", "span_id")).alias("span"))
    asked = runs.where("last > 0").withColumn("level", level(F.col("last") + 1)).select(*TRACE, F.col("span_id").alias("asks"), "level", down("own").alias("block"))
    held = asked.join(shortest, [*TRACE, "level", "block"]).groupBy(*TRACE, F.col("asks").alias("span_id")).agg(F.min("span").alias("span"))
    return held.select(*TRACE, "span_id", F.col("span.span_id").alias("held"))


def resolve_parents(spans: DataFrame, explicit: bool = True) -> DataFrame:
    """``spans`` with ``parent``: the explicit parent if it is in the trace (``explicit``), else the shortest
    other span of the trace that holds the span's start (ties: earlier start, then span id); null if none.

    Spans that have the column already stay as they are, so a table of them serves several operators."""
    if "parent" in spans.columns:
        return spans
    short, long = by_length(spans)
    fields = [c for c in spans.columns if c not in TRACE]
    out = _placed(short, fields, explicit).select(*TRACE, F.inline("spans")).select(*spans.columns, "parent")
    return out if long is None else out.unionByName(swept_parents(long, explicit))


def swept_parents(spans: DataFrame, explicit: bool) -> DataFrame:
    """The same for traces of any length."""
    if "parent" in spans.columns:
        return spans
    held = shortest_holders(spans)
    if not explicit:
        return spans.join(held, [*TRACE, "span_id"], "left").select(*spans.columns, F.col("held").alias("parent"))
    known = spans.select(*TRACE, F.col("span_id").alias("parent_id")).distinct().withColumn("known", F.col("parent_id"))
    s = spans.join(known, [*TRACE, "parent_id"], "left").join(held, [*TRACE, "span_id"], "left")
    return s.select(*spans.columns, F.coalesce("known", "held").alias("parent"))


def with_frame(spans: DataFrame) -> DataFrame:
    return spans.withColumn("frame", F.concat_ws(":", "service", "operation"))


def trace_edges(parented: DataFrame, profile: Profile = BATCH) -> DataFrame:
    """Parent and child frames of each span with a parent in its trace. The cross-service profile drops
    calls inside a service and keeps the first of equal edges of a trace."""
    child = with_frame(parented).select(*TRACE, "span_id", "start_us", "parent", F.col("service").alias("to_service"), F.col("frame").alias("to_frame"))
    parent = with_frame(parented).select(*TRACE, F.col("span_id").alias("parent"), F.col("service").alias("from_service"), F.col("frame").alias("from_frame"))
    edges = child.where("parent is not null").join(parent, [*TRACE, "parent"])
    return first_edges(edges.where("from_service <> to_service")) if profile.cross_service_only else edges


def first_edges(edges: DataFrame) -> DataFrame:
    w = Window.partitionBy(*TRACE, "from_frame", "to_frame").orderBy("start_us", "span_id")
    return edges.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def call_path(parented: DataFrame, frames: int = 5) -> DataFrame:
    """``parented`` with ``call_path``: up to ``frames`` ancestors, the farthest first. A bounded number of
    self joins on (trace, span), so cycles do no harm."""
    nodes = with_frame(parented).select(*TRACE, F.col("span_id").alias("up"), F.col("parent").alias("next"), F.col("frame").alias("above"))
    out = parented.withColumn("up", F.col("parent")).withColumn("call_path", F.lit(None).cast("string"))
    for _ in range(frames):
        out = out.join(nodes, [*TRACE, "up"], "left")
        path = F.when(F.col("above").isNotNull(), F.concat_ws(" -> ", "above", "call_path")).otherwise(F.col("call_path"))
        out = out.withColumn("call_path", path).drop("up", "above").withColumnRenamed("next", "up")
    return out.withColumn("call_path", F.coalesce("call_path", F.lit(""))).select(*parented.columns, "call_path")


def fingerprint(
    spans: DataFrame, profile: Profile = BATCH, min_spans: int = DEFAULTS.min_spans, known_root_ops: DataFrame | None = None, extra_noise: tuple[str, ...] = ()
) -> DataFrame:
    """One row per trace: environment, trace_id, fp_hash, path, root_op, services, span_count, edge_count, trace_start.

    The root is the first span without a parent, else the first span. Left out are traces under ``min_spans``
    spans (unless their root op is among ``known_root_ops(environment, root_op)``), with a noise root, and of at
    most three spans with any noise operation."""
    given = ["parent"] if "parent" in spans.columns else ["parent_id"] if profile.explicit_parents else []
    fields = ["start_us", "span_id", "duration_us", "service", "operation", *given]
    short, long = by_length(spans.select(*TRACE, *fields, S.is_noise(F.col("operation"), extra_noise).alias("noise")))
    short = short.withColumns({"noisy": F.array_max(F.transform("spans", lambda s: s["noise"])), "span_count": F.size("spans")})
    short = short.where("not (span_count <= 3 and noisy)" + (f" and span_count >= {min_spans}" if known_root_ops is None else ""))
    whole = _whole_short(short_traces(short, [*fields, "noise"], profile.explicit_parents), profile)
    whole = whole if long is None else whole.unionByName(_whole_long(swept_parents(long, profile.explicit_parents), profile))
    whole = whole.withColumn("root_op", F.concat_ws(":", "root.service", "root.operation"))
    if known_root_ops is None:
        whole = whole.where(F.col("span_count") >= min_spans)
    else:
        known = known_root_ops.select("environment", "root_op").distinct().withColumn("known", F.lit(True))
        whole = whole.join(known, ["environment", "root_op"], "left").where((F.col("span_count") >= min_spans) | F.coalesce("known", F.lit(False)))
    out = whole.where("not root.noise and not (span_count <= 3 and noisy)").withColumn("path", F.coalesce("edges", "root_op"))
    return out.select(
        *TRACE, S.fp_hash(F.col("path")).alias("fp_hash"), "path", "root_op", "services", "span_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        F.timestamp_micros("trace_start_us").alias("trace_start"),
    )


def _whole_short(placed: DataFrame, profile: Profile) -> DataFrame:
    """Per trace of :func:`short_traces`: root, services, span_count, trace_start_us, noisy, edges (null without any) and edge_count."""
    calls = F.transform("spans", lambda s: F.struct(_above(s["parent"]).alias("p"), s["service"].alias("service"), s["frame"].alias("frame")))
    t = placed.withColumn("calls", F.filter(calls, lambda c: c["p"].isNotNull()))
    pair = lambda c: F.struct(c["p"]["frame"].alias("a"), c["frame"].alias("b"))
    pairs = F.transform("calls", pair)
    if profile.cross_service_only:
        pairs = F.array_distinct(F.transform(F.filter("calls", lambda c: c["p"]["service"] != c["service"]), pair))
    t = t.withColumn("calls", F.transform(pairs, lambda c: F.concat_ws(" -> ", c["a"], c["b"])))
    root = F.coalesce(F.try_element_at(F.filter("spans", lambda s: s["parent"].isNull()), F.lit(1)), F.element_at("spans", 1))
    each = lambda c: F.transform("spans", lambda s: s[c])
    named = F.transform(F.array(root), lambda r: F.struct(r["service"].alias("service"), r["operation"].alias("operation"), r["noise"].alias("noise")))[0]
    whole = F.struct(
        named.alias("root"), F.array_sort(F.array_compact(F.array_distinct(each("service")))).alias("services"), F.col("span_count"), F.array_min(each("start_us")).alias("trace_start_us"),
        F.col("noisy"), F.when(F.size("calls") > 0, F.array_join("calls", " -> ")).alias("edges"), F.size("calls").alias("edge_count"),
    )
    return t.select(*TRACE, F.inline(F.array(whole)))  # a filter on plain columns would be pushed down, and make the arrays anew for each mention


def _whole_long(parented: DataFrame, profile: Profile) -> DataFrame:
    """The same for traces of any length."""
    edges = trace_edges(parented, profile)
    order = F.struct("start_us", "span_id", F.concat(F.col("from_frame"), F.lit(" -> "), F.col("to_frame")).alias("edge"))
    paths = edges.groupBy(*TRACE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["edge"]), " -> ").alias("edges"), F.count("*").cast("int").alias("edge_count"))
    root = F.min_by(F.struct("service", "operation", "noise"), F.struct(F.col("parent").isNotNull(), F.col("start_us"), F.col("span_id")))
    whole = parented.groupBy(*TRACE).agg(
        root.alias("root"), F.array_sort(F.collect_set("service")).alias("services"), F.count("*").cast("int").alias("span_count"),
        F.min("start_us").alias("trace_start_us"), F.max("noise").alias("noisy"),
    )
    return whole.join(paths, TRACE, "left")


def ordered_spans(spans: DataFrame) -> DataFrame:
    """One row per trace with its spans in order of start."""
    kept = F.struct("start_us", "span_id", "service", "operation", "duration_us", "is_error")
    return spans.groupBy(*TRACE).agg(F.array_sort(F.collect_list(kept)).alias("spans"))


def trace_summary(spans: DataFrame, k: int = 50) -> DataFrame:
    """Per trace: duration, spans, services, root, and the error and database spans among the first ``k``
    (database spans first, then by start)."""
    db = S.filled(F.try_element_at("tags", F.lit("db.system"))).isNotNull()
    w = Window.partitionBy(*TRACE).orderBy(F.when(db, 0).otherwise(1), "start_us", "span_id")
    s = with_frame(spans).withColumn("db", db).withColumn("nth", F.row_number().over(w))
    seen = F.col("nth") <= k
    pick = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(seen & test, F.col("frame")))), ",")
    return s.groupBy(*TRACE).agg(
        ((F.max(F.col("start_us") + F.col("duration_us")) - F.min("start_us")) / 1000).alias("duration_ms"), F.count("*").alias("span_count"),
        F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"), F.min_by("frame", F.struct("start_us", "span_id")).alias("root"),
        pick(F.col("is_error")).alias("error_spans"), pick(F.col("db")).alias("db_spans"),
    )


def environments(spans: DataFrame) -> DataFrame:
    return spans.groupBy("environment").agg(F.array_sort(F.collect_set("service")).alias("services"))


# ---- scans


def scan_traces(spans: DataFrame, services: list[str], start, end, environment: str | None = None, limit: int = 200) -> DataFrame:
    """Traces that touch any of ``services`` in [start, end): trace_id and trace_start, the latest ``limit`` ones."""
    s = spans.where((F.col("event_time") >= F.lit(start).cast("timestamp")) & (F.col("event_time") < F.lit(end).cast("timestamp")))
    if environment is not None:
        s = s.where(F.col("environment") == environment)
    starts = s.groupBy(*TRACE).agg(F.min("event_time").alias("trace_start"), F.max(F.col("service").isin(*services)).alias("touched"))
    return starts.where("touched").select(*TRACE, "trace_start").orderBy(F.desc("trace_start"), "trace_id").limit(limit)


def sample_per_service(spans: DataFrame, n: int = 200) -> DataFrame:
    """The latest ``n`` traces of each service, each trace once."""
    per = spans.groupBy(*TRACE, "service").agg(F.min("event_time").alias("trace_start"))
    w = Window.partitionBy("service").orderBy(F.desc("trace_start"), "trace_id")
    return per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select(*TRACE).distinct()


def scan_error_traces(spans: DataFrame) -> DataFrame:
    """All spans of the traces that hold a span tagged error=true."""
    bad = spans.where(F.try_element_at("tags", F.lit("error")) == "true").select(*TRACE).distinct()
    return spans.join(bad, TRACE, "left_semi")
