"""Time series of spans: learn phases, rolling windows, latency, error rate, throughput, queries and objectives."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwatch.config import DEFAULTS
from spanwatch.functions import scalars as S
from spanwatch.lineage import stored
from spanwatch.operators.traces import TRACE

US = 1_000_000


def op_stats(spans: DataFrame) -> DataFrame:
    """Per trace, service and operation: mean duration, spans, errors and time; without empty names, zero durations and noise."""
    s = spans.where("service <> '' and operation <> '' and duration_us > 0").where(~S.is_noise(F.col("operation")))
    return s.groupBy(*TRACE, "service", "operation").agg(
        F.avg("duration_us").alias("mean_us"), F.count("*").alias("n"), F.sum(F.col("is_error").cast("bigint")).alias("errors"), F.min("start_us").alias("ts_us")
    )


def query_stats(spans: DataFrame) -> DataFrame:
    """Per trace, service, database and template: mean duration, count and time."""
    tag = lambda k: S.filled(F.try_element_at("tags", F.lit(k)))
    s = spans.withColumn("stmt", F.coalesce(tag("db.statement"), tag("db.operation"))).where("stmt is not null and duration_us > 0")
    s = s.withColumn("template", S.query_template(F.col("stmt"))).withColumn("db", F.coalesce(tag("db.system"), F.lit("unknown")))
    g = s.groupBy(*TRACE, "service", "db", "template").agg(F.avg("duration_us").alias("mean_us"), F.count("*").alias("n"), F.min("start_us").alias("ts_us"))
    return g.withColumn("query_hash", S.query_hash(F.col("service"), F.col("db"), F.col("template")))


def with_phase(df: DataFrame, key: list[str], n: int, slot_s: int = 86_400) -> DataFrame:
    """``df`` with its arrival number per key and whether it belongs to the learn phase (the first ``n``).

    Rows are numbered inside slots of time; the rows of the slots before are added from a table of slots, so no partition holds a key's
    rows."""
    slot = F.floor(F.col("ts_us") / F.lit(slot_s * US))
    sizes = df.groupBy(*key, slot.alias("slot_no")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("slot_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*key, "slot_no").orderBy("ts_us", "trace_id"))
    told = df.withColumn("slot_no", slot).withColumn("own", own).join(sizes.select(*key, "slot_no", before.alias("before")), [*key, "slot_no"])
    return told.withColumn("nth", (F.col("before") + F.col("own")).cast("int")).withColumn("learning", F.col("nth") <= n).select(*df.columns, "nth", "learning")


def with_learn_stats(df: DataFrame, key: list[str], value: str, n: int) -> DataFrame:
    """Mean and population deviation of the learn phase, on each row, and whether the row belongs to it.

    The first ``n`` rows of a key come from a row number that is cut off before the shuffle; their statistics are one row per key, stored and
    joined back, so Spark knows their size and, as long as it is small, leaves the rows where they are. ``df`` is read twice: store what is dear."""
    w = Window.partitionBy(*key).orderBy("ts_us", "trace_id")
    first = df.select(*key, "ts_us", "trace_id", value).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    stats = first.groupBy(*key).agg(F.avg(value).alias("base_mean"), F.stddev_pop(value).alias("base_std"), F.max(F.struct("ts_us", "trace_id")).alias("until"))
    return df.join(stored(stats, "learn-stats"), key).withColumn("learning", F.struct("ts_us", "trace_id") <= F.col("until")).drop("until")


def over_recent(df: DataFrame, key: list[str], reach_us: int, **measures: Column) -> DataFrame:
    """``df`` with aggregates over the rows of the same key in the ``reach_us`` before each row's ``ts_us`` (both ends included). Any
    aggregate will do, but each row folds its window anew: sums and counts belong to :func:`recent_sums`.

    Time is cut into slots of that length; a row also rides along into the slot after its own, so every window lies in
    one partition of (key, slot) and a busy key is dealt over as many partitions as it has slots."""
    slot = F.floor(F.col("ts_us") / F.lit(max(reach_us, 1)))
    dealt = df.withColumn("own_slot", slot).withColumn("slot_no", F.explode(F.array(F.col("own_slot"), F.col("own_slot") + 1)))
    w = Window.partitionBy(*key, "slot_no").orderBy("ts_us").rangeBetween(-reach_us, 0)
    return dealt.withColumns({name: c.over(w) for name, c in measures.items()}).where("slot_no = own_slot").drop("own_slot", "slot_no")


def recent_sums(df: DataFrame, key: list[str], reach_us: int, **values: Column) -> DataFrame:
    """``df`` with sums over the rows of the same key in the ``reach_us`` before each row's ``ts_us`` (both ends included).

    Dealt like :func:`over_recent`; a window is the end of the slot before and the beginning of its own. Both are running sums, one
    from the newest row on and one from the oldest, so a row costs the same however many lie in its window, and nothing is subtracted."""
    own_slot = F.floor(F.col("ts_us") / F.lit(max(reach_us, 1)))
    rides = F.array(F.struct(own_slot.alias("slot_no"), F.lit(0).alias("later_us")), F.struct((own_slot + 1).alias("slot_no"), F.lit(reach_us).alias("later_us")))
    dealt = df.withColumn("ride", F.explode(rides)).withColumn("rides", F.col("ride.slot_no") > own_slot).withColumn("at_us", F.col("ts_us") + F.col("ride.later_us"))
    part = Window.partitionBy(*key, "ride.slot_no")
    newest, oldest = (part.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.desc("at_us"), F.asc("at_us")))
    both = lambda c: (F.sum(F.when(F.col("rides"), c)).over(newest), F.sum(F.when(~F.col("rides"), c)).over(oldest))
    halves = {f"{name}_{half}": w for name, c in values.items() for half, w in zip(("before", "own"), both(c))}
    summed = dealt.withColumns(halves).where(~F.col("rides"))
    whole = lambda a, b: F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))
    return summed.select(*[F.col(c) for c in df.columns if c not in values], *[whole(f"{n}_before", f"{n}_own").alias(n) for n in values])


def with_rolling_mean(df: DataFrame, key: list[str], value: str, window_s: int) -> DataFrame:
    s = recent_sums(df, key, window_s * US, recent_sum=F.col(value).cast("double"), recent_n=F.col(value).isNotNull().cast("bigint"))
    return s.withColumn("rolling", F.col("recent_sum") / F.nullif("recent_n", F.lit(0))).drop("recent_sum", "recent_n")


WEEK_US = 7 * 86_400 * US


def with_seasonal_stats(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Running count, mean and population deviation per key and hour of the week, the row itself included.

    Rows are folded inside a week only. The weeks before come as moments (count, mean, squared deviations): one row per key, hour and week,
    merged over the weeks before and joined back."""
    hour, week = S.seasonal_slot(F.timestamp_micros("ts_us")), F.floor(F.col("ts_us") / F.lit(WEEK_US))
    dealt = df.withColumn("slot", hour).withColumn("week_no", week)
    cell = [*key, "slot", "week_no"]
    weeks = dealt.groupBy(*cell).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))
    past = Window.partitionBy(*key, "slot").orderBy("week_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per week
    first = F.first("mean").over(Window.partitionBy(*key, "slot").orderBy("week_no"))  # means are told from the first week's, so nearly equal ones keep their digits
    weeks = weeks.withColumn("apart", F.col("mean") - first).withColumn("first", first)
    before = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    weeks = weeks.withColumns({"n0": before("n"), "sum0": before(F.col("n") * F.col("apart")), "square0": before(F.col("m2") + F.col("n") * F.col("apart") * F.col("apart"))})
    shift = F.coalesce(F.col("sum0") / F.nullif("n0", F.lit(0)), F.lit(0.0))
    moments = {"mean0": F.col("first") + shift, "m20": F.greatest(F.col("square0") - F.col("n0") * shift * shift, F.lit(0.0))}
    weeks = weeks.withColumns(moments).select(*cell, "n0", "mean0", "m20")
    own = Window.partitionBy(*cell).orderBy("ts_us", "trace_id").rowsBetween(Window.unboundedPreceding, 0)
    s = dealt.withColumns({"n1": F.count(value).over(own), "mean1": F.avg(value).over(own), "m21": F.var_pop(value).over(own) * F.count(value).over(own)}).join(weeks, cell)
    n, apart = F.col("n0") + F.col("n1"), F.col("mean1") - F.col("mean0")
    merged = F.col("m20") + F.col("m21") + apart * apart * F.col("n0") * F.col("n1") / n
    stats = {"slot_n": n, "slot_mean": F.col("mean1") - apart * F.col("n0") / n, "slot_std": F.sqrt(merged / n)}
    return s.withColumns(stats).select(*df.columns, "slot", *stats)


def with_error_rate(df: DataFrame, key: list[str], window_s: int) -> DataFrame:
    s = recent_sums(df, key, window_s * US, buckets=F.lit(1).cast("bigint"), bad=F.col("errors"), of=F.col("n"))
    return s.withColumn("rate", F.col("bad") / F.col("of")).drop("bad", "of")


def with_spans_per_min(df: DataFrame, window_s: int = 120) -> DataFrame:
    s = recent_sums(df, ["environment", "service"], window_s * US - 1, of=F.col("n"))
    return s.withColumn("per_min", F.col("of") / (window_s / 60)).drop("of")


def with_sig_rate(sigs: DataFrame, window_s: int = 300) -> DataFrame:
    s = recent_sums(sigs.withColumn("ts_us", F.unix_micros("event_time")), ["environment", "sig_hash"], window_s * US - 1, of=F.lit(1).cast("bigint"))
    return s.withColumn("per_min", F.col("of") / (window_s / 60)).drop("of")


OP = ["environment", "service", "operation"]


def latency_anomalies(spans: DataFrame, window_s: int = DEFAULTS.latency_window_s, learn: int = DEFAULTS.latency_learn, z: float = DEFAULTS.z, seasonal: bool = True) -> DataFrame:
    """Operations whose rolling latency is ``z`` deviations above what they learned, or above their hour of the week once that
    has ``learn`` samples."""
    s = with_rolling_mean(with_learn_stats(stored(op_stats(spans), "op-stats"), OP, "mean_us", learn), OP, "mean_us", window_s)
    mean, std = F.col("base_mean"), F.col("base_std")
    if seasonal:
        s = with_seasonal_stats(s, OP, "mean_us")
        ripe = F.col("slot_n") >= learn
        mean, std = F.when(ripe, F.col("slot_mean")).otherwise(mean), F.when(ripe, F.col("slot_std")).otherwise(std)
    s = s.where("not learning").withColumn("expected", mean).withColumn("z", (F.col("rolling") - mean) / F.greatest(std, F.lit(0.001)))
    return s.where((F.col("z") >= z) & (F.col("rolling") > F.col("expected"))).select(*TRACE, "service", "operation", "ts_us", "rolling", "expected", "z")


def error_rate_anomalies(spans: DataFrame, window_s: int = DEFAULTS.error_window_s, rate: float = DEFAULTS.error_rate, samples: int = DEFAULTS.error_samples) -> DataFrame:
    s = with_error_rate(op_stats(spans), OP, window_s)
    return s.where((F.col("buckets") >= samples) & (F.col("rate") >= rate)).select(*TRACE, "service", "operation", "ts_us", "buckets", "rate")


QUERY = ["environment", "query_hash"]


def slow_queries(spans: DataFrame, window_s: int = DEFAULTS.query_window_s, learn: int = DEFAULTS.query_learn, z: float = DEFAULTS.z) -> DataFrame:
    s = with_rolling_mean(with_learn_stats(stored(query_stats(spans), "query-stats"), QUERY, "mean_us", learn), QUERY, "mean_us", window_s).where("not learning")
    s = s.withColumn("z", (F.col("rolling") - F.col("base_mean")) / F.greatest("base_std", F.lit(0.001)))
    return s.where((F.col("z") >= z) & (F.col("rolling") > F.col("base_mean"))).select(*TRACE, "service", "query_hash", "ts_us", "rolling", "z")


def new_query_templates(spans: DataFrame, warmup_end, known: DataFrame | None = None) -> DataFrame:
    """First sight of a template after the warm-up; templates of ``known(environment, query_hash)`` were seen before."""
    first = query_stats(spans).groupBy("environment", "service", "db", "template", "query_hash").agg(F.min("ts_us").alias("first_us"))
    first = first.where(F.col("first_us") >= F.unix_micros(F.lit(warmup_end).cast("timestamp")))
    return first if known is None else first.join(known.select(*QUERY).distinct(), QUERY, "left_anti")


ROOT = ["environment", "root_op"]


def throughput_fold(
    fps: DataFrame,
    state: DataFrame | None = None,
    since_us: int | None = None,
    window_s: int = DEFAULTS.throughput_window_s,
    drop: float = DEFAULTS.throughput_drop,
    learn: int = DEFAULTS.throughput_learn,
    rearm: float = 0.75,
) -> DataFrame:
    """One step of :func:`throughput_drops`: per root op the state (n, base, down) after the traces from ``since_us`` on, and the drops among
    them (out). It starts from ``state`` (environment, root_op, n, base, down); traces of the window before ``since_us`` count for rates only."""
    rated = recent_sums(fps.withColumn("ts_us", F.unix_micros("trace_start")), ROOT, window_s * US, of=F.lit(1).cast("bigint")).withColumn("rate", F.col("of") / (window_s / 60))
    rated = rated if since_us is None else rated.where(F.col("ts_us") >= since_us)
    rows = rated.groupBy(*ROOT).agg(F.array_sort(F.collect_list(F.struct("ts_us", "trace_id", "rate"))).alias("r"))
    fields = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in (("n", 0), ("base", 0.0), ("down", False))]
    if state is None:
        rows = rows.select(*ROOT, "r", F.lit(0).alias("n"), F.lit(0.0).alias("base"), F.lit(False).alias("down"))
    else:
        rows = rows.join(state.select(*ROOT, "n", "base", "down"), ROOT, "full_outer")
    start = F.struct(*fields, F.expr("cast(array() as array<struct<ts_us:bigint,rate:double,base:double>>)").alias("out"))

    def step(a, x):
        learning = a["n"] < learn
        ratio = x["rate"] / F.greatest(a["base"], F.lit(1e-9))
        fires = ~learning & ~a["down"] & (ratio < drop)
        back = ~learning & (ratio >= rearm)
        base = F.when(a["n"] == 0, x["rate"]).when(learning, 0.9 * a["base"] + 0.1 * x["rate"]).when(back, 0.95 * a["base"] + 0.05 * x["rate"]).otherwise(a["base"])
        down = F.when(fires, True).when(back, False).otherwise(a["down"])
        alert = F.struct(x["ts_us"].alias("ts_us"), x["rate"].alias("rate"), a["base"].alias("base"))
        return F.struct((a["n"] + 1).alias("n"), base.alias("base"), down.alias("down"), F.when(fires, F.concat(a["out"], F.array(alert))).otherwise(a["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<ts_us:bigint,trace_id:string,rate:double>>)")
    return rows.select(*ROOT, F.aggregate(F.coalesce("r", none), start, step).alias("s")).select(*ROOT, "s.*")


def throughput_alerts(folded: DataFrame) -> DataFrame:
    each = folded.select(*ROOT, F.explode("out").alias("o"))
    return each.select(*ROOT, "o.ts_us", F.round("o.rate", 9).alias("rate"), F.round("o.base", 9).alias("base"))


def throughput_drops(fps: DataFrame, segment_s: int, keep: Callable[[DataFrame], DataFrame], window_s: int = DEFAULTS.throughput_window_s, **options) -> DataFrame:
    """Root ops whose rate of traces falls under ``drop`` of the learned one, once until it is back at ``rearm``.

    The rate is a window count; the learned rate follows it slowly, row by row. So time is cut into segments of ``segment_s``, folded one after
    the other: the state table at the end of one (a row per root op) starts the next, and no array holds more than a segment of a
    root op. ``keep`` writes a table and reads it back, so a lost executor costs one segment. Traces before the first segment's start may be
    folded elsewhere: see :func:`throughput_fold`."""
    start = F.unix_micros("trace_start")
    low, high = fps.agg(F.min(start), F.max(start)).first()
    state, out = None, None
    for since in range(low or 0, (high or 0) + 1, segment_s * US):
        part = fps.where((start >= since - window_s * US) & (start < since + segment_s * US))
        state = keep(throughput_fold(part, state, since, window_s, **options))
        out = throughput_alerts(state) if out is None else out.unionByName(throughput_alerts(state))
    return out


def error_rate_spikes(sigs: DataFrame, baseline: DataFrame | None = None, window_s: int = 300, times: float = 5.0, least: int = 10) -> DataFrame:
    """Known signatures (those of ``baseline(environment, sig_hash)``, all without one) whose rate is ``times`` the rate that is frozen once
    ``least`` events lie in twice the window: that of their older half over the time that it spans (two events at least, not all at
    once). Events fire from the freezing one on.

    Positions come from row numbers in slots of twice the window, so no partition holds a signature's history; the oldest event in reach of a
    row is a running least of the slot before, from its newest event on, or the first of its own, so no window is folded anew for each row. The
    older half is looked up for the freezing event alone."""
    key, window = ["environment", "sig_hash"], window_s * US
    s = sigs if baseline is None else sigs.join(baseline.select(*key).distinct(), key, "left_semi")
    s = s.select(*key, "trace_id", "span_id", F.unix_micros("event_time").alias("ts_us"))
    own_slot = F.floor(F.col("ts_us") / F.lit(2 * window))
    dealt = s.withColumn("slot_no", F.explode(F.array(own_slot, own_slot + 1))).withColumn("rides", F.col("slot_no") > own_slot)
    dealt = dealt.withColumn("at_us", F.col("ts_us") + F.when(F.col("rides"), 2 * window).otherwise(0))
    part = Window.partitionBy(*key, "slot_no")
    place = F.row_number().over(part.orderBy("ts_us", "trace_id", "span_id"))
    until = lambda reach: F.count("*").over(part.orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -reach))
    told = dealt.withColumns({"place": place, "recent": place - until(window), "held": place - until(2 * window)})
    told = told.withColumn("peers", F.count("*").over(part.orderBy("ts_us").rangeBetween(0, 0)))
    least_of = lambda test, w: F.min(F.when(test, F.struct("ts_us", "peers"))).over(w)
    before = least_of(F.col("rides"), part.orderBy(F.desc("at_us")).rangeBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("oldest", F.coalesce(before, least_of(~F.col("rides"), part))).where("not rides")
    held = stored(told.select(*key, "trace_id", "span_id", "ts_us", "recent", "held", "oldest"), "spike-windows")
    held = held.withColumn("at", F.struct("ts_us", "trace_id", "span_id")).withColumn("half", F.floor(F.col("held") / 2))
    ready = (F.col("held") >= least) & (F.col("half") >= 2) & (F.col("half") > F.col("oldest.peers"))
    frozen = held.where(ready).groupBy(*key).agg(F.min(F.struct("at", "half", F.col("oldest.ts_us").alias("from_us"))).alias("f")).select(*key, "f.*")
    older = s.join(frozen, key).where((F.col("ts_us") >= F.col("from_us")) & (F.struct("ts_us", "trace_id", "span_id") <= F.col("at")))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ts_us", "trace_id", "span_id"))  # of at most the events of one freezing window
    base = older.withColumn("nth", nth).where("nth = half").select(*key, F.col("at").alias("frozen_at"), (F.col("half") / ((F.col("ts_us") - F.col("from_us")) / (60 * US))).alias("base_rate"))
    per_min = F.col("recent") / (window / (60 * US))
    j = held.join(base, key).where(F.col("at") >= F.col("frozen_at")).withColumn("per_min", per_min).where(F.col("per_min") >= F.col("base_rate") * times)
    return j.select(*key, "span_id", "ts_us", F.round("per_min", 9).alias("per_min"), F.round("base_rate", 9).alias("base_rate"))


# ---- snapshots and objectives


def metrics_snapshot(spans: DataFrame, window_s: int, learn: int = DEFAULTS.latency_learn, z: float = DEFAULTS.z) -> DataFrame:
    """Latest state per operation and its roll-ups per service and environment (``level``): latency and the learned one (null while it learns, and
    of an environment), z, error rate, spans, status, and of how many rows of the level below it is made (``parts``), which ``warn`` or are ``anomalies``.

    A service shows its worst operation (by status, then z), with the error rate of all. An environment shows its worst service and means over
    its services; those that learn add nothing to them."""
    recent = {"recent_sum": F.col("mean_us").cast("double"), "recent_n": F.col("mean_us").isNotNull().cast("bigint"), "bad": F.col("errors"), "of": F.col("n")}
    s = recent_sums(with_learn_stats(stored(op_stats(spans), "op-stats"), OP, "mean_us", learn), OP, window_s * US, **recent)
    s = s.withColumn("rolling", F.col("recent_sum") / F.nullif("recent_n", F.lit(0)))
    last = s.groupBy(*OP).agg(F.max_by(F.struct("rolling", "base_mean", "base_std", "learning", "bad", "of"), F.struct("ts_us", "trace_id")).alias("x"), F.sum("n").alias("spans")).select(*OP, "x.*", "spans")
    last = last.withColumn("z", F.when(~F.col("learning"), (F.col("rolling") - F.col("base_mean")) / F.greatest("base_std", F.lit(0.001))).otherwise(0.0))
    last = last.withColumn("error_rate", F.col("bad") / F.col("of")).withColumn("baseline_us", F.when(~F.col("learning"), F.col("base_mean")))
    rank = F.when(F.col("learning"), 0).when((F.col("z") >= z) | (F.col("error_rate") >= 0.05), 3).when((F.col("z") >= 0.6 * z) | (F.col("error_rate") >= 0.01), 2).otherwise(1)
    last = stored(last.withColumn("rank", rank).withColumnRenamed("rolling", "latency_us"), "op-state")
    shown = ["rank", "latency_us", "baseline_us", "z"]
    below = [F.sum("spans").alias("spans"), F.count("*").alias("parts"), F.count_if(F.col("rank") == 2).alias("warn"), F.count_if(F.col("rank") == 3).alias("anomalies")]
    svc = last.groupBy("environment", "service").agg(
        F.max_by(F.struct("operation", *shown), F.struct("rank", "z", "operation")).alias("w"), (F.sum("bad") / F.sum("of")).alias("error_rate"), *below
    ).select("environment", "service", "w.*", "error_rate", "spans", "parts", "warn", "anomalies")
    known = F.col("baseline_us").isNotNull()
    mean = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0.0)) / F.count("*")
    env = svc.groupBy("environment").agg(
        F.max(F.struct("rank", "z", "service")).alias("w"), mean("latency_us").alias("latency_us"), mean("error_rate").alias("error_rate"), *below
    ).select("environment", "w.*", "latency_us", "error_rate", "spans", "parts", "warn", "anomalies")
    last = last.withColumns(dict.fromkeys(("parts", "warn", "anomalies"), F.lit(0).cast("bigint")))
    env = env.withColumn("operation", F.lit("")).withColumn("baseline_us", F.lit(None).cast("double"))
    told = lambda df, level: df.select(F.lit(level).alias("level"), *OP, *shown, "error_rate", "spans", "parts", "warn", "anomalies")
    out = told(last, "operation").unionByName(told(svc, "service")).unionByName(told(env, "environment"))
    return out.withColumn("status", F.element_at(F.array(*map(F.lit, ("learning", "ok", "warn", "anomaly"))), F.col("rank") + 1)).drop("rank")


def slo_inputs(spans: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """Error rate, 99th percentile and spans a minute per service. The percentile comes from a mergeable sketch: its rank is off by one
    part in ``accuracy`` of the spans at most, and exact for few of them."""
    minutes = (F.max("start_us") - F.min("start_us")) / (60 * US)
    return spans.groupBy("environment", "service").agg(F.avg(F.col("is_error").cast("double")).alias("error_rate"), F.percentile_approx("duration_us", 0.99, accuracy).cast("double").alias("p99_us"), (F.count("*") / F.greatest(minutes, F.lit(1.0))).alias("per_min"))


def exact_percentile(df: DataFrame, key: list[str], value: str, q: float, name: str, margin: float = 0.001, few: int = 10_000) -> DataFrame:
    """The ``q``-quantile of ``value`` per key, between the two values around it (null without values; null keys are keys).

    A sketch tells two values around the place, ``margin`` of the rows away (the ends for ``few`` rows); rows below are counted, and only
    the different values between them are put in order. The result is exact, whatever the sketch's error of 1 in 100 000."""
    around = F.percentile_approx(value, [max(q - margin, 0.0), min(q + margin, 1.0)], 100_000)
    ends = df.groupBy(*key).agg(F.count(value).alias("total"), around.alias("around"), F.min(value).alias("least"), F.max(value).alias("most"))
    pick = lambda at, end: F.when(F.col("total") <= few, F.col(end)).otherwise(F.col("around")[at])
    ends = ends.select(*[F.col(k).alias(f"{k}_of") for k in key], "total", pick(0, "least").alias("low"), pick(1, "most").alias("high"))
    alike = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key])
    counts = df.select(*key, F.col(value).alias("v")).join(stored(ends, "percentile-ends"), alike).where("v is null or v <= high")
    place = F.when(F.col("v") >= F.col("low"), F.col("v"))  # all below are one row
    counts = counts.groupBy(*key, place.alias("v")).agg(F.count("v").alias("size"), F.max("total").alias("total"))
    upto = F.sum("size").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("total") - 1) * F.lit(q)
    ranked = counts.withColumn("upto", upto).withColumn("at", at)
    nearest = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v"))).cast("double")
    found = ranked.groupBy(*key).agg(nearest(F.floor("at")).alias("lower"), nearest(F.ceil("at")).alias("upper"), (F.max("at") - F.floor(F.max("at"))).alias("share"))
    return found.select(*key, (F.col("lower") * (1 - F.col("share")) + F.col("upper") * F.col("share")).alias(name))


def exact_slo_inputs(spans: DataFrame) -> DataFrame:
    """:func:`slo_inputs` with the exact percentile, interpolated between two durations."""
    exact = exact_percentile(spans, ["environment", "service"], "duration_us", 0.99, "exact_us").withColumnsRenamed({"environment": "e", "service": "s"})
    told = slo_inputs(spans).join(exact, F.col("environment").eqNullSafe(F.col("e")) & F.col("service").eqNullSafe(F.col("s")), "left")
    return told.select("environment", "service", "error_rate", F.col("exact_us").alias("p99_us"), "per_min")


def slo_budget(inputs: DataFrame, slo: float = 0.999, p99_ms: float = 1000.0) -> DataFrame:
    """Burn rate, monthly budget, minutes to breach and severity per service."""
    burn = F.col("error_rate") / (1 - slo)
    budget = 43_200 * (1 - slo)
    level = F.when(burn >= 14.4, "CRITICAL").when(burn >= 6, "HIGH").when(burn >= 2, "MEDIUM").otherwise("LOW")
    p99 = F.when(F.col("p99_us") / 1000 >= 2 * p99_ms, "BREACH").when(F.col("p99_us") / 1000 >= p99_ms, "WARN").otherwise("OK")
    return inputs.select("environment", "service", F.round(burn, 6).alias("burn"), F.round(F.lit(budget), 6).alias("budget_min"), F.round(F.lit(budget) / F.nullif(burn, F.lit(0.0)), 6).alias("breach_min"), level.alias("severity"), p99.alias("p99_status"))


def burn_status(spans: DataFrame, minutes: int = 5, target: float = 0.005) -> DataFrame:
    b = spans.groupBy("environment", "service", F.floor(F.col("start_us") / (minutes * 60 * US)).alias("bucket")).agg(F.sum(F.col("is_error").cast("bigint")).alias("e"), F.count("*").alias("n"))
    g = b.groupBy("environment", "service").agg(F.max("e").alias("max_errors"), F.max("n").alias("max_total"))
    rate = F.col("max_errors") / F.col("max_total")
    return g.select("*", F.round(rate, 9).alias("rate"), F.round(rate / target, 9).alias("burn"))


def traffic_profile(spans: DataFrame) -> DataFrame:
    t = spans.groupBy(*TRACE).agg(F.count("*").alias("n"), F.max("is_error").alias("bad"), F.min("start_us").alias("s"))
    minutes = F.greatest((F.max("s") - F.min("s")) / (60 * US), F.lit(1.0))
    return t.groupBy("environment").agg((F.count("*") / minutes).alias("per_min"), F.avg(F.col("bad").cast("double")).alias("error_ratio"), F.avg("n").alias("mean_spans"))


def environment_profile(traffic: DataFrame, services: DataFrame) -> DataFrame:
    t = traffic.join(services.select("environment", F.size("services").alias("size")), "environment")
    rate = F.when(F.col("per_min") < 2, "LOW").when(F.col("per_min") >= 20, "HIGH").otherwise("MEDIUM")
    err = F.when(F.col("error_ratio") < 0.02, "QUIET").when(F.col("error_ratio") >= 0.15, "NOISY").otherwise("NORMAL")
    size = F.when(F.col("size") <= 3, "SIMPLE").when(F.col("size") >= 8, "COMPLEX").otherwise("MODERATE")
    return t.select("environment", rate.alias("traffic"), err.alias("errors"), size.alias("topology"))


def onboarding_advice(profile: DataFrame, topology: DataFrame) -> DataFrame:
    """Per service of ``topology`` (a topology summary): watch and learn minutes and types to leave out for its environment, and its
    own thresholds where they should differ (null: the default). Ingress services get a wider dominance unless traffic is low,
    databases the tightest values, noisy environments a wider error multiplier, dense traffic a tighter span multiplier."""
    by = lambda *v: F.when(F.col("traffic") == "HIGH", v[0]).when(F.col("traffic") == "LOW", v[2]).otherwise(v[1])
    linked = topology.groupBy("environment").agg(F.max(F.col("callees") > 0).alias("linked"))
    j = topology.join(profile, "environment").join(linked, "environment")
    out = F.array_compact(F.array(F.when(~F.col("linked"), "MISSING_SERVICE"), F.when(F.col("traffic") == "LOW", "SIGNATURE_VANISHED")))
    dominance = F.when(F.col("db"), 0.5).when(F.col("ingress") & (F.col("traffic") != "LOW"), 0.7)
    return j.select(
        "environment", "service", by(2, 5, 10).alias("watch_min"), by(60, 120, 240).alias("learn_min"), F.array_join(out, ",").alias("disabled"), dominance.alias("dominance"),
        F.when(F.col("db") | (F.col("traffic") == "HIGH"), 1.5).alias("spike_times"), F.when((F.col("errors") == "NOISY") & ~F.col("db"), 4.0).alias("error_spike_times"),
    )


# Windows to learn from, in minutes before an incident: how far their end is from it, and their length.
BEFORE_INCIDENT = ((30, 60), (60, 60), (120, 120), (240, 120))


def windows_before(spark: SparkSession, incident_start, minute_s: int = 60) -> DataFrame:
    """The four candidate windows before an incident: label, start_us, end_us."""
    rows = spark.createDataFrame([(f"{far}-{far + length}", far, far + length) for far, length in BEFORE_INCIDENT], "label string, near int, far int")
    at = F.unix_micros(F.lit(incident_start).cast("timestamp"))
    return rows.select("label", (at - F.col("far").cast("bigint") * minute_s * US).alias("start_us"), (at - F.col("near").cast("bigint") * minute_s * US).alias("end_us"))


def score_windows(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidate learn windows (``label, start_us, end_us``): error rate, variety of operation sequences and a score; under ten
    traces a window has none."""
    w = windows.select("label", F.col("start_us").alias("ws"), F.col("end_us").alias("we"))
    s = spans.join(w, (F.col("start_us") >= F.col("ws")) & (F.col("start_us") < F.col("we")))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "span_id", "operation"))), lambda x: x["operation"]), ">")
    t = s.groupBy("label", *TRACE).agg(order.alias("seq"), F.max("is_error").alias("bad"))
    g = t.groupBy("label").agg(F.count("*").alias("traces"), F.avg(F.col("bad").cast("double")).alias("error_rate"), F.countDistinct("seq").alias("variety"))
    score = F.when(F.col("traces") >= 10, 0.6 * (1 - F.col("error_rate")) + 0.4 * F.least(F.col("variety") / 50, F.lit(1.0)))
    return g.withColumn("score", F.round(score, 9))


def pick_best_window(spans: DataFrame, windows: DataFrame) -> DataFrame:
    return score_windows(spans, windows).where("score is not null").orderBy(F.desc("score"), "label").limit(1)
