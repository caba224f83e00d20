"""Work on anomaly events: correlation over tiers, deployments and environments, incidents and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.config import DEFAULTS
from spanwatch.functions import scalars as S

ES = ["environment", "service"]


def union_events(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def drop_recovered(events: DataFrame, restored: DataFrame) -> DataFrame:
    """Without events whose hash was restored later (``restored(environment, hash, ts_ms)``)."""
    r = restored.groupBy("environment", "hash").agg(F.max("ts_ms").alias("back_ms"))
    j = events.join(r, ["environment", "hash"], "left")
    return j.where("back_ms is null or back_ms < ts_ms").select(*events.columns)


def fan_out_missing(events: DataFrame) -> DataFrame:
    """MISSING_SERVICE events also count for every service that they list."""
    listed = F.filter(F.transform(F.split("services", ","), lambda s: F.trim(s)), lambda s: s != "")
    extra = events.where("anomaly_type = 'MISSING_SERVICE'").withColumn("other", F.explode(F.array_distinct(listed))).where("other <> service")
    return events.unionByName(extra.withColumn("service", F.col("other")).select(*events.columns))


def correlate(events: DataFrame, deployments: DataFrame | None = None, bucket_ms: int | None = None, tiers: int = DEFAULTS.tiers) -> DataFrame:
    """Services on which two or more tiers fired: type, severity, counts, types and time span; a deployment near the first
    event lowers the severity. ``bucket_ms`` correlates inside windows of that length."""
    e = fan_out_missing(events).withColumn("bucket", F.floor(F.col("ts_ms") / bucket_ms) if bucket_ms else F.lit(0).cast("bigint"))
    g = e.groupBy(*ES, "bucket").agg(
        F.array_sort(F.collect_set("tier")).alias("tiers"), F.count("*").alias("event_count"), F.array_join(F.array_sort(F.collect_set("anomaly_type")), ",").alias("anomaly_types"),
        F.min("ts_ms").alias("earliest_ms"), F.max("ts_ms").alias("latest_ms"),
    ).where(F.size("tiers") >= tiers)
    has = lambda t: F.array_contains("tiers", t)
    kind = F.when(has("tier1") & has("tier2") & has("tier3"), "MULTI_TIER").when(has("tier2") & has("tier3"), "TIER2_TIER3").when(has("tier1") & has("tier2"), "TIER1_TIER2").otherwise("TIER1_TIER3")
    g = g.withColumn("corr_type", kind).withColumn("severity", F.when(F.col("corr_type") == "MULTI_TIER", "Critical").otherwise("Major")).withColumn("time_span_s", F.floor((F.col("latest_ms") - F.col("earliest_ms")) / 1000))
    if deployments is not None:
        g = attach_deployment(g, deployments)
        lower = F.when(F.col("severity") == "Critical", "Major").otherwise("Minor")
        g = g.withColumn("severity", F.when(F.col("version").isNotNull(), lower).otherwise(F.col("severity")))
    return g.withColumn("tiers", F.array_join("tiers", ","))


def attach_deployment(corr: DataFrame, deployments: DataFrame, window_s: int = DEFAULTS.deploy_window_s) -> DataFrame:
    """``corr`` with the version and time of the deployment of its service nearest to its first event, within the window.

    Deployments are bucketed by the window's length and each correlation probes its own bucket and both neighbours, so the
    join is on keys and holds few rows per key."""
    ms = window_s * 1000
    d = deployments.select(*ES, "version", F.col("ts_ms").alias("deploy_ms"), F.floor(F.col("ts_ms") / ms).alias("slot"))
    probe = corr.withColumn("slot", F.explode(F.array(*[F.floor(F.col("earliest_ms") / ms) + k for k in (-1, 0, 1)])))
    near = probe.join(d, [*ES, "slot"]).where(F.abs(F.col("deploy_ms") - F.col("earliest_ms")) <= ms)
    best = near.groupBy(*ES, "bucket").agg(F.min(F.struct(F.abs(F.col("deploy_ms") - F.col("earliest_ms")).alias("gap"), "version", "deploy_ms")).alias("x"))
    return corr.join(best, [*ES, "bucket"], "left").select(*corr.columns, F.col("x.version").alias("version"), F.col("x.deploy_ms").alias("deploy_ms"))


def order_correlations(corr: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "Major", 1).when(F.col("severity") == "Minor", 2).otherwise(3)
    return corr.orderBy(rank, F.desc("event_count"), *ES)


def classify_tp_fp(anomalies: DataFrame, confirmed: DataFrame, window_ms: int = 600_000) -> DataFrame:
    """``anomalies`` with ``confirmed``: a correlated event of the service lies within the window. Both sides are bucketed by it."""
    c = confirmed.select(*ES, F.col("ts_ms").alias("c_ms"), F.floor(F.col("ts_ms") / window_ms).alias("slot")).distinct()
    probe = anomalies.withColumn("slot", F.explode(F.array(*[F.floor(F.col("ts_ms") / window_ms) + k for k in (-1, 0, 1)])))
    hit = probe.join(c, [*ES, "slot"]).where(F.abs(F.col("c_ms") - F.col("ts_ms")) <= window_ms).select("event_id").distinct().withColumn("hit", F.lit(True))
    return anomalies.join(hit, "event_id", "left").withColumn("confirmed", F.coalesce("hit", F.lit(False))).drop("hit")


def tp_fp_stats(labelled: DataFrame) -> DataFrame:
    fired = lambda *t: F.sum(F.col("anomaly_type").isin(*t).cast("bigint"))
    g = labelled.groupBy("service").agg(
        F.sum(F.col("confirmed").cast("bigint")).alias("tp"), F.sum((~F.col("confirmed")).cast("bigint")).alias("fp"), F.count("*").alias("total"),
        fired("SPAN_COUNT_SPIKE").alias("spikes"), fired("SPAN_COUNT_DROP").alias("drops"), fired("SIGNATURE_SPIKE").alias("error_spikes"),
    )
    return g.withColumn("fp_rate", F.round(F.col("fp") / F.col("total"), 9))


# Threshold, default, step when loosened, least, most, the type that must have fired.
TUNED = (
    ("missing_service_dominance_threshold", 0.6, 0.05, 0.4, 0.9, None), ("span_count_spike_multiplier", 2.0, 0.25, 1.5, 5.0, "spikes"),
    ("span_count_drop_threshold", 0.5, -0.05, 0.1, 0.9, "drops"), ("error_spike_multiplier", 3.0, 0.5, 2.0, 8.0, "error_spikes"),
)


def tune_thresholds(stats: DataFrame, current: DataFrame | None = None, least: int = 5) -> DataFrame:
    """New thresholds of services with ``least`` events: loosened at 70 % false positives and more, tightened at 20 % and less, by a
    step from the value in ``current`` (a row per service; the default where there is none), so that runs add up."""
    way = F.when(F.col("fp_rate") >= 0.7, 1).when(F.col("fp_rate") <= 0.2, -1).otherwise(0)
    s = stats.where(F.col("total") >= least).withColumn("way", way).where("way <> 0")
    if current is not None:
        s = s.join(current.select("service", *[F.col(n).alias("now_" + n) for n, *_ in TUNED]), "service", "left")

    def moved(name, default, step, low, high, fired):
        now = F.lit(default) if current is None else F.coalesce("now_" + name, F.lit(default))
        new = F.least(F.greatest(now + F.col("way") * step, F.lit(low)), F.lit(high))
        return F.round(new if fired is None else F.when(F.col(fired) > 0, new).otherwise(now), 4).alias(name)

    return s.select("service", "way", *[moved(*t) for t in TUNED])


def anomaly_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("anomaly_type", *ES).agg(F.count("*").alias("n"))


def anomaly_rate(events: DataFrame, minutes: float) -> DataFrame:
    return events.groupBy("environment").agg(F.round(F.count("*") / F.lit(float(minutes)), 9).alias("per_min"))


def incident_windows(events: DataFrame, bucket_s: int = 600, least: int = 3, pad_s: int = 300) -> DataFrame:
    """Buckets with ``least`` events, merged when at most one bucket apart, padded on both sides."""
    b = events.groupBy("environment", F.floor(F.col("ts_ms") / (bucket_s * 1000)).alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("environment").orderBy("b")
    b = b.withColumn("new", F.coalesce((F.col("b") - F.lag("b").over(w) > 2).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w))
    return b.groupBy("environment", "g").agg(((F.min("b") * bucket_s - pad_s) * 1000).alias("start_ms"), (((F.max("b") + 1) * bucket_s + pad_s) * 1000).alias("end_ms"), F.sum("n").alias("events")).drop("g")


def _sessions(events: DataFrame, key: list[str], gap_ms: int) -> DataFrame:
    """``events`` with the number of their session: a new one starts where the gap to the previous event of the key exceeds ``gap_ms``.

    Inside a slot of that length no gap is so long, so sessions are runs of slots: only one row per key and slot is put
    in order, and a busy key's events never meet in one task."""
    e = events.withColumn("slot", F.floor(F.col("ts_ms") / F.lit(gap_ms)))
    slots = e.groupBy(*key, "slot").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    w = Window.partitionBy(*key).orderBy("slot")
    new = F.coalesce((F.col("lo") - F.lag("hi").over(w) > gap_ms).cast("int"), F.lit(1))
    numbered = slots.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    numbered = numbered.select(*[F.col(c).alias("of_" + c) for c in (*key, "slot")], "session")
    same = [F.col(c).eqNullSafe(F.col("of_" + c)) for c in (*key, "slot")]
    return e.join(numbered, same).select(*events.columns, "session")


def group_incidents(events: DataFrame, gap_ms: int = 30_000) -> DataFrame:
    """Incidents per environment: a new one starts when the gap to the previous event exceeds ``gap_ms``."""
    s = _sessions(events, ["environment"], gap_ms)
    names = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "anomaly_type", "service"))), "|")
    g = s.groupBy("environment", "session").agg(F.min("ts_ms").alias("start_ms"), F.count("*").alias("size"), names.alias("names"))
    return g.select("environment", F.concat(F.lit("INC-"), F.upper(F.substring(F.sha1("names"), 1, 8))).alias("incident"), "start_ms", "size")


def dedup_incidents(events: DataFrame, resolve_ms: int = 900_000) -> DataFrame:
    """One row per incident of a service, type and hash: opened, last seen, suppressed repeats; silence of ``resolve_ms`` resolves."""
    key = [*ES, "anomaly_type", "hash"]
    s = _sessions(events, key, resolve_ms)
    return s.groupBy(*key, "session").agg(F.min("ts_ms").alias("opened_ms"), F.max("ts_ms").alias("last_ms"), (F.count("*") - 1).alias("suppressed")).drop("session")


def problem_sessions(events: DataFrame, quiet_ms: int = 45_000, ttl_ms: int = 300_000) -> DataFrame:
    """Problems of an environment: opened, closed (the last anomaly), when the last anomaly expires, events and services."""
    s = _sessions(events, ["environment"], quiet_ms)
    return s.groupBy("environment", "session").agg(
        F.min("ts_ms").alias("opened_ms"), F.max("ts_ms").alias("closed_ms"), (F.max("ts_ms") + ttl_ms).alias("expires_ms"), F.count("*").alias("events"), F.countDistinct("service").alias("services")
    ).drop("session")


def active_anomalies(events: DataFrame, as_of_ms: int, ttl_ms: int = 300_000) -> DataFrame:
    """Anomalies that have not expired at a time."""
    return events.where((F.col("ts_ms") <= as_of_ms) & (F.col("ts_ms") > as_of_ms - ttl_ms))


def incident_feedback(events: DataFrame) -> DataFrame:
    """Types and services of each environment and day, to compare days with."""
    day = F.floor(F.col("ts_ms") / 86_400_000)
    return events.groupBy("environment", day.alias("day")).agg(F.array_sort(F.collect_set("anomaly_type")).alias("types"), F.array_sort(F.collect_set("service")).alias("services"))


def incident_history(events: DataFrame, gap_ms: int = 30_000, correlated: int = DEFAULTS.tiers) -> DataFrame:
    """One history row per incident of an environment: sorted types and services, and the severity: INCIDENT where a service is
    missing or ``correlated`` tiers fired, else DEGRADED."""
    s = _sessions(events, ["environment"], gap_ms)
    g = s.groupBy("environment", "session").agg(
        F.min("ts_ms").alias("start_ms"), F.array_sort(F.collect_set("anomaly_type")).alias("types"), F.array_sort(F.collect_set("service")).alias("services"), F.countDistinct("tier").alias("tiers")
    )
    grave = F.array_contains("types", "MISSING_SERVICE") | (F.col("tiers") >= correlated)
    return g.select("environment", "start_ms", "types", "services", F.when(grave, "INCIDENT").otherwise("DEGRADED").alias("severity"))


def similar_incidents(cur: DataFrame, past: DataFrame, n: int = 5) -> DataFrame:
    """For each current row the ``n`` past ones that share most types and services (ties: environment, day). ``cur`` is a handful of open incidents.

    Past rows of the same types and services score alike, so of each such set only the first ``n`` can be chosen: years of history shrink to
    its distinct sets before anything is joined. Of these sets those are scored that share a service, which few do; sets that share types
    alone are looked at for the current rows that they could still reach."""
    kinds = [F.array_sort("types").alias("pt"), F.array_sort("services").alias("ps")]
    p = past.select(F.col("environment").alias("p_env"), F.col("day").alias("p_day"), *kinds)
    alike = Window.partitionBy("pt", "ps").orderBy("p_env", "p_day")
    p = p.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= n).drop("r")
    key = ["environment", "day"]
    score = F.size(F.array_intersect("types", "pt")) + F.size(F.array_intersect("services", "ps"))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "p_env", "p_day")

    def met(rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        one = rows.select(*key, "types", "services", F.explode(mine).alias("k"))
        j = one.join(p.select("p_env", "p_day", "pt", "ps", F.explode(theirs).alias("k")), "k").drop("k").distinct()
        return j.select(*key, "p_env", "p_day", score.cast("long").alias("score"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)

    near = best(met(cur, "services", "ps"))
    reached = near.where(F.col("place") == n).select(*key, F.col("score").alias("least"))
    # without a common service a set scores as many points as the row has types at most
    open_ = cur.join(reached, key, "left").where(F.col("least").isNull() | (F.col("least") <= F.size("types"))).drop("least")
    return best(near.drop("place").unionByName(met(open_, "types", "pt")).distinct())


def suppress_recent(corr: DataFrame, key: list[str], ttl_ms: int = 1_800_000) -> DataFrame:
    """Without correlations whose key had another within the time before. A row also rides along into the slot of that length after its own,
    so the one before it lies in one partition of (key, slot) if it is that near."""
    own = F.floor(F.col("earliest_ms") / F.lit(max(ttl_ms, 1)))
    dealt = corr.withColumn("own_slot", own).withColumn("slot_no", F.explode(F.array(F.col("own_slot"), F.col("own_slot") + 1)))
    before = F.lag("earliest_ms").over(Window.partitionBy(*key, "slot_no").orderBy("earliest_ms"))
    told = dealt.withColumn("before", before).where("slot_no = own_slot")
    return told.where(F.col("before").isNull() | (F.col("earliest_ms") - F.col("before") > ttl_ms)).select(*corr.columns)


def relearn_trigger(restored: DataFrame, poll_ms: int = 300_000, cooldown_ms: int = 600_000) -> DataFrame:
    """Polls with a restored event and none in the cool-down before the poll's first one."""
    e = _sessions(restored.select("environment", "ts_ms"), ["environment"], cooldown_ms).groupBy("environment", "session").agg(F.min("ts_ms").alias("ts_ms"))
    return e.groupBy("environment", F.floor(F.col("ts_ms") / poll_ms).alias("poll")).agg(F.count("*").alias("triggers"))


def first_by_environment(events: DataFrame) -> DataFrame:
    return events.groupBy("service", "anomaly_type", "environment").agg(F.min("ts_ms").alias("first_ms"), F.count("*").alias("n"))


def detect_propagation(events: DataFrame, window_ms: int = 3_600_000) -> DataFrame:
    """Anomalies of a service that go up the pipeline: two or more environments, first times in pipeline order, within the window.
    With the share of the pipeline reached and the next environment, the first in order where it has not fired."""
    f = first_by_environment(events).withColumn("stage", S.pipeline_tier(F.col("environment")))
    g = f.groupBy("service", "anomaly_type").agg(F.array_sort(F.collect_list(F.struct("stage", "environment", "first_ms"))).alias("p"), F.max("first_ms").alias("hi"), F.min("first_ms").alias("lo"))
    times = F.transform("p", lambda x: x["first_ms"])
    ordered = times == F.array_sort(times)
    g = g.where((F.size("p") >= 2) & ordered & (F.col("hi") - F.col("lo") <= window_ms)).withColumn("fired", F.transform("p", lambda x: x["environment"]))
    pipeline = f.groupBy(F.lit(1).alias("one")).agg(F.array_sort(F.collect_set(F.struct("stage", "environment"))).alias("all"))  # one row, an item per environment
    g = g.withColumn("one", F.lit(1)).join(pipeline, "one").withColumn("next", F.try_element_at(F.filter("all", lambda e: ~F.array_contains("fired", e["environment"])), F.lit(1)))
    severity = F.when(F.col("next.stage") >= 3, "CRITICAL").otherwise("HIGH")
    return g.select(
        "service", "anomaly_type", F.array_join("fired", ">").alias("progress"), (F.size("fired") / F.size("all")).alias("share"), F.coalesce("next.environment", F.lit("")).alias("next_environment"),
        (F.col("hi") - F.col("lo")).alias("spread_ms"), severity.alias("severity"),
    )


def _parts(name):
    """All distinct parts of a text."""
    n = F.length(name)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(name, i, k)))))


def cross_env_match(staging: DataFrame, prod: DataFrame, least: float = 0.7) -> DataFrame:
    """The best production match of each staging anomaly: same type, same service core or one inside the other, like operation.

    Rows are first reduced to distinct (type, service, operation). A core that is or lies inside another equals one of that
    one's parts, so both directions are joins on (type, core); no two services meet on the type alone."""
    pick = lambda df, p: df.groupBy("anomaly_type", "service", "root_op").agg(F.min("ts_ms").alias("ts_ms")).select(
        "anomaly_type", F.col("service").alias(p + "service"), F.col("root_op").alias(p + "root_op"), F.col("ts_ms").alias(p + "ms"), S.service_core(F.col("service")).alias(p + "core"), F.trim(S.operation_of(F.col("root_op"))).alias(p + "op")
    )
    s, p = pick(staging, "s_"), pick(prod, "p_")
    inside = s.withColumn("core", F.explode(_parts(F.col("s_core")))).join(p.withColumn("core", F.col("p_core")), ["anomaly_type", "core"])
    around = p.withColumn("core", F.explode(_parts(F.col("p_core")))).join(s.withColumn("core", F.col("s_core")), ["anomaly_type", "core"])
    j = inside.drop("core").unionByName(around.where("s_core <> p_core").drop("core"))
    sc, pc, so, po = (F.col(c) for c in ("s_core", "p_core", "s_op", "p_op"))
    service = F.when(sc == pc, 1.0).otherwise(0.7)
    op = F.when((so == "") | (po == ""), 0.0).when(so == po, 1.0).when(po.contains(so) | so.contains(po), 0.5).otherwise(0.0)
    j = j.withColumn("score", F.round(service * 0.7 + op * 0.3, 6)).where(F.col("score") >= least)
    w = Window.partitionBy("anomaly_type", "s_service", "s_root_op").orderBy(F.desc("score"), "p_ms", "p_root_op", "p_service")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("anomaly_type", "s_service", "s_root_op", "p_service", "p_root_op", "score", "s_ms", "p_ms")


def cross_env_report(staging: DataFrame, prod: DataFrame) -> DataFrame:
    """Per type: staging anomalies, matched ones, those that staging saw first, and those that only staging has."""
    m = cross_env_match(staging, prod)
    s = staging.select("anomaly_type", F.col("service").alias("s_service"), F.col("root_op").alias("s_root_op")).distinct()
    j = s.join(m, ["anomaly_type", "s_service", "s_root_op"], "left")
    return j.groupBy("anomaly_type").agg(F.count("*").alias("staging"), F.count("score").alias("matched"), F.sum(F.coalesce((F.col("s_ms") < F.col("p_ms")).cast("bigint"), F.lit(0))).alias("early"), F.sum(F.col("score").isNull().cast("bigint")).alias("staging_only"))


def incident_states(rates: DataFrame, spike: float = 1.0, calm: float = 0.2, stable: int = 5, shortest: int | None = None) -> DataFrame:
    """Changes of state of each environment over a series of rates (``environment, minute, rate``): (environment, minute, state).

    NORMAL spikes at a rate of ``spike``. SPIKING is over when the rate falls under ``spike`` before the spike is ``shortest`` minutes old (NORMAL;
    ``stable`` without it), else when it falls under ``calm`` (RESOLVING). RESOLVING spikes again at ``spike``, as the same spike with the same
    start, and heals (HEAL) after ``stable`` minutes at any lower rate; then all begins anew.
    The state depends on the one before, so each environment's series is folded in order; callers bound it by the time range."""
    shortest = stable if shortest is None else shortest
    g = rates.groupBy("environment").agg(F.array_sort(F.collect_list(F.struct("minute", "rate"))).alias("r"))
    none = F.lit(0).cast("bigint")
    start = F.struct(F.lit("NORMAL").alias("state"), none.alias("spiked"), none.alias("calmed"), F.expr("cast(array() as array<struct<minute:bigint,state:string>>)").alias("out"))

    def step(a, x):
        high = x["rate"] >= spike
        spiking = F.when(~high & (x["minute"] - a["spiked"] < shortest), "NORMAL").when(x["rate"] < calm, "RESOLVING").otherwise("SPIKING")
        resolving = F.when(high, "SPIKING").when(x["minute"] - a["calmed"] >= stable, "HEAL").otherwise("RESOLVING")
        begins = a["state"].isin("NORMAL", "HEAL") & high
        state = F.when(a["state"] == "SPIKING", spiking).when(a["state"] == "RESOLVING", resolving).otherwise(F.when(high, "SPIKING").otherwise("NORMAL"))
        spiked = F.when(begins, x["minute"]).otherwise(a["spiked"])
        calmed = F.when((a["state"] == "SPIKING") & (state == "RESOLVING"), x["minute"]).otherwise(a["calmed"])
        change = F.array(F.struct(x["minute"].alias("minute"), state.alias("state")))
        out = F.when(state != a["state"], F.concat(a["out"], change)).otherwise(a["out"])
        return F.struct(state.alias("state"), spiked.alias("spiked"), calmed.alias("calmed"), out.alias("out"))

    return g.select("environment", F.explode(F.aggregate("r", start, step)["out"]).alias("o")).select("environment", "o.minute", "o.state")


def noise_suggestions(baseline: DataFrame, least_hits: int = 3) -> DataFrame:
    """Parts of operations that would mark promoted or often seen entries as noise: fingerprints, hits, examples. Parts that
    cover the same root ops count once (the shortest)."""
    c = baseline.where(F.col("auto_promoted") | (F.col("watch_hits") >= least_hits)).withColumn("part", F.explode(S.noise_candidates(S.operation_of(F.col("root_op")))))
    g = c.groupBy("part").agg(F.countDistinct("fp_hash").alias("fingerprints"), F.sum("watch_hits").alias("hits"), F.array_sort(F.collect_set("root_op")).alias("ops"))
    w = Window.partitionBy("ops").orderBy(F.length("part"), "part")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("part", "fingerprints", "hits", F.array_join(F.slice("ops", 1, 3), ",").alias("examples"))


def unknown_patterns(candidates: DataFrame, known: list[str]) -> DataFrame:
    """Candidates (``part``) that neither hold a known pattern nor lie inside one."""
    c = F.col("part")
    return candidates.where(~S.any_of([c.contains(k) | F.lit(k).contains(c) for k in known]))


def top_messages(events: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` messages of each service in time: a row number that is cut off before the shuffle, so only these are gathered."""
    order = ["ts_ms", "event_id", "message"]
    w = Window.partitionBy(*ES).orderBy(*order)
    few = events.select(*ES, *order).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    first = F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["message"])
    return few.groupBy(*ES).agg(F.array_join(first, "; ").alias("messages"))


def deployment_risk(trace: DataFrame, errors: DataFrame, edges: DataFrame, events: DataFrame, hours: float, thresholds: DataFrame | None = None) -> DataFrame:
    """Score 0 to 100 per service: how little of its behaviour is known, contaminated error baselines, callers, how restless its
    environment is, and how tight its thresholds are (``thresholds``, a row per service)."""
    root = S.service_of(F.col("root_op"))
    svc = trace.select("environment", "fp_hash", F.explode(F.array_union("services", F.array(root))).alias("service")).groupBy(*ES).agg(F.countDistinct("fp_hash").alias("fps"))
    bad = errors.groupBy(*ES).agg(F.max(S.is_incident_artifact(F.col("error_type"))).alias("contaminated"))
    calls = edges.where("caller <> callee")
    callers = calls.groupBy("environment", F.col("callee").alias("service")).agg(F.countDistinct("caller").alias("callers"))
    callees = calls.groupBy("environment", F.col("caller").alias("service")).agg(F.countDistinct("callee").alias("callees"))
    rate = events.groupBy("environment").agg((F.count("*") / F.lit(float(hours))).alias("per_hour"))
    known = lambda df, name: df.select("environment").distinct().withColumn(name, F.lit(True))
    every = svc.select(*ES).unionByName(bad.select(*ES)).unionByName(callers.select(*ES)).unionByName(callees.select(*ES)).distinct()
    j = every.join(svc, ES, "left").join(bad, ES, "left").join(callers, ES, "left").join(callees, ES, "left").join(rate, "environment", "left")
    j = j.join(known(trace, "has_trace"), "environment", "left").join(known(errors, "has_errors"), "environment", "left")
    fps = F.when(F.col("has_trace").isNull(), 20).when(F.col("fps").isNull(), 25).when(F.col("fps") == 1, 30).when(F.col("fps") <= 3, 20).when(F.col("fps") <= 8, 10).otherwise(5)
    err = F.when(F.col("has_errors").isNull(), 5).when(F.col("contaminated"), 25).otherwise(0)
    n, m = F.coalesce("callers", F.lit(0)), F.coalesce("callees", F.lit(0))
    call = F.when((n == 0) & (m == 0), 5).when(n >= 4, 25).when(n >= 2, 15).otherwise(8)
    env = F.when(F.col("per_hour") >= 10, 20).when(F.col("per_hour") >= 3, 12).when(F.col("per_hour") >= 1, 6).otherwise(0)
    tight = F.lit(0)
    if thresholds is not None:
        j = j.join(thresholds.select("service", F.col("missing_service_dominance_threshold").alias("dominance"), F.col("span_count_spike_multiplier").alias("spike")), "service", "left")
        tight = F.when(F.col("dominance") <= 0.5, 5).when(F.col("dominance") >= 0.75, -5).otherwise(0) + F.when(F.col("spike") <= 1.5, 3).otherwise(0)
    score = F.greatest(F.least(fps + err + call + env + tight, F.lit(100)), F.lit(0))
    return j.select(*ES, score.alias("score"), F.when(score >= 75, "CRITICAL").when(score >= 55, "HIGH").when(score >= 35, "MEDIUM").otherwise("LOW").alias("grade"))


def service_summary(edges: DataFrame, trace: DataFrame, errors: DataFrame) -> DataFrame:
    e = edges.where("caller <> callee")
    out = e.groupBy("environment", F.col("caller").alias("service")).agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("callees"))
    into = e.groupBy("environment", F.col("callee").alias("service")).agg(F.array_join(F.array_sort(F.collect_set("caller")), ",").alias("callers"))
    t = trace.groupBy("environment", S.service_of(F.col("root_op")).alias("service")).agg(F.count("*").alias("fingerprints"), F.round(F.avg("span_count"), 6).alias("mean_spans"), F.countDistinct("root_op").alias("root_ops"))
    x = errors.groupBy(*ES).agg(F.array_join(F.array_sort(F.collect_set("error_type")), ",").alias("error_types"))
    j = t.join(out, ES, "left").join(into, ES, "left").join(x, ES, "left")
    return j.na.fill("", ["callees", "callers", "error_types"])
