"""Trace baselines: learning, merging, promotion, decay, overrides, differences and health.

A baseline is a table keyed by (environment, fp_hash). Every operator returns a new table; sinks
write versions, nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.config import DEFAULTS
from spanwatch.functions import scalars as S
from spanwatch.lineage import stored

KEY = ["environment", "fp_hash"]
ROOT = ["environment", "root_op"]


def learn_trace(
    fps: DataFrame, prev: DataFrame | None = None, reset: bool = False, bootstrap: bool = False, min_occurrences: int = DEFAULTS.learn_min_trace,
    promoted: DataFrame | None = None, overrides: DataFrame | None = None, auto_overrides: bool = False,
) -> DataFrame:
    """A new baseline from the fingerprints of a window.

    Known hashes add their counts and widen their span bounds; new ones need ``min_occurrences`` (1 when
    bootstrapping); what was not seen and is not promoted goes; then infrastructure-only entries go
    (not when bootstrapping, where entries seen once go instead); ``promoted`` entries are added and
    overrides applied."""
    least = 1 if bootstrap else min_occurrences
    first = lambda c: F.min_by(c, F.struct("trace_start", "trace_id")).alias(c)
    now = fps.groupBy(*KEY).agg(
        first("path"), first("root_op"), first("services"), first("span_count"), first("edge_count"), F.count("*").alias("n"),
        F.min("span_count").alias("low"), F.max("span_count").alias("high"), F.min("trace_start").alias("since"), F.max("trace_start").alias("until"),
    )
    if prev is None or reset or bootstrap:
        b = now.where(F.col("n") >= least).select(
            *KEY, "path", "root_op", "services", "span_count", F.col("low").alias("span_count_min"), F.col("high").alias("span_count_max"), "edge_count", F.col("n").alias("occurrences"),
            F.lit(0).alias("watch_hits"), F.lit(False).alias("auto_promoted"), F.lit(None).cast("timestamp").alias("promoted_at"), F.lit(False).alias("no_missing_service"), F.col("since").alias("first_seen"), F.col("until").alias("last_seen"),
        )
    else:
        old = prev.select(*KEY, *[F.col(c).alias("o_" + c) for c in prev.columns if c not in KEY])
        j = now.join(old, KEY, "full_outer")
        known = F.col("o_occurrences").isNotNull()
        j = j.where((known & (F.col("n").isNotNull() | F.col("o_auto_promoted"))) | (~known & (F.col("n") >= least)))
        keep = lambda c: F.coalesce("o_" + c, c).alias(c)
        b = j.select(
            *KEY, keep("path"), keep("root_op"), keep("services"), keep("span_count"), F.least("o_span_count_min", "low").alias("span_count_min"), F.greatest("o_span_count_max", "high").alias("span_count_max"), keep("edge_count"),
            (F.coalesce("o_occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"), F.coalesce("o_watch_hits", F.lit(0)).alias("watch_hits"), F.coalesce("o_auto_promoted", F.lit(False)).alias("auto_promoted"),
            F.col("o_promoted_at").alias("promoted_at"), F.coalesce("o_no_missing_service", F.lit(False)).alias("no_missing_service"), F.coalesce("o_first_seen", "since").alias("first_seen"), F.greatest("o_last_seen", "until").alias("last_seen"),
        )
    b = b.where("auto_promoted or occurrences > 1") if bootstrap else drop_infra_only(stored(b, "learned"))  # it reads the entries twice
    if promoted is not None:
        b = add_promoted(b, promoted)
    if overrides is not None:
        b = apply_overrides(b, overrides)
    if auto_overrides:
        b = apply_overrides(b, auto_no_missing(b).select(*ROOT, F.lit(True).alias("no_missing_service")))
    return b


def drop_infra_only(baseline: DataFrame) -> DataFrame:
    """Drop entries, unless promoted, that call other services none of which is the root service of any entry."""
    roots = baseline.groupBy("environment").agg(F.collect_set(S.service_of(F.col("root_op"))).alias("roots"))  # one name per service
    others = F.array_except("services", F.array(S.service_of(F.col("root_op"))))
    return baseline.join(roots, "environment").where(F.col("auto_promoted") | (F.size(others) == 0) | F.arrays_overlap(others, F.col("roots"))).select(*baseline.columns)


def established(baseline: DataFrame, least: int = DEFAULTS.learn_min_trace) -> DataFrame:
    return baseline.where(F.col("occurrences") >= least)


def established_stream(baseline: DataFrame, least: int = 2) -> DataFrame:
    return baseline.where((F.col("occurrences") >= least) | F.col("auto_promoted"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_threshold(df: DataFrame, thresholds: DataFrame | None, key: str, default: float, service: str = "service") -> DataFrame:
    """``df`` with column ``key``: the service's own value, else the default. The table of thresholds is one row per
    service; Spark broadcasts it if it is small."""
    if thresholds is None:
        return df.withColumn(key, F.lit(default))
    own = fresh(df, "own_value")
    t = thresholds.select(F.col("service").alias(service), F.col(key).alias(own))
    return df.join(t, service, "left").withColumn(key, F.coalesce(own, F.lit(default))).drop(own)


def dominant_services(baseline: DataFrame, thresholds: DataFrame | None = None, default: float = DEFAULTS.dominance) -> DataFrame:
    """Per root op, services in at least the threshold's share of its entries: environment, root_op, service, variants, total."""
    total = baseline.groupBy(*ROOT).agg(F.count("*").alias("total"))
    each = baseline.select(*ROOT, F.explode("services").alias("service")).groupBy(*ROOT, "service").agg(F.count("*").alias("variants"))
    j = each.join(total, ROOT).withColumn("root_service", S.service_of(F.col("root_op")))
    j = with_threshold(j, thresholds, "missing_service_dominance_threshold", default, "root_service")
    return j.where(F.col("variants") / F.col("total") >= F.col("missing_service_dominance_threshold")).select(*ROOT, "service", "variants", "total")


def auto_no_missing(baseline: DataFrame, thresholds: DataFrame | None = None, peer_min: int = 9, absent: float = 0.2) -> DataFrame:
    """Root ops to exempt from missing-service checks: a dominant other service starts traces itself (at least
    ``peer_min`` in all), or lacks in ``absent`` of at least two variants."""
    b = baseline.withColumn("service", S.service_of(F.col("root_op")))
    peers = b.groupBy("environment", "service").agg(F.sum("occurrences").alias("own")).where(F.col("own") >= peer_min)
    d = dominant_services(established(baseline), thresholds).where(F.col("service") != S.service_of(F.col("root_op")))
    d = d.join(peers, ["environment", "service"], "left")
    peer, optional = F.col("own").isNotNull(), (F.col("total") >= 2) & ((F.col("total") - F.col("variants")) / F.col("total") >= absent)
    return d.where(peer | optional).groupBy(*ROOT).agg(F.max(peer).alias("peer"), F.array_join(F.array_sort(F.collect_set("service")), ",").alias("because"))


def service_union(df: DataFrame, name: str, column: str = "services") -> DataFrame:
    """Per root op the sorted union of an array of services: exploded first, so a row only ever gathers distinct names, combined
    before the shuffle, however many traces or entries there are."""
    each = df.select(*ROOT, F.explode(column).alias("s"))
    return each.groupBy(*ROOT).agg(F.array_sort(F.collect_set("s")).alias(name))


def span_bounds(baseline: DataFrame) -> DataFrame:
    top = F.coalesce(F.nullif("span_count_max", F.lit(0)), "span_count")
    low = F.coalesce(F.nullif("span_count_min", F.lit(0)), "span_count")
    return baseline.groupBy(*ROOT).agg(F.max(top).alias("span_max"), F.coalesce(F.min(F.when(low > 0, low)), F.lit(0)).alias("span_min"))


def p10_span_count(baseline: DataFrame, least: int = 2) -> DataFrame:
    counts = F.array_sort(F.collect_list(F.when(F.col("span_count") > 0, F.col("span_count"))))
    p = established_stream(baseline, least).groupBy(*ROOT).agg(counts.alias("c")).where(F.size("c") > 0)
    return p.select(*ROOT, F.element_at("c", (F.floor((F.size("c") - 1) * 0.10) + 1).cast("int")).alias("p10"))


def max_span_count(baseline: DataFrame, least: int = 2) -> DataFrame:
    return established(baseline, least).groupBy(*ROOT).agg(F.max("span_count").alias("max_span_count"))


def established_root_ops(baseline: DataFrame, least: int = 2) -> DataFrame:
    ok = (F.col("occurrences") >= least) | F.col("auto_promoted")
    return baseline.groupBy(*ROOT).agg(F.max(ok).alias("ok"), F.max("no_missing_service").alias("exempt")).where("ok and not exempt").select(*ROOT)


def services_for_root_op(baseline: DataFrame, least: int = 2) -> DataFrame:
    return service_union(established_stream(baseline, least), "services")


def fps_per_root_op(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy(*ROOT).agg(F.count("*").alias("fingerprints"))


def list_patterns(baseline: DataFrame) -> DataFrame:
    return baseline.orderBy("root_op", F.desc("occurrences"), "fp_hash")


# ---- merging and comparing


def merge_trace_baselines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of hashes; the entry with more occurrences wins (``a`` on ties), flags of either stay."""
    rest = [c for c in a.columns if c not in KEY]
    j = a.select(*KEY, F.struct(*rest).alias("x")).join(b.select(*KEY, F.struct(*rest).alias("y")), KEY, "full_outer")
    win = F.when(F.col("x").isNull() | (F.col("y.occurrences") > F.col("x.occurrences")), F.col("y")).otherwise(F.col("x"))
    flags = ("auto_promoted", "no_missing_service")
    either = lambda c: (F.coalesce(F.col(f"x.{c}"), F.lit(False)) | F.coalesce(F.col(f"y.{c}"), F.lit(False))).alias(c)
    return j.withColumn("w", win).select(*KEY, *[either(c) if c in flags else F.col(f"w.{c}").alias(c) for c in rest])


def merge_error_baselines(a: DataFrame, b: DataFrame) -> DataFrame:
    key = ["environment", "sig_hash"]
    rest = [c for c in a.columns if c not in key]
    j = a.select(*key, F.struct(*rest).alias("x")).join(b.select(*key, F.struct(*rest).alias("y")), key, "full_outer")
    win = F.when(F.col("x").isNull() | (F.col("y.occurrences") > F.col("x.occurrences")), F.col("y")).otherwise(F.col("x"))
    return j.withColumn("w", win).select(*key, *[F.col(f"w.{c}").alias(c) for c in rest])


def add_promoted(base: DataFrame, other: DataFrame) -> DataFrame:
    new = other.where("auto_promoted and root_op <> '' and path <> ''").join(base.select(*KEY), KEY, "left_anti")
    return base.unionByName(new.select(*base.columns))


def snapshot_diff(cur: DataFrame, snap: DataFrame) -> DataFrame:
    """added, removed or changed (other path or services) per hash."""
    j = cur.select(*KEY, F.struct("path", "services").alias("x"), F.col("root_op").alias("rx")).join(snap.select(*KEY, F.struct("path", "services").alias("y"), F.col("root_op").alias("ry")), KEY, "full_outer")
    kind = F.when(F.col("y").isNull(), "added").when(F.col("x").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return j.withColumn("change", kind).where("change is not null").select(*KEY, F.coalesce("rx", "ry").alias("root_op"), "change")


def hash_diff(cur: DataFrame, snap: DataFrame) -> DataFrame:
    c, s = cur.select(*KEY).distinct(), snap.select(*KEY).distinct()
    tag = lambda df, side: df.withColumn("side", F.lit(side))
    return tag(c.exceptAll(s), "added").unionByName(tag(s.exceptAll(c), "removed")).unionByName(tag(c.intersect(s), "both"))


def near_duplicates(baseline: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs of entries of one root op whose path tokens overlap by ``threshold`` (Jaccard).

    Two such entries of n tokens at most share one of the n - ceil(threshold n) + 1 rarest tokens of each, so only entries that meet in
    these prefixes are compared: no pair is formed because of the root op or of tokens that most entries have."""
    b = baseline.select(*ROOT, "fp_hash", S.path_tokens(F.col("path")).alias("t")).withColumn("n", F.size("t"))
    each = b.select(*ROOT, "fp_hash", "n", F.explode("t").alias("token"))
    counts = each.groupBy(*ROOT, "token").agg(F.count("*").alias("seen"))
    rarest = Window.partitionBy(*ROOT, "fp_hash").orderBy("seen", "token")
    prefix = each.join(counts, [*ROOT, "token"]).withColumn("place", F.row_number().over(rarest))
    prefix = prefix.where(F.col("place") <= F.col("n") - F.ceil(F.round(F.lit(threshold) * F.col("n"), 9)) + 1).select(*ROOT, "token", "fp_hash", "n")
    side = lambda x: prefix.select(*ROOT, "token", F.col("fp_hash").alias(f"hash_{x}"), F.col("n").alias(f"n{x}"))
    met = side("a").join(side("b"), [*ROOT, "token"]).where(f"hash_a < hash_b and least(na, nb) >= {threshold} * greatest(na, nb)")
    pairs = met.select(*ROOT, "hash_a", "hash_b").distinct()
    tokens = lambda x: b.select(*ROOT, F.col("fp_hash").alias(f"hash_{x}"), F.col("t").alias(f"t{x}"))
    j = pairs.join(tokens("a"), [*ROOT, "hash_a"]).join(tokens("b"), [*ROOT, "hash_b"])
    j = j.withColumn("similarity", S.jaccard(F.col("ta"), F.col("tb"))).where(F.col("similarity") >= threshold)
    return j.select(*ROOT, "hash_a", "hash_b", F.round("similarity", 6).alias("similarity"))


def closest_baseline(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """For fingerprints that the baseline lacks, the entry of the same root op with the most similar edges (Jaccard; ties: the smaller hash; without
    any common edge the smallest hash of the root op).

    Entries are found by edges, the rarest first. The best entry that shares a fingerprint's rarest edge bounds the answer from below: whatever is
    as similar shares that share of its edges, so one of its rarest edges up to that bound. Only entries that meet there are compared."""
    first = F.min_by(F.struct("root_op", "path", "services", "span_count"), F.struct("trace_start", "trace_id")).alias("x")
    new = live.groupBy(*KEY).agg(first).select(*KEY, "x.*").join(baseline.select(*KEY), KEY, "left_anti").withColumn("e", S.path_edges(F.col("path")))
    b = baseline.select(
        *ROOT, F.col("fp_hash").alias("base_hash"), F.col("path").alias("base_path"), F.col("services").alias("base_services"), F.col("span_count").alias("base_span_count")
    ).withColumn("be", S.path_edges(F.col("base_path")))
    held = b.select(*ROOT, "base_hash", F.explode("be").alias("edge"))
    counts = held.groupBy(*ROOT, "edge").agg(F.count("*").alias("seen"))
    mine = new.select(*KEY, "root_op", F.size("e").alias("n"), F.explode("e").alias("edge")).join(counts, [*ROOT, "edge"])  # edges that no entry has find none
    mine = mine.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("seen", "edge")))
    met = lambda edges: edges.join(held, [*ROOT, "edge"]).select(*KEY, "root_op", "base_hash").distinct()
    sets = b.select(*ROOT, "base_hash", "be")
    share = F.size(F.array_intersect("e", "be")) / F.greatest(F.size(F.array_union("e", "be")), F.lit(1))
    measured = lambda pairs: pairs.join(new.select(*KEY, "e"), KEY).join(sets, [*ROOT, "base_hash"]).withColumn("similarity", share)
    bound = measured(met(mine.where("place = 1"))).groupBy(*KEY).agg(F.max("similarity").alias("bound"))
    # of n edges a similar entry shares ceil(bound n): it misses n less that many; edges that no entry has are among those it misses
    known = mine.join(bound, KEY).withColumn("absent", F.col("n") - F.max("place").over(Window.partitionBy(*KEY)))
    wide = known.where(F.col("place") <= F.col("n") - F.ceil(F.round(F.col("bound") * F.col("n"), 9)) - F.col("absent") + 1)
    order = F.struct((-F.col("similarity")).alias("s"), "base_hash")
    best = measured(met(wide)).groupBy(*KEY).agg(F.min(order).alias("best"))
    least = b.groupBy(*ROOT).agg(F.min("base_hash").alias("least"))
    chosen = new.join(least, ROOT).join(best, KEY, "left").withColumn("base_hash", F.coalesce("best.base_hash", "least")).withColumn("similarity", -F.coalesce("best.s", F.lit(0.0)))
    return chosen.drop("best", "least").join(b, [*ROOT, "base_hash"]).withColumn("similarity", F.abs("similarity"))


def diff_fingerprints(pairs: DataFrame) -> DataFrame:
    """Edges and services added, removed and common, for the pairs of :func:`closest_baseline`."""
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return pairs.select(
        *KEY, "root_op", "base_hash", F.size(F.array_except("e", "be")).alias("added"), F.size(F.array_except("be", "e")).alias("removed"), F.size(F.array_intersect("e", "be")).alias("common"),
        (F.col("span_count") - F.col("base_span_count")).alias("span_delta"), text(F.array_except("services", "base_services")).alias("added_services"), text(F.array_except("base_services", "services")).alias("removed_services"), F.round("similarity", 6).alias("similarity"),
    )


def drift_report(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per service: drifted (known root op, other edges or services), new (unknown root op), vanished (root op not live)."""
    fresh = live.select(*KEY, "root_op").distinct().join(baseline.select(*KEY), KEY, "left_anti")
    known = baseline.select(*ROOT).distinct()
    drifted = fresh.join(known, ROOT, "left_semi").withColumn("state", F.lit("drifted"))
    new = fresh.join(known, ROOT, "left_anti").withColumn("state", F.lit("new"))
    gone = known.join(live.select(*ROOT).distinct(), ROOT, "left_anti").withColumn("state", F.lit("vanished")).withColumn("fp_hash", F.lit(""))
    every = drifted.unionByName(new).unionByName(gone.select(*drifted.columns))
    return every.groupBy("environment", S.service_of(F.col("root_op")).alias("service"), "state").agg(F.count("*").alias("n"))


def coverage(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per root op: traces, those with a known hash, the rest, and baseline entries."""
    known = baseline.select(*KEY).distinct().withColumn("hit", F.lit(1))
    traffic = live.join(known, KEY, "left").groupBy(*ROOT).agg(F.count("*").alias("traces"), F.count("hit").alias("matched"))
    j = traffic.join(fps_per_root_op(baseline), ROOT, "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(*ROOT, z("traces").alias("traces"), z("matched").alias("matched"), (z("traces") - z("matched")).alias("unmatched"), z("fingerprints").alias("entries"))


def coverage_status(cov: DataFrame) -> DataFrame:
    """``cov`` with the share that matches, its status, its place (LOW, WARN, NO_TRAFFIC, GOOD, less covered first) and advice."""
    pct = F.round(F.col("matched") * 100.0 / F.nullif("traces", F.lit(0)), 1)
    status = F.when(F.col("traces") == 0, "NO_TRAFFIC").when(pct >= 80, "GOOD").when(pct >= 50, "WARN").otherwise("LOW")
    s = cov.select(*cov.columns, pct.alias("pct"), status.alias("status"))
    idle = F.when(F.col("entries") > 0, "known but idle: extend the window or drop it").otherwise("unknown and idle: nothing to do")
    advice = F.when(F.col("status") == "NO_TRAFFIC", idle).when(F.col("pct") == 0, "nothing matches: learn anew").when(F.col("pct") < 50, "learn over 240 minutes").when(F.col("pct") < 80, "learn over 120 minutes").otherwise("covered")
    rank = F.when(F.col("status") == "LOW", 0).when(F.col("status") == "WARN", 1).when(F.col("status") == "NO_TRAFFIC", 2).otherwise(3)
    return s.withColumn("rank", rank).withColumn("advice", advice).orderBy("rank", F.coalesce("pct", F.lit(101.0)), *ROOT)


# ---- upkeep


def apply_watch_hits(baseline: DataFrame, new: DataFrame, as_of, threshold: int = DEFAULTS.promote_runs) -> DataFrame:
    """Add one hit for each hash of ``new`` (one run's new fingerprints; unknown ones are inserted with one occurrence);
    at ``threshold`` hits an entry is promoted."""
    seen = new.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in ("path", "root_op", "services", "span_count", "edge_count")])
    old = baseline.select(*KEY, F.struct(*[c for c in baseline.columns if c not in KEY]).alias("o"))
    j = old.join(seen, KEY, "full_outer")
    hits = F.coalesce("o.watch_hits", F.lit(0)) + F.col("path").isNotNull().cast("int")
    promote = F.col("path").isNotNull() & (hits >= threshold) & ~F.coalesce("o.auto_promoted", F.lit(False))
    ts = F.lit(as_of).cast("timestamp")
    keep = lambda c, other: F.coalesce(F.col(f"o.{c}"), other).alias(c)
    return j.select(
        *KEY, *[keep(c, F.col(c)) for c in ("path", "root_op", "services", "span_count")], keep("span_count_min", F.col("span_count")), keep("span_count_max", F.col("span_count")), keep("edge_count", F.col("edge_count")),
        keep("occurrences", F.lit(1)), hits.alias("watch_hits"), (F.coalesce("o.auto_promoted", F.lit(False)) | promote).alias("auto_promoted"), F.when(promote, ts).otherwise(F.col("o.promoted_at")).alias("promoted_at"),
        keep("no_missing_service", F.lit(False)), keep("first_seen", ts), keep("last_seen", ts),
    )


def promote_by_count(detections: DataFrame, baseline: DataFrame, threshold: int = DEFAULTS.promote_detections, ingress: str | None = None, warmup_end=None) -> DataFrame:
    """Hashes detected ``threshold`` times that the baseline lacks, with the flag that exempts them from missing checks
    (root ops of the ``ingress`` service are not exempt). A hash seen (``trace_start``) before ``warmup_end`` is promoted at first
    sight. A promoted hash enters with one occurrence."""
    first = F.min("trace_start") if warmup_end is not None else F.lit(None).cast("timestamp")
    n = detections.groupBy(*KEY).agg(F.count("*").alias("detections"), F.min("root_op").alias("root_op"), first.alias("first_seen"))
    warm = F.lit(False) if warmup_end is None else F.col("first_seen") < F.lit(warmup_end).cast("timestamp")
    exempt = F.lit(True) if ingress is None else ~F.col("root_op").startswith(ingress)
    return n.where((F.col("detections") >= threshold) | warm).join(baseline.where("auto_promoted or occurrences >= 2").select(*KEY), KEY, "left_anti").select(*KEY, "root_op", "detections", F.lit(1).alias("occurrences"), exempt.alias("no_missing_service"))


def promote(baseline: DataFrame, as_of, hashes: list[str] | None = None) -> DataFrame:
    pick = ~F.col("auto_promoted") if hashes is None else ~F.col("auto_promoted") & F.col("fp_hash").isin(*hashes)
    return baseline.withColumn("promoted_at", F.when(pick, F.lit(as_of).cast("timestamp")).otherwise(F.col("promoted_at"))).withColumn("auto_promoted", F.col("auto_promoted") | pick)


def decay(baseline: DataFrame, as_of, stale_days: int = 14, prune_days: int = 30) -> DataFrame:
    """Entries that are not promoted lose half of their occurrences after ``stale_days`` and go after ``prune_days``."""
    since = F.coalesce("last_seen", "promoted_at", "first_seen")
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(since)) / 86_400_000_000)
    old = lambda n: ~F.col("auto_promoted") & F.coalesce(days >= n, F.lit(False))
    half = F.greatest(F.floor(F.col("occurrences") / 2), F.lit(1)).cast("bigint")
    return baseline.where(~old(prune_days)).withColumn("occurrences", F.when(old(stale_days), half).otherwise(F.col("occurrences")))


def apply_overrides(baseline: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set no_missing_service by root op; ``overrides(environment, root_op, no_missing_service)``."""
    told = fresh(baseline, "told")
    o = overrides.groupBy(*ROOT).agg(F.max("no_missing_service").alias(told))
    return baseline.join(o, ROOT, "left").withColumn("no_missing_service", F.coalesce(told, "no_missing_service", F.lit(False))).select(*baseline.columns)


def set_override(overrides: DataFrame, entry: DataFrame) -> DataFrame:
    return overrides.join(entry.select(*ROOT), ROOT, "left_anti").unionByName(entry.select(*overrides.columns))


def clear_override(overrides: DataFrame, root_ops: DataFrame) -> DataFrame:
    return overrides.join(root_ops.select(*ROOT), ROOT, "left_anti")


def bootstrap_baseline(fps: DataFrame) -> DataFrame:
    """Every fingerprint of the bootstrap window becomes a promoted entry, unless it is infrastructure-only."""
    b = learn_trace(fps, bootstrap=False, min_occurrences=1)
    return b.withColumn("auto_promoted", F.lit(True)).withColumn("promoted_at", F.col("last_seen"))


def prune_seen(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    return counts.join(baseline.select(*KEY), KEY, "left_anti")


def stale_entries(baseline: DataFrame, windows: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Entries first seen inside an incident window (``windows(environment, start_ms, end_ms)``, ends included). Windows are spread over the
    buckets of time that they cover, so an entry meets those of its own bucket only."""
    bucket = lambda c: F.floor(F.col(c) / bucket_ms)
    first, start = fresh(baseline, "first_ms"), fresh(baseline, "start_ms")
    spread = windows.where("start_ms <= end_ms").select("environment", F.col("start_ms").alias(start), F.col("end_ms").alias("until"), F.explode(F.sequence(bucket("start_ms"), bucket("end_ms"))).alias("bucket"))
    entries = baseline.select(*KEY, "root_op", F.unix_millis("first_seen").alias(first)).withColumn("bucket", bucket(first))
    j = entries.join(spread, ["environment", "bucket"]).where(F.col(first).between(F.col(start), F.col("until")))
    return j.groupBy(*KEY, "root_op").agg(F.min(start).alias("window_start"))


def health_check(trace: DataFrame, errors: DataFrame, windows: DataFrame, as_of) -> DataFrame:
    """Seven checks as rows (environment, check, hash, root_op)."""
    row = lambda df, name, h="fp_hash", r="root_op": df.select("environment", F.lit(name).alias("check"), F.col(h).alias("hash") if h else F.lit("").alias("hash"), F.col(r).alias("root_op") if r else F.lit("").alias("root_op"))
    every = trace.select("environment").unionByName(errors.select("environment")).distinct()
    newest = trace.groupBy("environment").agg(F.max("last_seen").alias("newest"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("newest")) / 86_400_000_000
    pending = trace.where("not auto_promoted")
    checks = [
        row(every.join(trace.select("environment").distinct(), "environment", "left_anti"), "EMPTY_BASELINE", None, None), row(newest.where(age >= 3), "STALE_BASELINE", None, None), row(stale_entries(trace, windows), "STALE_ENTRIES"),
        row(pending.where("occurrences < 2"), "LOW_CONFIDENCE"), row(pending.where("watch_hits >= 8"), "PERSISTENT_NOISE"), row(near_duplicates(trace).withColumnRenamed("hash_a", "fp_hash"), "NEAR_DUPLICATES"),
        row(errors.where(S.is_incident_artifact(F.col("error_type"))), "INCIDENT_ARTIFACTS", "sig_hash", "operation"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def infra_only_root_ops(baseline: DataFrame) -> DataFrame:
    """Root ops all of whose entries call other services, none of which starts a trace of the baseline."""
    roots = baseline.select("environment", S.service_of(F.col("root_op")).alias("s")).distinct().groupBy("environment").agg(F.collect_set("s").alias("roots"))
    others = F.array_except("services", F.array(S.service_of(F.col("root_op"))))
    b = baseline.join(roots, "environment").withColumn("infra", (F.size(others) > 0) & ~F.arrays_overlap(others, F.col("roots")))
    return b.groupBy(*ROOT).agg(F.min("infra").alias("infra")).where("infra").select(*ROOT)


def auto_fix(baseline: DataFrame) -> DataFrame:
    return baseline.where("auto_promoted or occurrences >= 2")


def baseline_summary(trace: DataFrame, errors: DataFrame, as_of) -> DataFrame:
    t = trace.groupBy("environment").agg(
        F.count("*").alias("fingerprints"), F.sum("occurrences").alias("occurrences"), F.countDistinct(S.service_of(F.col("root_op"))).alias("root_services"), F.sum((~F.col("auto_promoted")).cast("int")).alias("pending"), F.max("last_seen").alias("newest"),
    )
    e = errors.groupBy("environment").agg(F.count("*").alias("signatures"), F.array_join(F.array_sort(F.collect_set(F.when(S.is_incident_artifact(F.col("error_type")), F.col("service")))), ",").alias("contaminated"))
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("newest")) / 86_400_000_000)
    return t.join(e, "environment", "left").select("environment", "fingerprints", "occurrences", "root_services", "pending", F.coalesce("signatures", F.lit(0)).alias("signatures"), F.coalesce("contaminated", F.lit("")).alias("contaminated"), days.alias("age_days"), (days > 7).alias("stale"))


def health_brief(summary: DataFrame) -> DataFrame:
    """Warnings of the short check: stale, empty, contaminated, pending."""
    tests = (("stale", F.col("stale")), ("empty", F.col("fingerprints") == 0), ("contaminated", F.col("contaminated") != ""), ("pending", F.col("pending") > 5))
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    return summary.select("environment", F.explode(found).alias("warning"))


def stale_baseline(loaded: DataFrame, promotions: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Baselines (``environment, loaded_at``) older than ``hours`` with promotions (``environment, ts``) since they were loaded."""
    since = promotions.join(loaded, "environment").where("ts > loaded_at").groupBy("environment").agg(F.count("*").alias("promotions"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("loaded_at")) / 3_600_000_000
    return loaded.withColumn("age_h", F.floor(age)).where(F.col("age_h") >= hours).join(since, "environment").select("environment", "age_h", "promotions")
