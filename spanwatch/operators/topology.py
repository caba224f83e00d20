"""The service graph: edges, summary, changes, and walks over it. Walks are rounds of joins on edge tables, each from what the
round before found newly, until nothing is new or a given number of hops is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.functions import scalars as S
from spanwatch.lineage import stored
from spanwatch.operators.correlate import top_messages
from spanwatch.operators.traces import TRACE, resolve_parents, trace_edges

EDGE = ["environment", "caller", "callee"]


def topology_edges(spans: DataFrame, explicit: bool = False) -> DataFrame:
    """Cross-service calls: first and last time, and the number of traces that make them."""
    e = trace_edges(resolve_parents(spans, explicit)).where("from_service <> to_service")
    e = e.groupBy(*TRACE, F.col("from_service").alias("caller"), F.col("to_service").alias("callee")).agg(F.min("start_us").alias("ts"))
    return e.groupBy(*EDGE).agg(F.min("ts").alias("first_us"), F.max("ts").alias("last_us"), F.count("*").alias("n"))


def topology_drift(edges: DataFrame, base: DataFrame) -> DataFrame:
    return edges.join(base.select(*EDGE), EDGE, "left_anti")


# Registries and consoles, never a cause nor a shared dependency.
INFRA = ("discovery-server", "config-server", "eureka-server", "eureka", "admin-server")


def topology_summary(edges: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Per node: callers, callees, whether it is inferred (called, but not one of ``services(environment, service)``; none is without
    these), an ingress (a service that nothing calls), a database (an inferred one by its name), calls a database, is shared."""
    e = edges.where("caller <> callee").select(*EDGE).distinct()
    out = e.groupBy("environment", F.col("caller").alias("service")).agg(F.count("*").alias("callees"))
    into = e.groupBy("environment", F.col("callee").alias("service")).agg(F.count("*").alias("callers"))
    key = ["environment", "service"]
    j = out.join(into, key, "full_outer").na.fill(0, ["callees", "callers"])
    if services is None:
        j = j.withColumn("inferred", F.lit(False)).withColumn("db", S.is_db_node(F.col("service")))
    else:
        own = services.select(*key).distinct().withColumn("own", F.lit(True))
        j = j.join(own, key, "full_outer").na.fill(0, ["callees", "callers"]).withColumn("inferred", F.col("own").isNull())
        j = j.withColumn("db", F.col("inferred") & (S.is_db_node(F.col("service")) | F.col("service").contains(":")))
    db = j.where("db").select("environment", F.col("service").alias("callee"))
    callers = e.join(db, ["environment", "callee"], "left_semi").select("environment", F.col("caller").alias("service")).distinct().withColumn("db_caller", F.lit(True))
    j = j.join(callers, key, "left")
    return j.select(*key, "callers", "callees", "inferred", ((F.col("callers") == 0) & ~F.col("inferred")).alias("ingress"), "db", F.coalesce("db_caller", F.lit(False)).alias("calls_db"), (F.col("callers") >= 2).alias("shared"))


def topology_delta(observed: DataFrame, base: DataFrame) -> DataFrame:
    """New nodes and edges against a base graph."""
    nodes = lambda e: e.select("environment", F.col("caller").alias("node")).unionByName(e.select("environment", F.col("callee").alias("node"))).distinct()
    new_nodes = nodes(observed).join(nodes(base), ["environment", "node"], "left_anti").select("environment", F.lit("node").alias("kind"), F.col("node").alias("name"))
    new_edges = topology_drift(observed, base).select("environment", F.lit("edge").alias("kind"), F.concat_ws("->", "caller", "callee").alias("name"))
    return new_nodes.unionByName(new_edges)


def new_services(now: DataFrame, base: DataFrame) -> DataFrame:
    return now.select("environment", "service").distinct().join(base.select("environment", "service").distinct(), ["environment", "service"], "left_anti")


def diff_environments(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """new, updated or removed environments, with the number of services that differ."""
    j = cur.select("environment", F.col("services").alias("c")).join(prev.select("environment", F.col("services").alias("p")), "environment", "full_outer")
    none = F.expr("cast(array() as array<string>)")
    c, p = F.coalesce("c", none), F.coalesce("p", none)
    n = F.size(F.array_except(c, p)) + F.size(F.array_except(p, c))
    kind = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "removed").when(n > 0, "updated")
    return j.select("environment", kind.alias("change"), n.alias("differ")).where("change is not null")


def graph_from_baseline(baseline: DataFrame, infra: tuple[str, ...] = INFRA) -> DataFrame:
    """Weighted edges from the paths of a baseline: neighbouring services of each path, forward only (to a service not seen
    earlier in it), weighted by occurrences; without edges from or to ``infra``."""
    p = baseline.select("environment", "fp_hash", "occurrences", F.posexplode(F.transform(F.split("path", " -> "), lambda t: F.substring_index(t, ":", 1))).alias("pos", "service"))
    key = Window.partitionBy("environment", "fp_hash")
    p = p.withColumn("before", F.lag("service").over(key.orderBy("pos"))).withColumn("seen", F.min("pos").over(Window.partitionBy("environment", "fp_hash", "service")))
    e = p.where("before is not null and before <> service and pos = seen")
    e = e.where(~F.col("before").isin(*infra) & ~F.col("service").isin(*infra))
    return e.groupBy("environment", F.col("before").alias("caller"), F.col("service").alias("callee")).agg(F.sum("occurrences").alias("weight"))


def reachable(edges: DataFrame, start: DataFrame, depth: int | None = None, down: bool = True) -> DataFrame:
    """Nodes that each node of ``start(environment, node)`` reaches: (environment, origin, node, hops), the origin at 0.

    With ``depth`` at most that many hops; else until a round finds nothing new, each round written to a table."""
    src, dst = ("caller", "callee") if down else ("callee", "caller")
    step = edges.select("environment", F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    seen = start.select("environment", F.col("node").alias("origin"), "node").distinct().withColumn("hops", F.lit(0))
    if depth is None:
        step, seen = stored(step, "steps"), stored(seen, "reached")
    frontier, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        near = frontier.join(step, ["environment", "node"]).select("environment", "origin", F.col("next").alias("node")).distinct()
        frontier = near.join(seen.select("environment", "origin", "node"), ["environment", "origin", "node"], "left_anti").withColumn("hops", F.lit(hop))
        if depth is None:
            frontier = stored(frontier, "reached")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def deepest(calls: DataFrame, start: DataFrame) -> DataFrame:
    """Where each node of ``start(environment, node)`` leads: (environment, origin, node). From a node the walk goes to the callee of the heaviest
    call (``calls(environment, caller, callee, weight)``), of equal ones to the first by name; it ends where there is none, or at a node that it
    comes to for the second time. Each round is a join of the walks that go on, written to a table, until none does."""
    first = F.min(F.struct((-F.col("weight")).alias("w"), "callee")).alias("f")
    step = stored(calls.groupBy("environment", F.col("caller").alias("node")).agg(first).select("environment", "node", F.col("f.callee").alias("next")), "steps")
    walks = stored(start.select("environment", F.col("node").alias("origin"), "node").distinct(), "walks")
    been, ended = walks, None
    key = ["environment", "origin", "node"]
    while True:
        moved = walks.join(step, ["environment", "node"], "left")
        back = been.select("environment", "origin", F.col("node").alias("next"), F.lit(True).alias("back"))
        moved = stored(moved.join(back, ["environment", "origin", "next"], "left"), "walks")
        over = moved.where("next is null or back").select("environment", "origin", F.coalesce("next", "node").alias("node"))
        ended = over if ended is None else ended.unionByName(over)
        walks = moved.where("next is not null and back is null").select("environment", "origin", F.col("next").alias("node"))
        if walks.isEmpty():
            return ended.select(*key)
        been = been.unionByName(walks)


def shared_deps(edges: DataFrame, nodes: DataFrame, infra: tuple[str, ...] = INFRA) -> DataFrame:
    """Services other than ``infra`` that two or more of ``nodes(environment, node)`` call."""
    calls = edges.where("caller <> callee").where(~F.col("callee").isin(*infra)).join(nodes.select("environment", F.col("node").alias("caller")).distinct(), ["environment", "caller"], "left_semi")
    return calls.groupBy("environment", "callee").agg(F.countDistinct("caller").alias("callers")).where("callers >= 2")


def node_signals(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anomalies of the given nodes: types, count and the first three messages in time."""
    key = ["environment", "service"]
    e = events.join(nodes.select("environment", F.col("node").alias("service")).distinct(), key, "left_semi")
    g = e.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("anomaly_type")), ",").alias("types"), F.count("*").alias("n"))
    return g.join(top_messages(e, 3), key)


def root_candidates(edges: DataFrame, active: DataFrame, lead_ms: int = 5_000, infra: tuple[str, ...] = INFRA) -> DataFrame:
    """Services that may be the cause, (environment, candidate, supporters, rules): the affected service at which the walk of each affected
    one over its heaviest calls to affected services ends (deepest; supporters: how many walks do), every missing service
    (missing), and services that fired ``lead_ms`` or more before all affected ones that they call (earlier).

    ``edges`` may weigh calls by ``weight`` or ``n``; without either all weigh the same."""
    a = active.groupBy("environment", F.col("service").alias("node")).agg(F.min("ts_ms").alias("first_ms"), F.max(F.col("anomaly_type") == "MISSING_SERVICE").alias("missing"))
    weight = next((F.sum(c) for c in ("weight", "n") if c in edges.columns), F.lit(1))
    calls = edges.groupBy(*EDGE).agg(weight.alias("weight"))
    end = lambda side: a.select("environment", F.col("node").alias(side), F.col("first_ms").alias(side + "_ms"))
    inner = calls.join(end("caller"), ["environment", "caller"]).join(end("callee"), ["environment", "callee"])
    far = deepest(inner.where(~F.col("callee").isin(*infra)), a).select("environment", F.col("node").alias("candidate"), F.lit("deepest").alias("rule"))
    gone = a.where("missing").select("environment", F.col("node").alias("candidate"), F.lit("missing").alias("rule"))
    lead = inner.where("caller <> callee").groupBy("environment", F.col("caller").alias("candidate")).agg(F.min(F.col("callee_ms") - F.col("caller_ms")).alias("lead"))
    early = lead.where(F.col("lead") >= lead_ms).select("environment", "candidate", F.lit("earlier").alias("rule"))
    every = far.unionByName(gone).unionByName(early)
    rules = F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules")
    return every.groupBy("environment", "candidate").agg(F.count(F.when(F.col("rule") == "deepest", 1)).alias("supporters"), rules)


def causal_chain(edges: DataFrame, active: DataFrame, roots: DataFrame) -> DataFrame:
    """Affected callers of each root cause (``roots(environment, node)``), their affected callers and so on, breadth first."""
    a = active.select("environment", F.col("service").alias("caller")).distinct()
    return reachable(edges.join(a, ["environment", "caller"], "left_semi"), roots, down=False)


# Anomalies that don't speak for a cause of their own.
SOFT = ("NEW_FINGERPRINT", "SPAN_COUNT_SPIKE", "SPAN_COUNT_DROP", "LATENCY_ANOMALY")


def secondary_services(edges: DataFrame, events: DataFrame, roots: DataFrame) -> DataFrame:
    """Services with soft anomalies only that can reach a root cause."""
    soft = events.groupBy("environment", "service").agg(F.min(F.col("anomaly_type").isin(*SOFT)).alias("soft")).where("soft").select("environment", "service")
    up = reachable(edges, roots, down=False).where("hops > 0").select("environment", F.col("node").alias("service")).distinct()
    return soft.join(up, ["environment", "service"], "left_semi")


def caller_markers(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct callers of missing services that have no anomaly of their own."""
    missing = events.where("anomaly_type = 'MISSING_SERVICE'").select("environment", F.col("service").alias("callee")).distinct()
    callers = edges.join(missing, ["environment", "callee"], "left_semi").select("environment", F.col("caller").alias("service")).distinct()
    return callers.join(events.select("environment", "service").distinct(), ["environment", "service"], "left_anti").withColumn("anomaly_type", F.lit("NEW_FINGERPRINT"))


def unknown_nodes(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Services with anomalies that the graph lacks: (environment, service, caller), the caller being the service of a root op
    of theirs where the graph has it (a row each; null where it has none)."""
    side = lambda c: edges.select("environment", F.col(c).alias("service"))
    nodes = side("caller").unionByName(side("callee")).distinct()
    new = events.select("environment", "service", S.service_of(F.col("root_op")).alias("caller")).distinct().join(nodes, ["environment", "service"], "left_anti")
    told = new.join(nodes.select("environment", F.col("service").alias("caller")), ["environment", "caller"], "left_semi").where("caller <> service")
    return new.select("environment", "service").distinct().join(told, ["environment", "service"], "left").select("environment", "service", "caller")


# How strongly a type of anomaly points to its own service.
TYPE_WEIGHTS = {
    "MISSING_SERVICE": 1.0, "ERROR_RATE_ANOMALY": 0.85, "NEW_ERROR_SIGNATURE": 0.7, "SPAN_COUNT_DROP": 0.65, "LATENCY_ANOMALY": 0.5, "SPAN_COUNT_SPIKE": 0.45, "NEW_FINGERPRINT": 0.3,
}
OTHER_WEIGHT = 0.1


def confidence(edges: DataFrame, active: DataFrame, candidates: DataFrame) -> DataFrame:
    """Score of each candidate with anomalies: its heaviest type (0.6), the larger share of the other affected services that call it
    or that it calls (0.25; 0 if it and an affected one call each other), how early it fired (0.01 for the first), 0.3 if it
    is only missing; at most 1."""
    env = ["environment"]
    kinds = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])
    weighed = active.withColumn("weight", F.coalesce(F.try_element_at(kinds, F.col("anomaly_type")), F.lit(OTHER_WEIGHT)))
    a = weighed.groupBy("environment", "service").agg(F.max("weight").alias("weight"), F.min("ts_ms").alias("first_ms"), F.min(F.col("anomaly_type") == "MISSING_SERVICE").alias("only_missing"))
    bounds = active.groupBy("environment").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"), F.countDistinct("service").alias("affected"))
    end = lambda side: a.select("environment", F.col("service").alias(side))
    calls = edges.where("caller <> callee").select(*EDGE).distinct()
    into = calls.join(end("caller"), [*env, "caller"], "left_semi").groupBy("environment", F.col("callee").alias("candidate")).agg(F.count("*").alias("callers"))
    hit = calls.join(end("callee"), [*env, "callee"], "left_semi")
    back = calls.select("environment", F.col("caller").alias("callee"), F.col("callee").alias("caller"), F.lit(1).alias("back"))
    out = hit.join(back, EDGE, "left").groupBy("environment", F.col("caller").alias("candidate")).agg(F.count("*").alias("callees"), F.count("back").alias("cycles"))
    key = ["environment", "candidate"]
    j = candidates.select(*key).join(a.withColumnRenamed("service", "candidate"), key).join(bounds, env).join(into, key, "left").join(out, key, "left").na.fill(0, ["callers", "callees", "cycles"])
    shares = F.when(F.col("cycles") > 0, 0.0).otherwise(F.greatest("callers", "callees") / F.greatest(F.col("affected") - 1, F.lit(1)))
    early = 1 - (F.col("first_ms") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    score = F.col("weight") * 0.6 + shares * 0.25 + early * 0.01 + F.when(F.col("only_missing"), 0.3).otherwise(0.0)
    return j.select(*key, F.round(F.least(score, F.lit(1.0)), 9).alias("confidence"))


def hypotheses(edges: DataFrame, events: DataFrame, deployments: DataFrame) -> DataFrame:
    """Explanations of affected services, one DataFrame per rule: shared dependency, failed callee, own change, change of
    a caller, cascade. An own change is a deployment, or a new path of a service that calls nothing. Ranked per environment by directness, confidence, number explained and name."""
    a = events.select("environment", "service").distinct()
    kinds = events.groupBy("environment", "service").agg(F.max((F.col("anomaly_type") == "MISSING_SERVICE").cast("int")).alias("missing"), F.max((F.col("anomaly_type") == "NEW_FINGERPRINT").cast("int")).alias("fresh"))
    calls = edges.where("caller <> callee").join(a.withColumnRenamed("service", "caller"), ["environment", "caller"], "left_semi")
    deployed = deployments.select("environment", "service").distinct()
    made = lambda df, kind, cause, direct, conf, n: df.select("environment", F.lit(kind).alias("kind"), F.col(cause).alias("cause"), direct.alias("direct"), conf.alias("confidence"), n.cast("bigint").alias("explains"))
    shared = calls.groupBy("environment", "callee").agg(F.countDistinct("caller").alias("n")).where("n >= 2")
    failed = calls.join(kinds.withColumnRenamed("service", "callee"), ["environment", "callee"]).groupBy("environment", "callee").agg(F.countDistinct("caller").alias("n"), F.max("missing").alias("m"))
    own = kinds.join(deployed, ["environment", "service"], "left_semi")
    down = edges.where("caller <> callee").select("environment", F.col("caller").alias("service")).distinct()
    alone = kinds.where("fresh = 1").join(deployed, ["environment", "service"], "left_anti").join(down, ["environment", "service"], "left_anti")
    upstream = edges.where("caller <> callee").join(a.withColumnRenamed("service", "callee"), ["environment", "callee"], "left_semi").join(deployed.withColumnRenamed("service", "caller"), ["environment", "caller"], "left_semi").groupBy("environment", "caller").agg(F.countDistinct("callee").alias("n"))
    cascade = calls.join(a.withColumnRenamed("service", "callee"), ["environment", "callee"], "left_semi").groupBy("environment", "callee").agg(F.countDistinct("caller").alias("n")).where("n >= 3")
    every = (
        made(shared, "shared_dependency", "callee", F.lit(False), F.lit(0.6), F.col("n")).unionByName(made(failed, "downstream_failure", "callee", F.col("m") == 1, F.when(F.col("m") == 1, 0.9).otherwise(0.7), F.col("n")))
        .unionByName(made(own, "self_change", "service", F.lit(True), F.when(F.col("fresh") == 1, 0.8).otherwise(0.65), F.lit(1))).unionByName(made(alone, "self_change", "service", F.lit(False), F.lit(0.5), F.lit(1))).unionByName(made(upstream, "upstream_change", "caller", F.lit(False), F.lit(0.5), F.col("n"))).unionByName(made(cascade, "cascade", "callee", F.lit(False), F.lit(0.55), F.col("n")))
    )
    return rank_hypotheses(every)


def rank_hypotheses(h: DataFrame) -> DataFrame:
    w = Window.partitionBy("environment").orderBy(F.desc("direct"), F.desc("confidence"), F.desc("explains"), "kind", "cause")
    return h.withColumn("place", F.row_number().over(w))
