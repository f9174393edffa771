"""Candidate pairs, scored relationships and root-cause ranking of evidence.

Evidence rows are first brought to one shape by ``prepare``: blank texts are
missing, and a missing value never equals anything. Everything works within
one analysis. Neighbour bounds are expressed as equi-joins on buckets of
positions, so no join looks at all pairs of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenlog.functions.text import blank_to_null
from lumenlog.operators.graph import connected_components, dag_edges, reachable_counts
from lumenlog.operators.ranking import position
from lumenlog.session import cut

# Strengths, and the weight of each signal in each format.
STRENGTH = {"VH": 1.0, "H": 0.85, "M": 0.60, "L": 0.30}
WEIGHTS = {
    "opentelemetry": {"PARENT_SPAN": "VH", "SPAN_ID": "VH", "TRACE_ID": "VH", "REQUEST_ID": "H", "RESOLVED_IDENTITY": "H", "SERVICE": "M"},
    "json": {"PARENT_SPAN": "VH", "SPAN_ID": "VH", "TRACE_ID": "VH", "REQUEST_ID": "VH", "RESOLVED_IDENTITY": "H", "SERVICE": "M", "MODULE": "M", "EXCEPTION": "M"},
    "web_server": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "HOST": "M", "ENDPOINT": "M", "HTTP_STATUS": "M"},
    "container": {"PARENT_SPAN": "VH", "SPAN_ID": "VH", "TRACE_ID": "VH", "REQUEST_ID": "VH", "SERVICE": "M", "MODULE": "M", "CONTAINER": "H", "POD": "H", "EXCEPTION": "M"},
    "database": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "SERVICE": "H", "EXCEPTION": "H", "FINGERPRINT": "M"},
    "cloud_gateway": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "HOST": "M", "ENDPOINT": "H", "HTTP_STATUS": "M"},
    "serverless": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "SERVICE": "H", "EXCEPTION": "M"},
    "syslog": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "SERVICE": "M", "HOST": "H", "EXCEPTION": "M"},
    "message_broker": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "SERVICE": "H", "FINGERPRINT": "M"},
    "browser": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "ENDPOINT": "H", "HTTP_STATUS": "M", "EXCEPTION": "M"},
    "ci_cd": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "SERVICE": "M", "EXCEPTION": "M", "SOURCE": "M"},
    "stack_trace": {"TRACE_ID": "VH", "REQUEST_ID": "VH", "MODULE": "H", "EXCEPTION": "H", "FINGERPRINT": "H", "SOURCE": "H"},
    "generic": {"PARENT_SPAN": "VH", "SPAN_ID": "VH", "TRACE_ID": "VH", "REQUEST_ID": "VH", "RESOLVED_IDENTITY": "H", "SERVICE": "M", "MODULE": "M", "EXCEPTION": "M", "FINGERPRINT": "M"},
    "image": {"PARENT_SPAN": "VH", "SPAN_ID": "VH", "TRACE_ID": "VH", "REQUEST_ID": "VH", "RESOLVED_IDENTITY": "H", "SERVICE": "M", "MODULE": "M", "EXCEPTION": "M", "FINGERPRINT": "M"},
}
#: signal -> column, for signals that are plain equality.
EQUALITY = {
    "TRACE_ID": "trace_id", "REQUEST_ID": "request_id", "SPAN_ID": "span_id", "SERVICE": "service", "MODULE": "module", "HOST": "host",
    "CONTAINER": "container", "POD": "pod", "ENDPOINT": "endpoint", "EXCEPTION": "event_type", "FINGERPRINT": "fingerprint",
}
STRUCTURAL = ("SERVICE", "MODULE", "HOST", "CONTAINER", "POD", "ENDPOINT", "EXCEPTION", "FINGERPRINT", "SOURCE")
FULL_GROUP, NEIGHBOURS = 128, 32
TEMPORAL_NEIGHBOURS, WINDOW_MS = 40, 5000.0
IDENTITY_KEYS = ("trace_id", "request_id", "resolved_identity", "span_id")
TEXTS = ("trace_id", "request_id", "span_id", "parent_span_id", "service", "module", "host", "container", "pod", "endpoint", "event_type", "fingerprint", "source_format", "resolved_identity", "severity")


def prepare(evidence: DataFrame) -> DataFrame:
    """Evidence with blank texts as NULL and every column the operators look at.

    Missing columns count as NULL; source_locations is an array of
    'path:line' texts and empty where unknown.
    """
    have = set(evidence.columns)
    cols = ["id", "analysis_id", "artifact_id", "first_seen", "http_status"]
    text = [blank_to_null(F.col(c)).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in TEXTS]
    places = F.col("source_locations") if "source_locations" in have else F.array().cast("array<string>")
    return evidence.select(*cols, *text, places.alias("source_locations"))


def weight(fmt: Column, signal: str) -> Column:
    """Weight of a signal for a format, NULL where the format lacks it."""
    table = {f: STRENGTH[w[signal]] for f, w in WEIGHTS.items() if signal in w}
    if not table:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), fmt)


def delta_ms(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1000.0)


def temporal_score(delta: Column) -> Column:
    return F.when(delta >= 0, 1.0 / (1.0 + delta / 1000.0)).otherwise(0.0)


def signals(a: str, b: str) -> Column:
    """array<struct<signal, strength>> that the rows under prefixes a and b share."""
    l, r = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))

    def both(signal: str, same: Column) -> Column:
        wl, wr = weight(l("source_format"), signal), weight(r("source_format"), signal)
        return F.when(same & wl.isNotNull() & wr.isNotNull(), F.struct(F.lit(signal).alias("signal"), F.least(wl, wr).alias("strength")))

    found = [both(s, l(c) == r(c)) for s, c in EQUALITY.items()]
    shares = lambda c: F.coalesce(l(c) == r(c), F.lit(False))
    found.append(both("RESOLVED_IDENTITY", (l("resolved_identity") == r("resolved_identity")) & ~shares("trace_id") & ~shares("request_id")))
    found.append(both("SOURCE", F.arrays_overlap(l("source_locations"), r("source_locations"))))
    found.append(both("HTTP_STATUS", (l("http_status") == r("http_status")) & (l("http_status") >= 400)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def identity_pairs(rows: DataFrame, *, full: int = FULL_GROUP, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(analysis_id, lo, hi): distinct pairs of rows that share an identifier.

    Groups up to ``full`` rows give all pairs, larger ones each row with its
    next ``neighbours`` in the order of time (missing first) and id.
    """
    keyed = rows.select("analysis_id", "id", "first_seen", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in IDENTITY_KEYS))).alias("x"))
    keyed = keyed.select("analysis_id", "id", "first_seen", "x.kind", "x.key").filter("key is not null")
    ranked = position(keyed, ["analysis_id", "kind", "key"], [F.col("first_seen").asc_nulls_first(), F.col("id")], size="n")
    ranked = ranked.withColumn("b", F.when(F.col("n") <= full, 0).otherwise(F.floor(F.col("pos") / neighbours)).cast("bigint"))
    left = ranked.select("analysis_id", "kind", "key", "n", F.col("id").alias("l"), F.col("pos").alias("lp"), F.explode(F.when(F.col("n") <= full, F.array(F.lit(0).cast("bigint"))).otherwise(F.array("b", F.col("b") + 1))).alias("b"))
    right = ranked.select("analysis_id", "kind", "key", "b", F.col("id").alias("r"), F.col("pos").alias("rp"))
    reach = F.when(F.col("n") <= full, F.col("n")).otherwise(neighbours)
    pairs = left.join(right, ["analysis_id", "kind", "key", "b"]).filter((F.col("rp") > F.col("lp")) & (F.col("rp") - F.col("lp") <= reach) & (F.col("l") != F.col("r")))
    return pairs.select("analysis_id", F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi")).distinct()


def parent_pairs(rows: DataFrame) -> DataFrame:
    """(analysis_id, parent, child): at most one parent per child by its parent span.

    The traces must agree where both are known and both formats must carry
    parent links; of several rows with the span the first in time and id is it.
    """
    linked = rows.filter(weight(F.col("source_format"), "PARENT_SPAN").isNotNull())
    order = F.struct(F.col("first_seen").isNotNull().alias("k"), F.col("first_seen").alias("t"), F.col("id").alias("id"))
    spans = linked.filter("span_id is not null").select("analysis_id", F.col("span_id").alias("_span"), F.col("trace_id").alias("_trace"), order.alias("_p"))
    kids = linked.filter("parent_span_id is not null").select("analysis_id", F.col("id").alias("child"), F.col("parent_span_id").alias("_span"), F.col("trace_id").alias("_trace"), F.coalesce(F.col("span_id") == F.col("parent_span_id"), F.lit(False)).alias("_self"))
    # spans that recur are reduced to their first row before the join, so that none multiplies
    by_trace = spans.filter("_trace is not null").groupBy("analysis_id", "_span", "_trace").agg(F.min("_p").alias("_p"))
    untraced = spans.filter("_trace is null").groupBy("analysis_id", "_span").agg(F.min("_p").alias("_p"))
    whole = spans.groupBy("analysis_id", "_span").agg(F.min("_p").alias("_p"))
    plain = kids.filter(~F.col("_self"))
    found = [
        plain.filter("_trace is not null").join(by_trace, ["analysis_id", "_span", "_trace"]).select("analysis_id", "child", "_p"),
        plain.filter("_trace is not null").join(untraced, ["analysis_id", "_span"]).select("analysis_id", "child", "_p"),
        plain.filter("_trace is null").join(whole, ["analysis_id", "_span"]).select("analysis_id", "child", "_p"),
    ]
    # a row that names its own span as parent must not find itself
    own = kids.filter("_self").alias("c").join(spans.alias("p"), ["analysis_id", "_span"]).filter((F.col("p._p.id") != F.col("c.child")) & F.coalesce(F.col("p._trace") == F.col("c._trace"), F.lit(True)))
    every = reduce(DataFrame.unionByName, [*found, own.select("analysis_id", "child", F.col("p._p").alias("_p"))])
    return every.groupBy("analysis_id", "child").agg(F.min("_p")["id"].alias("parent")).select("analysis_id", "parent", "child")


def temporal_pairs(rows: DataFrame, *, window_ms: float = WINDOW_MS, neighbours: int = TEMPORAL_NEIGHBOURS) -> DataFrame:
    """(analysis_id, lo, hi): rows close in time with enough in common.

    Each row meets at most ``neighbours`` rows before it within the window;
    rows that share an identifier are left to ``identity_pairs``. The strongest
    structural signal sets how far apart the two may lie, and rows of
    different artifacts need two structural signals.
    """
    timed = rows.filter("first_seen is not null")
    ranked = position(timed, ["analysis_id"], [F.col("first_seen"), F.col("id")])
    ranked = ranked.withColumn("b", F.floor(F.col("pos") / neighbours).cast("bigint"))
    left = ranked.withColumn("b", F.explode(F.array("b", F.col("b") + 1)))
    on = (F.col("l.analysis_id") == F.col("r.analysis_id")) & (F.col("l.b") == F.col("r.b"))
    gap = F.col("r.pos") - F.col("l.pos")
    delta = delta_ms(F.col("l.first_seen"), F.col("r.first_seen"))
    pairs = left.alias("l").join(ranked.alias("r"), on).filter(gap.between(1, neighbours) & (delta <= window_ms))
    shares = reduce(lambda x, y: x | y, (F.coalesce(F.col(f"l.{k}") == F.col(f"r.{k}"), F.lit(False)) for k in IDENTITY_KEYS))
    structural = F.filter(signals("l", "r"), lambda x: x["signal"].isin(*STRUCTURAL))
    pairs = pairs.filter(~shares).select(
        F.col("l.analysis_id").alias("analysis_id"), F.col("l.id").alias("l"), F.col("r.id").alias("r"), delta.alias("delta"), structural.alias("s"), (F.col("l.artifact_id") == F.col("r.artifact_id")).alias("same"),
    )
    top = F.array_max(F.transform("s", lambda x: x["strength"]))
    budget = F.least(F.lit(window_ms), F.when(top >= 0.85, 5000.0).when(top >= 0.60, 2500.0).when(top.isNotNull(), 1000.0).otherwise(0.0))
    enough = F.when(F.coalesce("same", F.lit(False)), F.size("s") >= 1).otherwise(F.size("s") >= 2)
    return pairs.filter((F.col("delta") <= budget) & enough).select("analysis_id", F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi")).distinct()


def scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Score (analysis_id, source, target, explicit) pairs.

    Adds score (noisy-or of the shared signals, then of the support by time),
    delta_ms, signals and strengths.
    """
    s, t = rows.alias("s"), rows.alias("t")
    j = pairs.alias("p").join(s, (F.col("p.analysis_id") == F.col("s.analysis_id")) & (F.col("p.source") == F.col("s.id")))
    j = j.join(t, (F.col("p.analysis_id") == F.col("t.analysis_id")) & (F.col("p.target") == F.col("t.id")))
    wl, wr = weight(F.col("s.source_format"), "PARENT_SPAN"), weight(F.col("t.source_format"), "PARENT_SPAN")
    linked = (F.col("s.span_id") == F.col("t.parent_span_id")) & F.coalesce(F.col("s.trace_id") == F.col("t.trace_id"), F.lit(True)) & wl.isNotNull() & wr.isNotNull()
    parent = F.when(linked, F.array(F.struct(F.lit("PARENT_SPAN").alias("signal"), F.least(wl, wr).alias("strength")))).otherwise(F.array().cast("array<struct<signal:string,strength:double>>"))
    j = j.select(
        F.col("p.analysis_id").alias("analysis_id"), "source", "target", "explicit", delta_ms(F.col("s.first_seen"), F.col("t.first_seen")).alias("delta_ms"), F.concat(signals("s", "t"), parent).alias("m"),
    )
    miss = F.aggregate("m", F.lit(1.0), lambda a, x: a * (1.0 - x["strength"]))
    support = F.when(F.col("delta_ms") >= 0, temporal_score(F.col("delta_ms")) * STRENGTH["L"]).otherwise(F.lit(0.0))
    support = F.coalesce(support, F.lit(0.0))
    names = F.transform("m", lambda x: x["signal"])
    names = F.when(F.col("delta_ms") >= 0, F.concat(names, F.array(F.lit("TEMPORAL")))).otherwise(names)
    out = j.select("analysis_id", "source", "target", "explicit", "delta_ms", (1.0 - miss * (1.0 - support)).alias("score"), names.alias("signals"))
    return out.filter((F.size("signals") > 0) & (F.col("score") > 0))


def relationships(evidence: DataFrame, *, window_ms: float = WINDOW_MS) -> DataFrame:
    """All relationships: source_id, target_id, score, delta_ms, signals, relationship_type, direction_confidence.

    A pair found by several ways counts once: by parent link, then by
    identity, then by time. Without a parent link or a strictly positive time
    difference the relationship has no direction and its type is NULL.
    """
    rows = cut(prepare(evidence))
    parents = parent_pairs(rows).select("analysis_id", F.col("parent").alias("source"), F.col("child").alias("target"))
    explicit = parents.groupBy("analysis_id", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.min_by("source", "target").alias("source"), F.min("target").alias("target"))
    other = identity_pairs(rows).union(temporal_pairs(rows, window_ms=window_ms)).distinct()
    other = other.join(explicit.select("analysis_id", "lo", "hi"), ["analysis_id", "lo", "hi"], "left_anti")
    times = rows.select("analysis_id", "id", "first_seen")
    o = other.join(times.select("analysis_id", F.col("id").alias("lo"), F.col("first_seen").alias("tl")), ["analysis_id", "lo"]).join(times.select("analysis_id", F.col("id").alias("hi"), F.col("first_seen").alias("th")), ["analysis_id", "hi"])
    swap = F.coalesce(F.col("th") < F.col("tl"), F.lit(False))
    o = o.select("analysis_id", F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("source"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("target"), F.lit(False).alias("explicit"))
    e = explicit.select("analysis_id", "source", "target", F.lit(True).alias("explicit"))
    s = scored(e.unionByName(o), rows)
    ordered = F.coalesce(F.col("delta_ms") > 0, F.lit(False))
    kind = F.when(F.col("explicit"), "explicit_parent_child").when(ordered, "inferred_propagation")
    confidence = F.when(F.col("explicit"), 1.0).when(ordered, temporal_score(F.col("delta_ms")))
    return s.select("analysis_id", "source", "target", "score", "delta_ms", "signals", kind.alias("relationship_type"), confidence.alias("direction_confidence"))


def failure_strength(severity: Column, event_type: Column, status: Column) -> Column:
    by_level = F.when(F.upper(severity).isin("CRITICAL", "FATAL"), 1.0).when(F.upper(severity) == "ERROR", 0.85).when(F.upper(severity).isin("WARNING", "WARN"), 0.60).otherwise(0.0)
    return F.greatest(by_level, F.when(event_type.isNotNull(), 0.85).otherwise(0.0), F.when(status >= 500, 0.85).otherwise(0.0))


def ranked_causes(evidence: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """One row per evidence row: component, degrees, downstream count, score, role, rank, relative_ms.

    component is the smallest id linked by directed or undirected
    relationships. Ties in the ranking go by time, then id.
    """
    rows = cut(prepare(evidence))
    related = cut(relationships(evidence) if related is None else related)
    # an edge that closes a loop joins nodes that the rest of the loop joins anyway
    label = cut(connected_components(related, "source", "target"))
    directed = cut(dag_edges(related.filter("relationship_type is not null"), label))
    nodes = rows.join(label, rows["id"] == label["member"], "left").drop("member").withColumn("component", F.coalesce("component", "id"))
    out = directed.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"), F.sum("score").alias("out_strength"))
    inc = directed.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("incoming"), F.sum("score").alias("in_strength"))
    down = reachable_counts(directed.select("source", "target").join(label.select(F.col("member").alias("source"), "component"), "source"))
    n = nodes.join(out, "id", "left").join(inc, "id", "left").join(down, "id", "left").fillna(0, ["outgoing", "incoming", "downstream", "out_strength", "in_strength"])
    w = Window.partitionBy("component")
    span = delta_ms(F.min("first_seen").over(w), F.max("first_seen").over(w))
    offset = delta_ms(F.min("first_seen").over(w), F.col("first_seen"))
    origin = F.when(F.col("first_seen").isNull(), 0.0).when(span <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - offset / span))
    size = F.count(F.lit(1)).over(w)
    n = n.withColumns({"size": size, "origin": origin, "relative_ms": offset})
    alone = (F.col("incoming") == 0) & (F.col("outgoing") == 0)
    root = F.when(alone, 0.0).otherwise(1.0 / (1.0 + F.col("incoming")))
    propagation = F.col("downstream") / F.greatest(F.col("size") - 1, F.lit(1))
    outgoing = F.least(F.col("out_strength") / F.greatest(F.col("outgoing"), F.lit(1)), F.lit(1.0))
    failure = failure_strength(F.col("severity"), F.col("event_type"), F.col("http_status"))
    total = 0.30 * root + 0.25 * propagation + 0.15 * outgoing + 0.20 * failure + 0.10 * F.col("origin")
    role = F.when((F.col("size") <= 1) | alone, "uncorrelated").when(F.col("incoming") == 0, "root").when(F.col("outgoing") == 0, "victim").otherwise("propagation")
    n = n.withColumns({"cause_score": F.when(F.col("size") <= 1, 1.0).otherwise(total), "role": role})
    n = position(n, ["analysis_id", "component"], [F.col("cause_score").desc(), F.col("first_seen").asc_nulls_first(), F.col("id")], name="cause_rank")
    return n.select("analysis_id", "id", "component", "size", "incoming", "outgoing", "downstream", "cause_score", "role", "cause_rank", "relative_ms")
