"""Deeply nested records to related flat tables (problem 5).

Dewey labelling: every object of a document gets the path of ordinals that
leads to it from the root (array positions from 0, members in order), so a
node's parent is found by truncating its label, and the nodes with one schema
path form one table. Parsing is a single map step without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenlog.session import cut

NODE = "doc {key}, table string, label array<int>, positions array<int>, scalars map<string,string>"


def camel(key: str) -> str:
    """One spelling of a member name: snake_case and camelCase are the same."""
    if "_" not in key.strip("_"):
        return key
    head, *rest = key.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def dewey_nodes(document: object) -> Iterator[tuple[str, list[int], list[int], dict[str, str]]]:
    """(table, label, array positions, scalar members) of every object, parents first.

    table joins the member names on the way, with [] for an array. A label
    holds one ordinal per step: the member's place in its object or the
    element's place in its array. Empty and null members give no node.
    An explicit stack keeps deep documents from exhausting the call stack.
    """
    stack: list[tuple[object, str, list[int], list[int]]] = [(document, "", [], [])]
    while stack:
        node, path, label, positions = stack.pop()
        below: list[tuple[object, str, list[int], list[int]]] = []
        if isinstance(node, dict):
            scalars: dict[str, str] = {}
            for k, (name, v) in enumerate(node.items()):
                name = camel(name)
                if isinstance(v, (dict, list)):
                    below.append((v, f"{path}.{name}" if path else name, [*label, k], positions))
                elif v is not None:
                    scalars[name] = _text(v)
            yield path, label, positions, scalars
        elif isinstance(node, list):
            for k, v in enumerate(node):
                if isinstance(v, (dict, list)):
                    below.append((v, f"{path}[]", [*label, k], [*positions, k]))
        stack.extend(reversed(below))


def flatten(df: DataFrame, key: str, payload: str, *, tables: list[str] | None = None) -> DataFrame:
    """One row per object of the JSON documents: doc, table, label, positions, scalars.

    Only the named schema paths are given out where ``tables`` is set. A
    document sent as a JSON text is opened first. A NULL payload, one that is not complete JSON, and one whose root holds no
    object give no row. Of repeated member names the last counts.
    """
    kind = df.schema[key].dataType.simpleString()
    wanted = None if tables is None else frozenset(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc, text in zip(pdf["k"], pdf["p"], strict=True):
                if text is None:
                    continue
                try:
                    root = json.loads(text.lstrip("\ufeff"))
                    if isinstance(root, str):  # a document sent as text within JSON
                        root = json.loads(root.lstrip("\ufeff"))
                except (ValueError, RecursionError):
                    continue
                for table, label, positions, scalars in dewey_nodes(root):
                    if wanted is None or table in wanted:
                        out.append((doc, table, label, positions, scalars))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=["doc", "table", "label", "positions", "scalars"])
                    out = []
            yield pd.DataFrame(out, columns=["doc", "table", "label", "positions", "scalars"])

    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{payload}`").alias("p")).mapInPandas(run, NODE.format(key=kind))


def parent_label(label: Column, steps: int) -> Column:
    """The label of the ancestor so many steps up."""
    return F.slice(label, 1, F.greatest(F.size(label) - steps, F.lit(0)))


RESOURCES = "resourceLogs[]"
ATTRIBUTES = "resourceLogs[].resource.attributes[]"
SCOPES = "resourceLogs[].scopeLogs[]"
SCOPE_NAMES = "resourceLogs[].scopeLogs[].scope"
RECORDS = "resourceLogs[].scopeLogs[].logRecords[]"
VALUES = "resourceLogs[].resource.attributes[].value"
SPAN_SCOPES = "resourceSpans[].scopeSpans[]"
SPANS = f"{SPAN_SCOPES}.spans[]"
SPAN_EVENTS = f"{SPANS}.events[]"
#: Attributes of span resources, spans and events of spans.
SPAN_ATTRIBUTES = ("resourceSpans[].resource.attributes[]", f"{SPANS}.attributes[]", f"{SPAN_EVENTS}.attributes[]")
#: Steps of the label of a span resource, scope and span.
RESOURCE_STEPS, SCOPE_STEPS, SPAN_STEPS = 2, 4, 6


def otlp_tables(exports: DataFrame) -> dict[str, DataFrame]:
    """resources, resource_attributes, scopes and log_records of ``otlp_exports``.

    Each row carries (export_id, label); parent_label is the label of the row
    it belongs to in the parent table. Sent-again payloads keep their own
    export_id. Positions count from 0 within the parent array.
    """
    nodes = flatten(exports, "export_id", "payload", tables=[RESOURCES, ATTRIBUTES, VALUES, SCOPES, SCOPE_NAMES, RECORDS])
    of = lambda t: nodes.filter(F.col("table") == t)
    pos = lambda k: F.try_element_at("positions", F.lit(k + 1))
    s = lambda k: F.try_element_at("scalars", F.lit(k))
    base = [F.col("doc").alias("export_id"), "label"]
    value = of(VALUES).select("doc", parent_label(F.col("label"), 1).alias("label"), F.try_element_at(F.map_values("scalars"), F.lit(1)).alias("attr_value"))
    attributes = of(ATTRIBUTES).join(value, ["doc", "label"], "left")
    name = of(SCOPE_NAMES).select("doc", parent_label(F.col("label"), 1).alias("label"), s("name").alias("scope_name"))
    return {
        "resources": of(RESOURCES).select(*base, pos(0).alias("res_pos")),
        "resource_attributes": attributes.select(*base, parent_label(F.col("label"), 3).alias("parent_label"), pos(0).alias("res_pos"), pos(1).alias("attr_pos"), s("key").alias("attr_key"), "attr_value"),
        "scopes": of(SCOPES).join(name, ["doc", "label"], "left").select(*base, parent_label(F.col("label"), 2).alias("parent_label"), pos(0).alias("res_pos"), pos(1).alias("scope_pos"), "scope_name"),
        "log_records": of(RECORDS).select(*base, parent_label(F.col("label"), 2).alias("parent_label"), pos(0).alias("res_pos"), pos(1).alias("scope_pos"), pos(2).alias("rec_pos"), s("traceId").alias("trace_id"), s("spanId").alias("span_id"), s("timeUnixNano").alias("time_raw"), s("severityText").alias("severity")),
    }


def span_tables(exports: DataFrame) -> dict[str, DataFrame]:
    """span_resources, span_scopes, spans, span_events and span_attributes of ``otlp_exports``.

    Keys are as in ``otlp_tables``. span_attributes holds those of resources,
    spans and events; parent_label is the label of the owner.
    """
    paths = ["resourceSpans[]", SPAN_SCOPES, f"{SPAN_SCOPES}.scope", SPANS, f"{SPANS}.status", SPAN_EVENTS, *SPAN_ATTRIBUTES, *(f"{x}.value" for x in SPAN_ATTRIBUTES)]
    nodes = cut(flatten(exports, "export_id", "payload", tables=paths))
    of = lambda *t: nodes.filter(F.col("table").isin(*t))
    pos = lambda k: F.try_element_at("positions", F.lit(k + 1))
    s = lambda k: F.try_element_at("scalars", F.lit(k))
    base = [F.col("doc").alias("export_id"), "label"]
    merged = lambda own, inner, *c: of(own, inner).groupBy(F.col("doc").alias("export_id"), F.when(F.col("table") == inner, parent_label(F.col("label"), 1)).otherwise(F.col("label")).alias("label")).agg(F.first(F.when(F.col("table") == own, F.struct("positions", "scalars")), ignorenulls=True).alias("o"), F.first(F.when(F.col("table") == inner, F.col("scalars")), ignorenulls=True).alias("i")).filter("o is not null").withColumns({"positions": F.col("o.positions"), "scalars": F.col("o.scalars")})
    inner = lambda k: F.try_element_at("i", F.lit(k))
    attributes = None
    for t in SPAN_ATTRIBUTES:
        steps = 3 if t.startswith("resourceSpans[].resource.") else 2
        part = merged(t, f"{t}.value").select("export_id", "label", parent_label(F.col("label"), steps).alias("parent_label"), F.element_at("positions", -1).alias("attr_pos"), s("key").alias("attr_key"), F.try_element_at(F.map_values("i"), F.lit(1)).alias("attr_value"))
        attributes = part if attributes is None else attributes.unionByName(part)
    return {
        "span_resources": of("resourceSpans[]").select(*base, pos(0).alias("res_pos")),
        "span_scopes": merged(SPAN_SCOPES, f"{SPAN_SCOPES}.scope").select("export_id", "label", parent_label(F.col("label"), 2).alias("parent_label"), pos(0).alias("res_pos"), pos(1).alias("scope_pos"), inner("name").alias("scope_name")),
        "spans": merged(SPANS, f"{SPANS}.status").select("export_id", "label", parent_label(F.col("label"), 2).alias("parent_label"), pos(0).alias("res_pos"), pos(1).alias("scope_pos"), pos(2).alias("span_pos"), s("traceId").alias("trace_id"), s("spanId").alias("span_id"), s("parentSpanId").alias("parent_span_id"), s("name").alias("name"), s("startTimeUnixNano").alias("time_raw"), inner("code").alias("status_code"), inner("message").alias("status_message")),
        "span_events": of(SPAN_EVENTS).select(*base, parent_label(F.col("label"), 2).alias("parent_label"), pos(3).alias("event_pos"), s("name").alias("name")),
        "span_attributes": attributes,
    }


def spans_as_events(exports: DataFrame) -> DataFrame:
    """One canonical event per span: ERROR by its status or an exception event, else INFO."""
    t = span_tables(exports)
    wide = lambda rows, **names: rows.groupBy("export_id", F.col("parent_label").alias("owner")).agg(*(F.coalesce(*(F.max_by("attr_value", F.when((F.col("attr_key") == k) & F.col("attr_value").isNotNull(), F.col("attr_pos"))) for k in keys)).alias(c) for c, keys in names.items()))
    a = cut(t["span_attributes"])
    own = lambda steps: a.filter(F.size("parent_label") == steps)
    resource = wide(own(RESOURCE_STEPS), service=("service.name", "faas.name"), host=("host.name", "host.id", "cloud.availability_zone"), container=("container.name", "container.id"), pod=("k8s.pod.name", "k8s.pod.uid")).withColumnRenamed("owner", "_r")
    span = wide(own(SPAN_STEPS), request_id=("request.id", "http.request.id", "correlation.id"), endpoint=("http.route", "url.path", "http.target", "rpc.method"), http_status=("http.response.status_code", "http.status_code")).withColumnRenamed("owner", "label")
    failed = t["span_events"].filter(F.lower("name") == "exception").groupBy("export_id", F.col("parent_label").alias("_s")).agg(F.min_by("label", "event_pos").alias("owner"))
    raised = failed.join(wide(own(SPAN_STEPS + 2), exception_type=("exception.type",), exception_message=("exception.message",)), ["export_id", "owner"], "left").withColumnRenamed("_s", "label").withColumnRenamed("owner", "_e")
    scope = t["span_scopes"].select("export_id", F.col("label").alias("parent_label"), F.col("scope_name").alias("module"))
    j = t["spans"].withColumn("_r", F.slice("label", 1, RESOURCE_STEPS)).join(scope, ["export_id", "parent_label"], "left").join(resource, ["export_id", "_r"], "left").join(span, ["export_id", "label"], "left").join(raised, ["export_id", "label"], "left")
    error = F.coalesce(F.upper("status_code").isin("2", "ERROR", "STATUS_CODE_ERROR"), F.lit(False)) | F.col("_e").isNotNull()
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    message = F.coalesce(told("exception_message"), told("status_message"), F.concat(F.lit("OpenTelemetry span: "), F.coalesce("name", F.lit("unnamed"))))
    return j.select(
        "export_id", "res_pos", "scope_pos", "span_pos", "time_raw", F.when(error, "ERROR").otherwise("INFO").alias("level"), *(told(c).alias(c) for c in ("trace_id", "span_id", "parent_span_id", "request_id", "service", "module", "host", "container", "pod", "endpoint")),
        F.col("http_status").try_cast("int").alias("http_status"), told("exception_type").alias("exception_type"), told("exception_message").alias("exception_message"), F.lit("opentelemetry").alias("source_format"), message.alias("message"),
    )


def records_with_resource_keys(exports: DataFrame) -> DataFrame:
    """One row per log record and distinct attribute key of its resource.

    The resource of a record is its label cut to the resource's length; both
    lie in the same payload, so records and attributes meet in one exchange
    by (export, label of the resource) in which a record set and its resource's few keys
    are packed together.
    """
    nodes = flatten(exports, "export_id", "payload", tables=[ATTRIBUTES, RECORDS])
    # a record lies in scope, list, scope list and its resource's list; an attribute in the list of the resource object
    up = F.when(F.col("table") == RECORDS, parent_label(F.col("label"), 4)).otherwise(parent_label(F.col("label"), 3))
    s = lambda k: F.coalesce(F.try_element_at("scalars", F.lit(k)), F.lit(""))
    at = lambda k: F.try_element_at("positions", F.lit(k + 1))
    record = F.struct(at(0).alias("res_pos"), at(1).alias("scope_pos"), at(2).alias("rec_pos"), s("traceId").alias("trace_id"), s("spanId").alias("span_id"))
    packed = (
        nodes.groupBy(F.col("doc").alias("export_id"), up.alias("resource"))
        .agg(
            F.collect_list(F.when(F.col("table") == RECORDS, record)).alias("records"),
            F.collect_set(F.when(F.col("table") == ATTRIBUTES, F.nullif(s("key"), F.lit("")))).alias("keys"),
        )
        .filter(F.size("records") > 0)
    )
    keys = F.when(F.size("keys") == 0, F.array(F.lit(""))).otherwise(F.col("keys"))
    return (
        packed.select("export_id", F.explode("records").alias("r"), keys.alias("keys"))
        .select("export_id", "r.res_pos", "r.scope_pos", "r.rec_pos", "r.trace_id", "r.span_id", F.explode("keys").alias("attr_key"))
    )
