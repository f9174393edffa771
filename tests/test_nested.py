import json

from lumenlog.operators import nested

DOC = {"resourceLogs": [{"resource": {"attributes": [{"key": "a", "value": {"stringValue": "x"}}, {"key": "a", "value": {"intValue": 3}}]}, "scopeLogs": [{"scope": {"name": "n"}, "logRecords": [{"traceId": "t", "spanId": None}, {}]}]}, None, {"resource": None, "scopeLogs": [{"logRecords": None}]}]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "export_id bigint, payload string, label string, doc int")


def test_records_and_keys(spark):
    snake = json.dumps(DOC).replace("resourceLogs", "resource_logs").replace("logRecords", "log_records").replace("traceId", "trace_id").replace("scopeLogs", "scope_logs")
    rows = [(1, json.dumps(DOC), "z", 1), (2, snake, "z", 1), (3, json.dumps(DOC)[:-5], "z", 1), (4, None, "z", 1), (5, "", "z", 1), (6, "﻿" + json.dumps(DOC), None, None), (7, json.dumps(json.dumps(DOC)), None, None), (8, "[]", None, None), (9, "17", None, None)]
    got = {tuple(r) for r in nested.records_with_resource_keys(frame(spark, rows)).collect()}
    want = {(i, 0, 0, k, t, "", "a") for i in (1, 2, 6, 7) for k, t in ((0, "t"), (1, ""))}
    assert got == want


def test_no_attributes_gives_an_empty_key(spark):
    doc = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"traceId": "t"}]}]}]})
    assert [tuple(r) for r in nested.records_with_resource_keys(frame(spark, [(1, doc, "", 0)])).collect()] == [(1, 0, 0, 0, "t", "", "")]


def test_labels_lead_to_the_parents(spark):
    t = nested.otlp_tables(frame(spark, [(1, json.dumps(DOC), "", 0)]))
    scopes = {tuple(r["label"]) for r in t["scopes"].collect()}
    assert all(tuple(r["parent_label"]) in scopes for r in t["log_records"].collect())
    resources = {tuple(r["label"]) for r in t["resources"].collect()}
    assert all(tuple(r["parent_label"]) in resources for r in t["resource_attributes"].collect() + t["scopes"].collect())
    assert {r["attr_value"] for r in t["resource_attributes"].collect()} == {"x", "3"}
    assert {r["scope_name"] for r in t["scopes"].collect()} == {"n", None}


def test_any_document_and_depth(spark):
    deep = "{\"a\":" * 900 + "{\"b\": 1}" + "}" * 900
    df = spark.createDataFrame([("k", deep), ("k", deep)], "id string, body string")
    assert nested.flatten(df, "id", "body").filter("scalars['b'] = '1'").count() == 2


def test_empty_table(spark):
    assert nested.records_with_resource_keys(frame(spark, [])).count() == 0
