"""Lines of each format: what passes the gate, and the fields that come out."""

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import formats

LINES = [
    ("web_server", '203.0.113.9 - - [01/Aug/2026:10:00:00 +0000] "GET /api/orders HTTP/1.1" 502 12 "-" "x"', True, {"level": "ERROR", "host": "203.0.113.9", "endpoint": "/api/orders", "http_status": 502}),
    ("web_server", '203.0.113.9 - - [01/Aug/2026:10:00:00 +0000] "GET /ok HTTP/1.1" 200 12 "-" "error"', False, {}),
    ("web_server", "[Sat Aug 01 10:00:00.123456 2026] [core:error] [pid 1] RuntimeError: worker gone", True, {"level": "ERROR", "exception_type": "RuntimeError"}),
    ("web_server", "2026/08/01 10:00:00 [notice] 1#1: error in name only", False, {}),
    ("syslog", "<11>1 2026-08-01T10:00:00Z node-1 billing 12 ID7 - disk", True, {"level": "ERROR", "host": "node-1", "service": "billing"}),
    ("syslog", "<36>Aug  2 10:00:00 node-2 cron[7]: late", True, {"level": "WARNING", "host": "node-2", "service": "cron"}),
    ("syslog", "<134>Aug  2 10:00:00 node-2 cron[7]: error free", False, {}),
    ("container", "2026-08-01T10:00:00Z stderr F plain words", True, {"level": "ERROR"}),
    ("container", '2026-08-01T10:00:00Z stderr F {"level": "warn", "service": "cart", "traceId": "t1"}', True, {"level": "WARNING", "service": "cart", "trace_id": "t1"}),
    ("container", "2026-08-01T10:00:00Z stdout F plain words", False, {}),
    ("cloud_gateway", 'https 2026-08-01T10:00:00Z app/x 1.2.3.4:5 6.7.8.9:0 0.1 0.2 0.3 502 502 1 2 "GET https://api.example.test/orders HTTP/1.1" "agent"', True, {"level": "ERROR", "http_status": 502, "endpoint": "https://api.example.test/orders"}),
    ("cloud_gateway", 'https 2026-08-01T10:00:00Z app/x 1.2.3.4:5 6.7.8.9:0 0.1 0.2 0.3 - - 1 2 "GET https://a.test/b HTTP/1.1" "agent"', True, {}),
    ("cloud_gateway", 'https 2026-08-01T10:00:00Z app/x 1.2.3.4:5 6.7.8.9:0 0.1 0.2 0.3 200 200 1 2 "GET https://a.test/error HTTP/1.1" "agent"', False, {}),
    ("message_broker", "2026-08-01 ERROR kafka request_id=broker-1 lag", True, {"level": "ERROR", "service": "kafka", "request_id": "broker-1"}),
    ("message_broker", "WARN amqp channel closed", True, {"level": "WARNING", "service": "rabbitmq"}),
    ("message_broker", "ERROR service=orders lag", True, {"service": "orders"}),
    ("serverless", "START RequestId: lambda-1 Version: error", False, {}),
    ("serverless", "2026-08-01T10:00:00Z lambda-request-1 ERROR RuntimeError: timeout", True, {"level": "ERROR", "service": "aws-lambda", "request_id": "lambda-request-1", "exception_type": "RuntimeError"}),
    ("ci_cd", "2026-08-01T10:00:00Z ##[error] service=web request_id=deploy-1 failed", True, {"level": "ERROR", "service": "web", "request_id": "deploy-1"}),
    ("ci_cd", "Traceback (most recent call last):", False, {}),
    ("database", "# Time: 2026-08-01\n# Query_time: 9\nSELECT 1;", True, {"level": "WARNING"}),
    ("stack_trace", "crash report for worker", True, {"level": "ERROR"}),
    ("stack_trace", 'File "/srv/worker.py",line 42,in run', True, {"level": "ERROR"}),
    ("generic", "all is well", False, {}),
    ("generic", "", False, {}),
    ("generic", None, False, {}),
    ("unheard_of", "all is well", True, {}),
]


def frame(spark):
    rows = [(k, f, t, "kept") for k, (f, t, _, _) in enumerate(LINES)]
    return spark.createDataFrame(rows, "k int, source_format string, raw_line string, level string").drop("level")


def test_gates(spark):
    got = {r["k"]: r["kept"] for r in frame(spark).select("k", formats.gate(F.col("source_format"), F.col("raw_line")).alias("kept")).collect()}
    assert got == {k: kept for k, (_, _, kept, _) in enumerate(LINES)}


def test_fields(spark):
    got = {r["k"]: r for r in formats.normalise(frame(spark), "raw_line", "source_format").collect()}
    assert set(got) == {k for k, x in enumerate(LINES) if x[2]}
    for k, (_, text, kept, want) in enumerate(LINES):
        if kept:
            assert {f: got[k][f] for f in want} == want, text


def test_registered_format(spark):
    formats.register_format("ours", lambda t: t.startswith("!"), lambda t: {"service": F.lit("ours")})
    try:
        df = spark.createDataFrame([("ours", "! x"), ("ours", "error"), (None, "error")], "source_format string, raw_line string")
        got = formats.normalise(df, "raw_line", "source_format").collect()
        assert sorted((r["source_format"] or "", r["service"] or "") for r in got) == [("", ""), ("ours", "ours")]
    finally:
        del formats.FORMATS["ours"]


@pytest.mark.parametrize("name", sorted(formats.FORMATS))
def test_empty_table(spark, name):
    assert formats.normalise(frame(spark).limit(0), "raw_line", "source_format").count() == 0
