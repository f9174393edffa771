from pyspark.sql import functions as F

from lumenlog.functions import detect, events, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_levels(spark):
    cases = {"warn": "WARNING", " Err ": "ERROR", "50": "CRITICAL", "30": "WARNING", "7": "DEBUG", "crit": "CRIT", "": None, "notice": "INFO"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["x"] for r in df.select("v", text.level(F.col("v")).alias("x")).collect()}
    assert got == cases


def test_fingerprints(spark):
    none = F.lit(None).cast("string")
    got = value(spark, text.fingerprint(F.lit("KeyError"), F.lit(" Item 12 of 92b6179c-31da-79f1-4ad1-5d508a59afb3 "), none, F.lit("x")))
    assert got == "keyerror:item <number> of <uuid>"
    assert len(value(spark, text.fingerprint(none, none, none, F.lit("a" * 400)))) == 255
    spelt = ["KeyError:item <number> missing", "  KeyError: item 44  missing ", "keyerror:item <NUMBER> missing"]
    assert {value(spark, text.same_fingerprint(F.lit(s))) for s in spelt} == {"keyerror:item <number> missing"}


def test_formats(spark):
    cases = {
        "<11>1 2026-02-28T01:32:33Z h a 1 - - x": "syslog",
        "2026-02-27T12:06:36.602Z stderr P level=warn": "container",
        '1.2.3.4 - - [10/Oct/2025:13:55:36 +0000] "GET /a HTTP/1.1" 502 12': "web_server",
        '{"resourceLogs":[]}': "opentelemetry",
        '{"log":"x","stream":"stderr"}': "container",
        '{"log":{"entries":[{"startedDateTime":"x"}]}}': "browser",
        "#Fields: date time sc-status cs-uri-stem x-edge-location\n": "cloud_gateway",
        "Traceback (most recent call last):": "stack_trace",
        "##[error] build failed": "ci_cd",
        "# Query_time: 3": "database",
        "kafka rebalance": "message_broker",
        "START RequestId: 1": "serverless",
        '{"a":1}': "json",
        "hello": "generic",
        "": "generic",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["x"] for r in df.select("v", detect.detect_format(F.col("v")).alias("x")).collect()} == cases


def test_text_event(spark):
    line = 'ERROR service=checkout module=payments trace_id=trace-1 GET /orders status=502 a.b.ValueError: bad item\n  File "/srv/w.py", line 42, in run\n    x()'
    r = events.text_event(spark.createDataFrame([(line,), (None,)], "t string"), "t").first()
    assert (r["level"], r["service"], r["module"], r["trace_id"], r["http_status"], r["exception_type"], r["endpoint"]) == ("ERROR", "checkout", "payments", "trace-1", 502, "ValueError", "/orders")
    assert [tuple(f) for f in r["stack_frames"]] == [("/srv/w.py", 42, "run")]


def test_level_word_inside_a_name(spark):
    assert value(spark, text.first_level(F.lit("x trace_id=1 ERROR"))) == "TRACE"
