import json

from pyspark.sql import functions as F

from lumenlog.sources import readers
from lumenlog.streaming import incremental


def test_text_and_json_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b'\xef\xbb\xbf{"level":"warn","service":{"name":"s"},"traceId":"t","status":503}\r\nnot json ERROR x=1\n\nplain\n')
    lines = readers.text_lines(spark, str(tmp_path))
    assert [r["line_number"] for r in lines.orderBy("line_number").collect()] == [1, 2, 3, 4]
    got = {r["line_number"]: r for r in readers.json_lines(lines).collect()}
    assert (got[1]["level"], got[1]["service"], got[1]["trace_id"], got[1]["http_status"]) == ("WARNING", "s", "t", 503)
    assert set(got) == {1, 2} and got[2]["level"] == "ERROR"


def test_documents(spark):
    har = {"log": {"entries": [{"startedDateTime": "2026-01-01T00:00:00Z", "request": {"url": "https://e.test/a"}, "response": {"status": 503}}]}}
    df = spark.createDataFrame([("h", json.dumps(har)), ("l", json.dumps([{"msg": "a"}, {"msg": "b"}])), ("x", "{"), ("n", None)], "file string, value string")
    got = readers.json_documents(df).collect()
    assert sorted(r["file"] for r in got) == ["h", "l", "l"]
    assert [(r["endpoint"], r["http_status"], r["level"]) for r in got if r["file"] == "h"] == [("https://e.test/a", 503, "ERROR")]


def test_cloudfront(spark):
    rows = [("f", 1, "#Version: 1.0"), ("f", 2, "#Fields: date time sc-status cs-uri-stem cs-uri-query x-edge-request-id"), ("f", 3, "2026-01-01\t00:00:01\t502\t/a\tq=1\tr1"), ("f", 4, "2026-01-01\t00:00:02\t200\t/b\t-\tr2"), ("g", 1, "2026-01-01\t1\t2\t3\t4\t5")]
    got = readers.cloudfront(spark.createDataFrame(rows, "file string, line_number bigint, line string")).orderBy("line_number").collect()
    assert [(r["endpoint"], r["level"], r["request_id"]) for r in got] == [("/a?q=1", "ERROR", "r1"), ("/b", "INFO", "r2")]


def test_uploads_and_frames(spark, tmp_path):
    (tmp_path / "x.log").write_text("<11>1 2026-02-28T01:32:33Z h a 1 - - x\n")
    (tmp_path / "y.bin").write_bytes(b"\x00\x01")
    got = {r["file"][-5:]: r for r in readers.files(spark, str(tmp_path)).collect()}
    assert got["x.log"]["detected_format"] == "syslog" and got["x.log"]["supported"] and not got["y.bin"]["supported"]
    ends = readers.path_endings(spark.createDataFrame([("src/a/w.py",), ("lib/a/w.py",), ("src/b/v.py",)], "path string"))
    frames = spark.createDataFrame([(1, "/srv/b/v.py"), (2, "/srv/a/w.py"), (3, "./src/a/w.py"), (4, "none.py")], "frame_id int, file string")
    assert {r["frame_id"]: r["path"] for r in readers.match_frames(frames, ends).collect()} == {1: "src/b/v.py", 3: "src/a/w.py"}


def test_stream_rollup_is_idempotent(spark, small, tmp_path):
    from lumenlog.operators import rollup

    events = spark.read.parquet(f"{small}/parsed_events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.start_rollup(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    once = rollup.rollup(rollup.retained(events))
    got = incremental.current(spark, str(tmp_path / "out"))
    assert got.count() == once.count() and got.agg(F.sum("occurrence_count")).first()[0] == once.agg(F.sum("occurrence_count")).first()[0]


def test_progress_never_falls(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 7)], "analysis_id int, seq int, progress int")
    assert sorted(r["progress"] for r in incremental.monotone_progress(df).collect()) == [5, 7]
