import datetime as dt

from pyspark.sql import functions as F

from lumenlog.llm import survivors
from lumenlog.session import table

T = dt.datetime(2026, 1, 1)


def test_found_against_brute_force(spark, small):
    import hashlib
    import re

    e = table(spark, small, "evidence")
    rows = [r.asDict() for r in e.collect()]

    def lower(v):
        v = (v or "").strip().lower()
        return v if v and v != "__none__" else "__none__"

    def key(r):
        f = r["fingerprint"]
        if f is None:
            return None
        f = re.sub(r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>", f)
        f = re.sub(r"\s+", " ", re.sub(r"\b\d+\b", "<number>", f).lower().strip())
        f = re.sub(r"^([^:\s]*)\s*:\s*", r"\1:", f)
        m = re.search(r"[0-9a-f]{64}", (r["correlation_key"] or "").lower())
        k = m.group() if m else hashlib.sha256("|".join(lower(r[c]) for c in ("trace_id", "request_id", "span_id")).encode()).hexdigest()
        return (r["analysis_id"], f, k) if f else None

    groups = {}
    for r in rows:
        if key(r):
            groups.setdefault(key(r), []).append(r)
    full = lambda r: sum(v is not None and v != "" for v in r.values())
    want = {max(g, key=lambda r: (full(r), r["last_seen"] or dt.datetime.min, -r["id"]))["id"] for g in groups.values() if len(g) > 1}
    assert {r["evidence_id"] for r in survivors.duplicate_representatives(e).collect()} == want and want


def test_fields_come_from_the_best_filled_copy(spark):
    schema = "id bigint, k string, seen timestamp_ntz, n bigint, a string, b string, c int, copies int"
    rows = [(1, "x", T, 5, "old", "", None, 0), (2, "x", T + dt.timedelta(1), 3, None, "b", None, 0), (3, "x", T, 5, "full", None, 7, 0), (4, None, None, None, None, None, None, None), (5, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:1], schema)
    got = {r["key"]: r for r in survivors.survivors(df, {"key": F.col("k")}, row_id="id", time="seen", count="n").collect() if r["key"]}
    x = got["x"]
    assert (x["copies"], x["best_id"], x["n"], x["a"], x["b"], x["c"]) == (4, 3, 5, "full", "b", 7)
    assert survivors.survivors(df, {"key": F.col("k")}, row_id="id", time="seen").filter("key is null").count() == 2
    assert survivors.survivors(df.limit(0), {"key": F.col("k")}, row_id="id", time="seen").count() == 0


def test_ties_go_to_the_latest_then_the_smallest_id(spark):
    df = spark.createDataFrame([(3, "x", T), (2, "x", T + dt.timedelta(1)), (1, "x", T + dt.timedelta(1))], "id bigint, k string, seen timestamp_ntz")
    assert survivors.survivors(df, {"key": F.col("k")}, row_id="id", time="seen").first()["best_id"] == 1
