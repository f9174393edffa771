from lumenlog.operators import loglines


def parse(spark, lines, **kw):
    rows = [(1, n, x, "e") for n, x in lines]
    df = spark.createDataFrame(rows, "artifact_id int, line_number bigint, raw_line string, level string")
    return sorted((r["first_line"], r["last_line"], r["level"], r["component"]) for r in loglines.parse_entries(df, **kw).collect())


LINES = [
    (1, "2026-08-05 20:16:06 ERROR service=audit-log module=merge job failed"), (2, "Traceback (most recent call last):"), (3, '  File "/srv/a.py", line 398, in flush'), (4, "ValueError: error budget"),
    (5, "2026-03-20T18:31:27.219Z stderr P level=in"), (6, "2026-03-20T18:31:27.219Z stderr F fo app=media-proxy invoice"),
    (7, "# Time: 2026-04-15T05:42:16.814Z"), (8, "# Query_time: 58.040"), (9, "SELECT 1;"),
    (10, "{"), (11, '  "severity": "err",'), (12, '  "service": {"name": "pricing"}'), (13, "}"),
    (14, "<131>1 2026-02-28T01:32:33.863Z edge-46 report-builder 8471 ID85 - quota"),
    (15, "2026/02/23 13:16:54 [crit] 26#80: *5827 checksum of parcel"), (16, "[Mon Dec 29 20:31:06.885183 2025] [ssl:warn] [pid 814] fatal flag"),
    (17, "Nov 6, 2025 03:48:31 PM edge-router poll"), (18, "SEVERE: no free slot"), (18, "SEVERE: no free slot"), (19, "\tat app.X.call(X.java:1)\r"),
    (20, "level=fatal component=tax-calc ts=2026-06-09T10:28:38.380Z msg=\"info page\""), (21, "2026-03-20T02:46:16.990Z 95 [Warning] [session-store] aborted connection 494"),
    (22, "2025-11-02T14:17:09.054Z INFO batch-planner: no free slot"),
]
WANT = [(1, 4, "ERROR", "audit-log"), (5, 6, "INFO", "media-proxy"), (7, 9, "", ""), (10, 13, "ERROR", "pricing"), (14, 14, "ERROR", "report-builder"), (15, 15, "CRITICAL", ""), (16, 16, "WARNING", "ssl"), (17, 19, "CRITICAL", "edge-router"), (20, 20, "CRITICAL", "tax-calc"), (21, 21, "WARNING", "session-store"), (22, 22, "INFO", "batch-planner")]


def more():
    """Enough lines for the dictionaries to tell constant words from names."""
    out = []
    for k in range(60):
        out.append((100 + 4 * k, f"Nov 6, 2025 03:48:{k % 60:02d} PM svc-{k} {'poll' if k % 2 else 'run'}"))
        out.append((101 + 4 * k, "INFO: ok"))
        out.append((102 + 4 * k, f"<14>1 2026-02-28T01:32:33.863Z edge-{k} name-{k} {k} ID{k} - text"))
        out.append((103 + 4 * k, f"2026/02/23 13:16:54 [warn] 26#80: *5827 {'abcdefgh'[k % 8]}{k} of parcel"))
    return out


def test_layouts(spark):
    got = parse(spark, LINES + more())
    assert [g for g in got if g[0] < 100] == WANT


def test_blocks_do_not_matter(spark):
    assert parse(spark, LINES + more(), block=3) == parse(spark, LINES + more())


def test_headless_and_missing_lines(spark):
    got = parse(spark, [(1, "no head"), (2, ""), (3, None), (4, "y" * 200_000), (None, "x"), (5, "2026-08-05 20:16:06 WARN service=a x")])
    assert got == [(1, 4, "", ""), (5, 5, "WARNING", "a")]


def test_empty(spark):
    assert parse(spark, []) == []


def test_partial_lines_go_on_within_their_stream(spark):
    t = "2026-03-20T18:31:27.219Z"
    lines = [(1, f"{t} stdout P part one "), (2, f"{t} stderr F ERROR other stream"), (3, f"{t} stdout P part two "), (4, f"{t} stdout F end"), (5, "  File \"/srv/a.py\", line 3, in f"), (6, "ValueError: x")]
    df = spark.createDataFrame([(1, n, x) for n, x in lines], "artifact_id int, line_number bigint, raw_line string")
    for block in (2, 4096):
        got = {r["first_line"]: r for r in loglines.parse_entries(df, block=block).collect()}
        assert {k: (r["last_line"], r["level"]) for k, r in got.items()} == {1: (6, ""), 2: (2, "ERROR")} or {k: (r["last_line"], r["level"]) for k, r in got.items()} == {1: (4, ""), 2: (6, "ERROR")}
        assert "part one part two end" in got[1]["text"]
        # lines without a container head keep their text in the entry they follow
        assert any("ValueError: x" in r["text"] for r in got.values())


def test_trigrams_tell_constant_from_variable_words(spark):
    rows = [(1, k, f"2026-08-05 20:16:0{k % 10} svc-{k} {'poll' if k % 2 else 'run'}") for k in range(200)]
    df = spark.createDataFrame(rows, "artifact_id int, line_number bigint, raw_line string")
    heads = loglines.typed_heads(loglines.entries(df))
    assert [list(r["constant"]) for r in loglines.templates(heads).collect()] == [[True, False, True]]
    bigrams, trigrams = loglines.ngram_dictionaries(heads)
    assert {(r["one"], r["kind"]): (r["n_one"], r["words_one"]) for r in bigrams.collect()}[("<time>", "word")] == (200, 200)
    assert {(r["two"], r["kind"]): (r["n_two"], r["words_two"]) for r in trigrams.collect()}[("<time> word $", "word")] == (200, 2)
