"""Entries are read as a whole, however far behind they state something."""

import random

import pytest

import __spark_entry__ as entry
from lumenlog.operators import loglines

T = "2026-03-20T18:31:27.219Z"
FAR = 100_000  # line numbers many blocks away
SHAPE = "artifact_id int, line_number bigint, raw_line string"
LINES = [
    (1, 1, f"{T} stdout P lev"), (1, 2, f"{T} stderr F level=info app=b x"), (1, FAR, f"{T} stdout F el=error app=a x"),
    (2, 1, "Nov 6, 2025 03:48:31 PM svc run"), (2, FAR, "SEVERE: no free slot"),
    (3, 1, ""), (3, 2, "  {"), (3, 3, '  "a": 1,'), (3, FAR, '  "severity": "err", "service": "pricing"'), (3, FAR + 1, "  }"),
    (4, 1, f"{T} [a] [b] [c] [d] [e] [f] [g] [h] ERROR [shop] x"),
    (5, 1, f"{T} {' '.join(f'w{k % 7}' for k in range(20_000))} WARN mart: x FATAL later: y"),
    (6, 1, 'level=warn component=c1 caller=x host=y zone=z ts=2026-06-09T10:28:38.380Z msg="a"'), (6, 2, 'level=err component=c2 caller=x host=y zone=z ts=2026-06-09T10:28:39.380Z msg="a"'),
    (7, 1, f'{T} service=a msg="one two three four five \\"six seven eight FATAL y" FATAL'), (7, 2, f'{T} service=a msg="one two three four five six seven eight FATAL y"'),
]
WANT = [
    (1, 1, FAR, "ERROR", "a"), (1, 2, 2, "INFO", "b"), (2, 1, FAR, "CRITICAL", ""), (3, 1, FAR + 1, "ERROR", "pricing"), (4, 1, 1, "ERROR", "shop"),
    (5, 1, 1, "WARNING", "mart"), (6, 1, 1, "WARNING", "c1"), (6, 2, 2, "ERROR", "c2"),
    (7, 1, 1, "CRITICAL", "a"), (7, 2, 2, "", "a"),
]


def test_p7_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame(LINES, SHAPE).write.parquet(f"{tmp_path}/raw_lines.parquet")
    assert sorted(map(tuple, entry.queries()["p7_found"](spark, str(tmp_path)).collect())) == WANT


KINDS = [
    f"{T} stdout P part ", f"{T} stdout F end", f"{T} stderr P level=in", f"{T} stderr F fo app=media x", f"{T} stdout P", "Nov 6, 2025 03:48:31 PM svc run", "SEVERE: x", "INFO: y",
    "  {", "{", '  "severity": "err",', '"service": "pricing"', "}", "", "\tat frame", f"{T} one two ERROR later: z", "Traceback",
]


@pytest.mark.parametrize("block", [3, 4096])
def test_lines_left_out_state_nothing(spark, block):
    draw = random.Random(7)
    rows = [(a, n, draw.choice(KINDS)) for a in range(300) for n in range(1, 15) if draw.random() < 0.9]
    df = spark.createDataFrame(rows, SHAPE).cache()
    found = lambda **kw: sorted(map(tuple, loglines.parse_entries(df, **kw).select("artifact_id", "first_line", "last_line", "level", "component").collect()))
    whole = found()
    assert found(block=block, stating=True) == whole
    assert len({r[3] for r in whole}) > 3


def test_texts_of_long_entries_are_not_gathered_in_vain(spark):
    df = spark.createDataFrame([(1, 1, f"{T} ERROR service=a x")] + [(1, n, f"\tat frame {n}") for n in range(2, 10_000)], SHAPE)
    (row,) = loglines.parse_entries(df, stating=True).collect()
    assert (row["first_line"], row["last_line"], row["level"], row["component"]) == (1, 9_999, "ERROR", "a")
    assert row["text"].count("\n") < 10
