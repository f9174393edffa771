"""Entries of any length stay one entry."""

import pytest

from lumenlog.operators import loglines
from tests.test_loglines import parse

HEAD = "2026-08-05 20:16:06 ERROR service=audit-log job failed"
LINES = [(k, f" opening {k}") for k in range(1, 101)] + [(101, HEAD)] + [(k, f"\tat frame {k}") for k in range(102, 401)] + [(401, "{"), *((k, f' "k{k}": 1,') for k in range(402, 600)), (600, ' "severity": "err", "service": "pricing"'), (601, "}")]
WANT = [(1, 100, "", ""), (101, 400, "ERROR", "audit-log"), (401, 601, "ERROR", "pricing")]


@pytest.mark.parametrize("text_blocks", [None, 2, 0])
def test_entry_over_many_blocks(spark, text_blocks):
    assert parse(spark, LINES, block=4, text_blocks=text_blocks) == WANT


def test_text_is_whole_unless_bounded(spark):
    df = spark.createDataFrame([(1, n, x) for n, x in LINES], "artifact_id int, line_number bigint, raw_line string")
    texts = lambda **kw: {r["first_line"]: r["text"].count("\n") + 1 for r in loglines.entries(df, 4, **kw).collect()}
    assert texts() == {1: 100, 101: 300, 401: 201}
    assert texts(text_blocks=2) == {1: 11, 101: 11, 401: 201}
