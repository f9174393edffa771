import __spark_entry__ as entry
import pytest

NAMES = {"p1_found": ["evidence_id"], "p2_found": ["page_id", "line_no", "defect"], "p4_found": ["group_id", "evidence_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(NAMES))
def test_columns_and_rows(spark, small, name):
    df = entry.queries()[name](spark, small)
    assert df.columns == NAMES[name]
    rows = [tuple(r) for r in df.collect()]
    # the handful of ratings of the smallest tables teaches p10 nothing
    assert (rows or name == "p10_found") and len(rows) == len(set(rows))
