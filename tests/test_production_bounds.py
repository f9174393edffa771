"""The registered fallback query works with the production bounds of its operator."""

import __spark_entry__ as entry


def test_fallback_contexts_keep_long_pages(spark, tmp_path):
    pages = [(k, 1, "x" * 2_000) for k in range(10)] + [(10, 2, "é" * 40_000), (11, 2, "y" * 60_000)]
    spark.createDataFrame(pages, "page_id int, artifact_id int, extracted_text string").write.parquet(str(tmp_path / "scanned_pages.parquet"))
    got = {r["artifact_id"]: r["excerpt"] for r in entry.queries()["fallback_contexts"](spark, str(tmp_path)).collect()}
    assert got == {k: t for k, _, t in pages if k != 10} | {10: "é" * 32_768}
