"""The registered selections work with the production bounds of their operators."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenlog.operators import results
from lumenlog.session import table


def test_selections_keep_all_within_the_bounds(spark, small):
    e = table(spark, small, "evidence")
    assert e.groupBy("analysis_id").count().agg(F.max("count")).first()[0] > 40
    assert entry.queries()["bounded_selection"](spark, small).count() == e.count()
    docs = [json.loads(r["document"]) for r in entry.queries()["simple_documents"](spark, small).collect()]
    assert sum(d["returned"] for d in docs) == e.count() and not any(d["truncated"] for d in docs)


def test_simple_documents_go_beyond_the_bounds_of_the_context(spark, small, tmp_path):
    one = table(spark, small, "evidence").limit(1)
    n = F.explode(F.sequence(F.lit(1), F.lit(350)))
    many = one.drop("id").withColumn("id", n).withColumns({"analysis_id": F.lit(1), "representative_line": F.repeat(F.lit("x"), 65_000)})
    many.select(table(spark, small, "evidence").columns).write.parquet(str(tmp_path / "evidence.parquet"))
    docs = [json.loads(r["document"]) for r in entry.queries()["simple_documents"](spark, str(tmp_path)).collect()]
    assert [(d["evidence_count"], d["returned"], d["truncated"]) for d in docs] == [(350, 350, False)]  # above 20 MiB, but no more than 5,000 rows
    assert entry.queries()["bounded_selection"](spark, str(tmp_path)).count() == 32  # as many lines as 2 MiB hold


def test_components_fit_the_production_budget(spark, small, tmp_path, monkeypatch):
    from lumenlog.plans import results as plans

    ranked = spark.createDataFrame([(1, k, k) for k in range(20)], "analysis_id int, id bigint, component bigint")
    evidence = spark.createDataFrame([(k, "x" * 50_000) for k in range(20)], "id bigint, representative_line string")
    monkeypatch.setattr(plans, "_ranked", lambda *_: (evidence, None, ranked))
    assert entry.queries()["fitting_components"](spark, small).count() == 20 == results.fitting_components(ranked, evidence).count()
