"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.plans.relational import message_sql
from lumenlog.session import table
from lumenlog.llm import abuse, components, leaks, packing, scans, survivors

#: Columns of ``evidence`` and whether they hold text.
_COLUMNS = dict.fromkeys("correlation_key fingerprint event_type severity trace_id request_id span_id parent_span_id service module host pod endpoint source_file source_format representative_line resolved_identity identity_match_type diagnostic_attributes".split(), True)
_COLUMNS |= dict.fromkeys("id analysis_id artifact_id http_status first_seen last_seen occurrence_count first_line_number last_line_number identity_strength ocr_confidence".split(), False)


def p1_found(spark, d):
    return survivors.duplicate_representatives(table(spark, d, "evidence"))


def p1_survivors(spark, d):
    return survivors.evidence_survivors(table(spark, d, "evidence"))


def p2_found(spark, d):
    return scans.Scans(table(spark, d, "scanned_pages")).defects()


def p2_paragraphs(spark, d):
    return scans.Scans(table(spark, d, "scanned_pages")).paragraphs()


def p4_found(spark, d):
    return components.evidence_groups(table(spark, d, "correlation_edges"))


def p8_windows(spark, d):
    return packing.pack(packing.document_sizes(table(spark, d, "documents")), table(spark, d, "context_windows"))


def p9_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_cleaned(spark, d):
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _scored(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text", "source")
    return abuse.score_documents(documents, abuse.train(documents, table(spark, d, "doc_labels")))


def p10_found(spark, d):
    return _scored(spark, d).filter(F.col("abuse_score") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark, d):
    return _scored(spark, d).select("doc_id", "source", "abuse_score")


def p10_rates(spark, d):
    return abuse.rates(_scored(spark, d))


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p4_found": p4_found, "p8_windows": p8_windows, "p9_found": p9_found, "p9_cleaned": p9_cleaned, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
_GROUPS = f"""WITH k AS (SELECT *, nullif(regexp_replace(regexp_replace({message_sql("fingerprint")}, '\\s+', ' ', 'g'), '^([^:\\s]*)\\s*:\\s*', '\\1:'), '') AS f,
 coalesce(nullif(regexp_extract(lower(coalesce(correlation_key, '')), '([0-9a-f]{{64}})', 1), ''), sha256(concat_ws('|', {", ".join(f"coalesce(nullif(nullif(lower(trim({c})), ''), '__none__'), '__none__')" for c in ("trace_id", "request_id", "span_id"))}))) AS i FROM evidence),
 n AS (SELECT k.*, list_sum([{", ".join("CAST(" + (f"{c} IS NOT NULL AND {c} <> ''" if t else f"{c} IS NOT NULL") + " AS INTEGER)" for c, t in _COLUMNS.items())}]) AS filled FROM k WHERE f IS NOT NULL)
SELECT id AS evidence_id FROM (SELECT id, row_number() OVER (PARTITION BY analysis_id, f, i ORDER BY filled DESC, last_seen DESC NULLS LAST, id) AS place, count(*) OVER (PARTITION BY analysis_id, f, i) AS n FROM n) WHERE place = 1 AND n > 1"""
_TRUST = "CASE " + " ".join(f"WHEN lower(trim(source_format)) IN ({', '.join(repr(x) for x in v)}) THEN {k}" for k, v in survivors.TRUST.items()) + " ELSE 0 END"
_FILLED = {c: f"CAST({c} IS NOT NULL AND {c} <> '' AS INTEGER)" if t else f"CAST({c} IS NOT NULL AS INTEGER)" for c, t in _COLUMNS.items()}
_EXTREME = {"first_seen": "min", "first_line_number": "min", "last_seen": "max", "last_line_number": "max", "occurrence_count": "max"}
_FIELD = {c: f"{_EXTREME[c]}({c})" if c in _EXTREME else f"arg_max_null({c}, {{'f': {_FILLED[c]}, 'p': priority, 't': coalesce(last_seen, TIMESTAMP '0001-01-01'), 'n': CAST({c} IS NOT NULL AS INTEGER), 'v': coalesce({c}, {repr('') if t else 0})}})" for c, t in _COLUMNS.items()}
_SURVIVORS = f"""WITH k AS ({_GROUPS.split("WITH k AS (", 1)[1].split("FROM evidence)", 1)[0]}FROM evidence),
n AS (SELECT k.*, {" + ".join(_FILLED.values())} AS filled FROM k), r AS (SELECT *, {_TRUST} * 1000 + filled AS priority, CASE WHEN analysis_id IS NULL OR f IS NULL OR i IS NULL THEN id END AS alone FROM n)
SELECT analysis_id AS same_analysis, f AS same_fingerprint, i AS same_key, arg_max(id, {{'f': filled, 'n': CAST(last_seen IS NOT NULL AS INTEGER), 't': coalesce(last_seen, TIMESTAMP '0001-01-01'), 'i': -id}}) AS best_id, count(*) AS copies, {", ".join(f"{e} AS {c}_" for c, e in _FIELD.items() if c != "id")} FROM r GROUP BY analysis_id, f, i, alone"""
_SURVIVORS = f"SELECT same_analysis, same_fingerprint, same_key, best_id, copies, {', '.join(f'{c}_ AS {c}' for c in _COLUMNS if c != 'id')} FROM ({_SURVIVORS})"
_ID = "try_cast(nullif(regexp_extract({c}, '(?i)^\\s*evidence-(\\d+)\\s*$', 1), '') AS BIGINT)"
_LINKED = f"""WITH RECURSIVE e0 AS (SELECT {_ID.format(c="source_id")} AS a, {_ID.format(c="target_id")} AS b FROM correlation_edges), e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach(u, v) AS (SELECT a, a FROM e UNION SELECT reach.u, e.b FROM reach JOIN e ON e.a = reach.v) SELECT min(v) AS group_id, u AS evidence_id FROM reach GROUP BY u"""
ORACLES: dict[str, str] = {"p1_found": _GROUPS, "p1_survivors": _SURVIVORS, "p4_found": _LINKED}
