"""document_fingerprints covers every document, whatever its script."""

import hashlib
import re

import __spark_entry__ as entry

UUID = re.compile(r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b")


def brute(text):
    if text is None:
        return None
    f = "event:" + re.sub(r"\b\d+\b", "<number>", UUID.sub("<uuid>", text)).lower().strip()
    return f if len(f) <= 255 else f"{f[:190]}:{hashlib.sha256(f.encode()).hexdigest()}"


def test_all_documents_by_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert any(t and not t.isascii() for t in texts.values())
    got = {r["doc_id"]: r["fingerprint"] for r in entry.queries()["document_fingerprints"](spark, small).collect()}
    assert got == {k: brute(t) for k, t in texts.items()}


def test_other_scripts_and_missing_texts(spark, tmp_path):
    texts = ["Größe 12 von 3ü4", "é92b6179c-31da-79f1-4ad1-5d508a59afb3 und 92b6179c-31da-79f1-4ad1-5d508a59afb3", "  ÄRGER ٣٤ 漢字 7 ", "ß" * 400, " x ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["fingerprint"] for r in entry.queries()["document_fingerprints"](spark, str(tmp_path)).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
