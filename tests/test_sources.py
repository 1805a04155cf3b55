"""Readers, writers, streams and the whole pipeline on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import pipelines
from scriptorium.sources import documents, sinks
from scriptorium.streaming import ingest


def test_markdown(spark, tmp_path):
    d = tmp_path / "2016"
    d.mkdir()
    (d / "a.md").write_bytes("# 标题\r\n正文".encode())
    (d / "qc_x.md").write_text("no")
    (d / "b.txt").write_text("no")
    rows = documents.read_markdown(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["year"], r["text"]) for r in rows] == [("a", 2016, "# 标题\n正文")]


def test_docx_and_dispatch(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>一段</w:t></w:p><w:p><w:t>二段</w:t></w:p>")
    (tmp_path / "y.TXT").write_text("文本")
    rows = {r["path"].rsplit("/", 1)[1]: r["text"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"x.docx": "一段\n二段\n", "y.TXT": "文本"}
    assert documents.docx_text(b"broken") == ""
    (tmp_path / "z.xls").write_text("no")
    with pytest.raises(Exception, match="no reader"):
        documents.read_documents(spark, str(tmp_path)).collect()


def test_variant_files(spark, tmp_path):
    good = [{"original_text": "a", "variant_text": "b", "variant_type": "hard_human", "doc_id": "d", "year": 2016, "para_type": "normal", "chapter_role": "other"}]
    (tmp_path / "dev_hard_human_variants.json").write_text(json.dumps(good))
    (tmp_path / "train_x_variants.json").write_text("{broken")
    rows = documents.read_variant_files(spark, str(tmp_path)).collect()
    assert [(r["split"], r["file_type"], r["doc_id"]) for r in rows] == [("dev", "hard_human", "d")]


def test_envelope_and_existing(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"metadata": [{"doc_id": "a", "year": 2016}]}))
    (tmp_path / "n.json").write_text(json.dumps({"other": 1}))
    assert documents.read_json_envelope(spark, str(tmp_path / "m.json")).select("doc_id", "year").collect()[0]["year"] == 2016
    assert documents.read_json_envelope(spark, str(tmp_path / "n.json")).count() == 0
    assert documents.read_existing(spark, str(tmp_path / "none")).count() == 0


def test_splits_written_by_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "dev", True), (2, "dev", False), (3, "train", True)], "row_id int, split string, hard boolean")
    sinks.write_splits(df, str(tmp_path / "out"))
    got = {(r["row_id"], r["split"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "dev_hard"), (2, "dev"), (3, "train")}


def test_stream(spark, tmp_path):
    schema = "doc_id string, text string, ingested_at timestamp"
    spark.createDataFrame([("a", "12\n正文")], "doc_id string, text string").withColumn("ingested_at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    seen = []
    q = ingest.ingest(ingest.read_stream(spark, str(tmp_path / "in"), schema), lambda df, n: seen.extend(df.select("doc_id", "status").collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r["doc_id"], r["status"]) for r in seen] == [("a", "fixed")]


def test_corpus_pipeline(spark):
    text = "# 第一章 绪论\n\n" + "\n\n".join("这是第%d个足够长的正文段落，内容讨论企业管理研究方法[3]。" % i for i in range(8))
    docs = spark.createDataFrame([("a", "/c/2021/a/a.md", text), ("b", "/c/2016/b/b.md", text), ("e", "/c/x/e.md", "")], "doc_id string, path string, text string")
    out = pipelines.corpus(docs)
    assert out["paragraphs"].where("doc_id = 'a'").count() == 8
    assert {r["split"] for r in out["rows"].select("split").distinct().collect()} == {"dev", "train"}
    assert out["metadata"].count() == 2
