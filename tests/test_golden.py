"""Literal cases worked out by hand, without any pattern or table of the library."""

import datetime as dt

from pyspark.sql import functions as F

from scriptorium.operators import evaluation, features, fusion, quality_control, segmentation, splitting
from scriptorium.streaming import ingest


def one(spark, f, t):
    return spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


def test_sentences(spark):
    assert one(spark, segmentation.sentence_count, "甲。乙。") == 2
    assert features.with_training(spark.createDataFrame([("甲。乙。",)], "text string")).first()["sentence_count"] == 3


def test_risks_at_their_edges(spark):
    doc = spark.createDataFrame([("a", 0.15, False), ("b", 0.1499, False), ("c", 0.30, False), ("d", 0.5, True)], "doc_id string, calibrated_score double, is_ai boolean")
    got = {r["doc_id"]: r["risk_level"] for r in fusion.document_scores_calibrated(doc).collect()}
    assert got == {"a": "中风险", "b": "低风险", "c": "较高风险", "d": "高风险"}
    f = spark.createDataFrame([("m1", "dev", 0.75), ("m1", "dev_hard", 0.5), ("m2", "dev", 0.75), ("m2", "dev_hard", 0.625), ("m3", "dev", 0.5), ("m3", "dev_hard", 0.5)], "model string, split string, f1 double")
    assert {r["model"]: r["risk"] for r in evaluation.overfit_risk(f).collect()} == {"m1": "high", "m2": "medium", "m3": "low"}


def test_uncertain_rows_include_both_ends(spark):
    rows = spark.createDataFrame([(1, p, 1) for p in (0.4, 0.6, 0.39, 0.61)], "y int, p double, pred int").withColumn("k", F.lit("x"))
    assert evaluation.metrics(rows, ["k"]).first()["uncertain_ratio"] == 0.5


def test_half_of_a_documents_candidates(spark):
    for n, kept in ((1, 1), (2, 1), (3, 2), (4, 2)):
        rows = spark.createDataFrame([(i, "d", "train", 100, True, False, "findings", "normal") for i in range(n)], "row_id long, doc_id string, split string, char_count int, has_citation boolean, has_formula boolean, chapter_role string, para_type string")
        assert splitting.hard_samples(rows, 1.0).where("hard").count() == kept


def test_report_of_a_document(spark):
    text = "# 第一章 绪论\n" + "企业管理研究。" * 200 + "\n参考文献"
    r = quality_control.process(spark.createDataFrame([("a", text), ("b", None), ("c", "A B C D")], "doc_id string, text string"))
    got = {x["doc_id"]: x for x in r.collect()}
    assert got["a"]["has_chapter_structure"] and got["a"]["has_valid_ending"] and got["a"]["status"] in ("passed", "warning") and got["a"]["chinese_ratio"] > 0.8
    assert got["b"]["status"] == "error" and got["c"]["cleaned"] == "ABCD" and got["c"]["status"] == "fixed"


def test_windowed_counts(spark, tmp_path):
    t = dt.datetime(2024, 1, 10, 12)
    rows = [("train", "ab", t), ("train", "c", t + dt.timedelta(hours=1)), ("dev", "d", t + dt.timedelta(days=1))]
    schema = "split string, text string, ingested_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(ingest.read_stream(spark, str(tmp_path / "in"), schema), "split").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["split"], r["n"], r["chars"]) for r in spark.table("counts").collect()} == {("train", 2, 3), ("dev", 1, 1)}
