"""Drivers over several operators: the chain of stages, ranks, runs of clients, detectors, readers of odd files."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import runtime
from scriptorium.functions import patterns as P
from scriptorium.operators import detector, evaluation, features, splitting, training, variants
from scriptorium.plans import pipelines
from scriptorium.sources import documents, sinks


def test_corpus_to_hard_samples(spark):
    body = "\n\n".join(f"这是第{i}个足够长的正文段落，内容讨论企业管理研究方法[3]，并给出若干结论与建议供读者参考。" for i in range(9))
    docs = spark.createDataFrame([(i, f"/c/{2016 + i}/x{i}.md", f"# 第一章 绪论\n\n{body}") for i in range(4)], "doc_id long, path string, text string")
    out = pipelines.corpus(docs)
    rows = out["rows"].orderBy("row_id").collect()
    assert [(r["doc_id"], r["para_index"]) for r in rows] == sorted((r["doc_id"], r["para_index"]) for r in rows)
    # of each split three of ten rows are candidates by score, then as they come; half of a document's stay
    assert {r["split"] for r in rows} == {"train"} and sum(r["hard"] for r in rows) == sum(-(-n // 2) for n in (9, 1))
    assert splitting.documents_by_split(out["metadata"]).count() == 4


def test_ranked_is_a_row_number(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i * r.choice([1, 7, 1000]), r.choice("ab") if i % 50 else None, float(r.randrange(4))) for i in range(400)]
    df = spark.createDataFrame(list({x[0]: x for x in rows}.values()), "row_id long, g string, score double")
    want = {x["row_id"]: x["rn"] for x in df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "row_id"))).collect()}
    for buckets, per in ((64, 200_000), (1, 10)):
        monkeypatch.setattr(splitting, "LEAST_BUCKETS", buckets)
        monkeypatch.setattr(splitting, "BUCKET_ROWS", per)
        assert {x["row_id"]: x["rank"] for x in splitting.ranked(df, ["g"], "row_id", "score").collect()} == want
    assert splitting.ranked(df.limit(0), ["g"], "row_id").count() == 0


def test_clients(spark):
    jobs = spark.createDataFrame([(i, f"改写：\n文本{i}研究\n改写后：", 0.7, "train") for i in range(8)], "row_id long, prompt string, temperature double, split string").coalesce(1)
    fails = lambda p, t: (False, "HTTP 503", 503)
    got = variants.generate(jobs, fails, variants.offline_client, slot_col="split").orderBy("row_id").collect()
    assert all(r["ok"] and r["provider"] == "fallback" for r in got) and "分析" in got[0]["answer"]
    got = variants.generate(jobs, fails).collect()
    assert all(not r["ok"] and r["status"] == 503 and r["error"] == "HTTP 503" and r["answer"] is None for r in got)
    stats = {r["provider"]: (r["calls"], r["failed"]) for r in variants.run_statistics(variants.generate(jobs, fails)).collect()}
    assert stats == {"main": (8, 8)}
    ok, text, status = variants.http_client("http://127.0.0.1:9/none", "m", timeout=1.0)("x", 0.5)
    assert not ok and status == 0 and text


def test_policy_and_notice(spark):
    p = variants.ErrorPolicy()
    assert [p.record("a", s) for s in (500, 404, 0, 500)] == [False, False, False, True]
    p.activate("s", now=0.0)
    assert p.active("s", now=539.0) and not p.active("s", now=541.0)
    rows = spark.createDataFrame([("train", "x", 5, 10, 50.0), ("dev", "x", 4, 4, 100.0)], "split string, variant_type string, current long, target int, percentage double")
    sent = []
    assert variants.notify(rows, 540.0, lambda t, b: sent.append((t, b))) and not variants.notify(rows, 1.0, None)
    assert sent[0][0] == "64%, 9 min" and "- dev/x: 4/4 (done)" in sent[0][1] and f"{int((540 / ((9 / 14 * 100) / 100) - 540) / 60)} min left" in sent[0][1]
    assert not variants.notify(rows, 1.0, lambda t, b: 1 / 0)


def test_runs_are_saved_in_batches(spark, tmp_path):
    jobs = spark.createDataFrame([(i, f"改写：\n文本{i}\n改写后：", 0.7, "train", "a", "d", f"文本{i}") for i in range(25)], "row_id long, prompt string, temperature double, split string, variant_type string, doc_id string, original_text string")
    path = str(tmp_path / "v")
    assert sinks.run_variants(jobs.where("row_id < 9"), variants.generate, path, batch=1) == 3
    assert sinks.run_variants(jobs, variants.generate, path, batch=10) == 1
    saved = spark.read.parquet(path)
    assert saved.count() == 25 and sinks.latest_variants(saved.unionByName(saved)).count() == 25


def test_detectors(spark, tmp_path, monkeypatch):
    leaf = {"feature": 0, "threshold": 1000.0, "left": {"p": 0.4}, "right": {"p": 0.1}}
    training.save_specs(spark, {m: {"tree": leaf, "selected": [0, 3], "feature_dim": 77, "use_embedding": m.startswith("bert"), "has_selector": True} for m in P.MODELS}, str(tmp_path / "m"))
    d = detector.create_detector(spark, str(tmp_path / "m"), "balanced")
    docs = spark.createDataFrame([("a", "\n\n".join("内容讨论企业管理研究方法。" * 12 for _ in range(6))), ("b", "")], "doc_id string, text string")
    assert d.bundle[P.MODELS[0]]["selected"] == [0, 3] and d.bundle[P.MODELS[0]]["feature_dim"] == 77
    assert d.paragraphs(d.vectors(docs)).where("is_ai").count() == 6
    d.fusion.set_mode("strict")
    assert d.paragraphs(d.vectors(docs)).where("is_ai").count() == 0
    with pytest.raises(ValueError):
        d.fusion.set_mode("other")
    monkeypatch.setenv(detector.MODELS_VARIABLE, str(tmp_path / "m"))
    assert detector.create_calibrated_detector(spark).detect(docs).first()["total_paragraphs"] == 6
    with pytest.raises(FileNotFoundError):
        detector.create_calibrated_detector(spark, str(tmp_path / "none"))
    training.save_specs(spark, {P.MODELS[0]: leaf}, str(tmp_path / "part"))
    with pytest.raises(FileNotFoundError):
        training.load_bundle(spark, str(tmp_path / "part"))


def test_training_and_evaluation(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for i in range(240):
        y = int(r.random() < 0.5)
        rows.append(([y + r.random(), r.random()], y, ("train", "dev", "dev_hard", "test")[i % 4 if i % 3 else 0], "hard" if i % 4 == 2 else "standard"))
    df = spark.createDataFrame(rows, "features array<double>, label int, split string, difficulty_level string")
    fitted, metrics, best = training.train(df, ("gbdt", "rf", "lr", "none"), maxIter=5, numTrees=5)
    m = {(x["model"], x["split"]): x for x in metrics.collect()}
    assert set(fitted) == {"gbdt", "rf", "lr"} and best in fitted and m[("none", None)]["error"]
    assert m[("gbdt", "dev")]["auc"] is not None or m[("gbdt", "dev")]["f1"] >= 0.0
    training.save_training(fitted, metrics, best, str(tmp_path))
    again = training.score(training.load_model(str(tmp_path), "lr"), df).agg(F.sum("p")).first()[0]
    assert abs(again - training.score(fitted["lr"], df).agg(F.sum("p")).first()[0]) < 1e-9
    results, risks = evaluation.run(df, {"lr": lambda d: training.score(fitted["lr"], d), "bad": lambda d: 1 / 0})
    got = {(x["model"], x["split"]): x["error"] for x in results.collect()}
    assert got[("lr", "dev")] is None and "ZeroDivisionError" in got[("bad", "test")] and risks.count() == 1
    sinks.write_evaluation(results, risks, str(tmp_path / "e"))
    assert "AUC" in "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "e/evaluation_summary")).collect())


def test_odd_files(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes("好".encode() + b"\xff\xfe" + "的\r\nx�".encode())
    (tmp_path / "v.json").write_text("[{broken")
    (tmp_path / "w.json").write_text('[{"original_text": "a", "doc_id": "d"}]')
    assert documents.read_text(spark, str(tmp_path), "*.txt").first()["text"] == "好的\nx�"
    assert documents.read_existing(spark, str(tmp_path / "none")).count() == 0
    assert documents.read_existing(spark, str(tmp_path / "v.json")).count() == 0
    assert documents.read_existing(spark, str(tmp_path / "w.json")).first()["doc_id"] == "d"
    (tmp_path / "dev_features.json").write_text('{"features": [{"bert_features": [1.0, 2.0], "char_count": 3, "label": 1}, {"bert_features": [1.0], "stat_features": [5.0]}]}')
    got = {tuple(r["features"]): (r["label"], r["split"], r["difficulty_level"]) for r in documents.read_features(spark, str(tmp_path / "dev_features.json")).collect()}
    assert got == {(1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0): (1, "dev", "standard"), (1.0, 5.0): (0, "dev", "standard")}


def test_encoder_batches(spark):
    texts = ["研究管理的企业", None, "", "ab", "研究管理的企业"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    v = {r["i"]: r["embedding"] for r in features.embed(df).collect()}
    assert v[0] == v[4] and abs(sum(x * x for x in v[0]) - 1.0) < 1e-9 and not any(v[1]) and not any(v[2]) and not any(v[3]) and all(len(x) == 64 for x in v.values())


def test_intermediate_tables_are_released(spark):
    df = runtime.cut(spark.range(3), "x")
    assert df.count() == 3
    runtime.release(spark)
    assert spark.sparkContext._scriptorium_cuts == []
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
