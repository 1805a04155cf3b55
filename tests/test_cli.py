"""The stages from the command line."""

import pytest

from scriptorium.__main__ import main, parser
from scriptorium.functions import patterns as P
from scriptorium.operators import training
from scriptorium.sources import sinks


def test_defaults():
    a = parser().parse_args(["segment", "in", "out"])
    assert (a.min_length, a.max_length, a.hard_ratio, a.mode) == (20, 2000, 0.3, "calibrated")
    with pytest.raises(SystemExit):
        parser().parse_args(["other", "in", "out"])


def test_stages(spark, tmp_path):
    for y, n in ((2021, "a"), (2016, "b")):
        d = tmp_path / "in" / str(y)
        d.mkdir(parents=True)
        (d / f"{n}.md").write_text("# 第一章 绪论\n\n" + "\n\n".join(f"这是第{i}个足够长的正文段落，内容讨论企业管理研究方法[3]，并给出若干结论与建议供读者参考。" for i in range(9)))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    main(["clean", src, out])
    assert spark.read.parquet(f"{out}/cleaned").count() == 2
    main(["segment", src, out])
    assert spark.read.parquet(f"{out}/paragraphs").count() == 18
    main(["metadata", src, out, "--paragraphs", f"{out}/paragraphs"])
    assert spark.read.parquet(f"{out}/metadata").count() == 2
    main(["split", f"{out}/metadata", f"{out}/splits", "--paragraphs", f"{out}/paragraphs"])
    assert {r["split"] for r in spark.read.parquet(f"{out}/splits").select("split").distinct().collect()} == {"dev", "dev_hard", "train"}
    leaf = {"feature": 0, "threshold": 1000.0, "left": {"p": 0.6}, "right": {"p": 0.1}}
    training.save_specs(spark, {m: leaf for m in P.MODELS}, f"{out}/trees")
    main(["detect", src, f"{out}/scores", "-m", f"{out}/trees"])
    assert spark.read.json(f"{out}/scores").count() == 2
    assert spark.read.parquet(f"{out}/splits/_split_index").count() == 2 and spark.read.parquet(f"{out}/splits/_statistics").count() == 2
    assert {r["relative_path"] for r in spark.read.parquet(f"{out}/cleaned").collect()} == {"2021/a.md", "2016/b.md"}
    assert sinks.export_cleaned(spark.read.parquet(f"{out}/cleaned"), f"{out}/files") == 2 and (tmp_path / "out/files/2016/b.md").exists()


def test_one_document(spark, tmp_path, capsys):
    leaf = {"feature": 0, "threshold": 1000.0, "left": {"p": 0.6}, "right": {"p": 0.1}}
    training.save_specs(spark, {m: leaf for m in P.MODELS}, str(tmp_path / "trees"))
    doc = tmp_path / "one.txt"
    doc.write_text("\n\n".join(f"这是第{i}个足够长的正文段落，" + "内容讨论企业管理研究方法。" * 12 for i in range(30)))
    main(["detect", str(doc), "-m", str(tmp_path / "trees")])
    assert "风险等级: 较高风险" not in capsys.readouterr().out
    main(["detect", str(doc), "-o", str(tmp_path / "one.json"), "-m", str(tmp_path / "trees")])
    r = spark.read.json(str(tmp_path / "one.json")).first()
    assert r["total_paragraphs"] == 30 and len(r["paragraphs"]) == 20 and r["ai_ratio"] == 1.0
    with pytest.raises(FileNotFoundError):
        main(["detect", str(doc), "-m", str(tmp_path / "none")])


def test_training_stages(spark, sf, tmp_path):
    out = str(tmp_path)
    p = spark.read.parquet(f"{sf}/paragraphs.parquet")
    p.write.parquet(f"{out}/p")
    main(["variants", f"{out}/p", f"{out}/v", "--target", "4"])
    v = spark.read.parquet(f"{out}/v")
    assert v.count() > 0 and v.where("ok").count() == v.count()
    main(["features", f"{out}/p", f"{out}/f", "--variants", f"{sf}/variants.parquet"])
    f = spark.read.parquet(f"{out}/f")
    assert f.where("size(combined_features) <> 64 + 13").count() == 0 and {r["label"] for r in f.select("label").distinct().collect()} == {0, 1}
    main(["train", f"{out}/f", f"{out}/m"])
    assert {r["model"] for r in spark.read.json(f"{out}/m/training_results").collect()} == {"gbdt", "rf", "lr"}
    main(["evaluate", f"{out}/f", f"{out}/e", "-m", f"{out}/m"])
    assert spark.read.json(f"{out}/e/evaluation_results").where("f1 IS NOT NULL").count() >= 6
    assert "模型: gbdt" in "\n".join(r["value"] for r in spark.read.text(f"{out}/e/evaluation_summary").collect())
