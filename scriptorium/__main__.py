"""Command line: python -m scriptorium STAGE INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.operators import evaluation, features, fusion, metadata, quality_control, segmentation, splitting, training, variants
from scriptorium.operators.detector import detector
from scriptorium.plans import pipelines
from scriptorium.runtime import release, session, ship
from scriptorium.sources import documents, sinks

STAGES = ("clean", "segment", "metadata", "split", "variants", "fix", "features", "train", "evaluate", "detect")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("input", help="a folder of documents, a document (detect), or the table the stage before wrote")
    p.add_argument("output", nargs="?", help="where the stage writes; detect prints reports without it")
    p.add_argument("-o", "--output", dest="also_output", help="the same, for detect")
    p.add_argument("--min_length", type=int, default=P.MIN_LENGTH)
    p.add_argument("--max_length", type=int, default=P.MAX_LENGTH)
    p.add_argument("--hard_ratio", type=float, default=P.HARD_RATIO)
    p.add_argument("--paragraphs", help="table of paragraphs, for metadata and split")
    p.add_argument("--variants", help="table of variants, for variants, features and fix")
    p.add_argument("--metadata", help="table of metadata, for fix")
    p.add_argument("--target", type=int, default=400, help="variants of each split and type")
    p.add_argument("--encoder", help="folder of model.onnx and tokenizer.json; a hashed stand-in without it")
    p.add_argument("--batch", type=int, default=8, help="texts the encoder reads at a time")
    p.add_argument("-m", "--models", help="folder of models, for detect and evaluate")
    p.add_argument("--mode", default="calibrated", choices=("calibrated", *P.MODES))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    out = a.output or a.also_output
    if out is None and a.stage != "detect":
        parser().error("an output is needed")
    spark = session("scriptorium")
    ship(spark)
    encoder = features.model_encoder(a.encoder, a.batch) if a.encoder else None
    if a.stage == "clean":
        r = quality_control.process(documents.read_markdown(spark, a.input)).withColumn("relative_path", sinks.relative_path(F.col("path"), a.input))
        sinks.write_cleaned(r, f"{out}/cleaned", a.input)
        sinks.write_json(sinks.report_rows(r), f"{out}/report")
    elif a.stage == "segment":
        docs = documents.read_markdown(spark, a.input)
        paras = segmentation.keep_lengths(segmentation.segment(docs, extra=("year",)), a.min_length, a.max_length)
        sinks.write_table(paras, f"{out}/paragraphs")
        sinks.write_table(segmentation.distributions(spark.read.parquet(f"{out}/paragraphs")), f"{out}/distributions")
    elif a.stage == "metadata":
        docs = documents.read_markdown(spark, a.input)
        paras = spark.read.parquet(a.paragraphs) if a.paragraphs else None
        sinks.write_metadata(metadata.extract(documents.markdown_with_paragraphs(docs, paras) if paras is not None else docs, paras), out)
    elif a.stage == "split":
        rows = pipelines.split_rows(spark.read.parquet(a.paragraphs), spark.read.parquet(a.input))
        sinks.write_splits(splitting.hard_samples(rows, a.hard_ratio), out)
    elif a.stage == "variants":
        rows = spark.read.parquet(a.input)
        have = documents.read_existing(spark, a.variants or out)
        counts = (have if "split" in have.columns else have.withColumn("split", F.lit(None).cast("string"))).groupBy("split", "variant_type").agg(F.count("*").alias("have"))
        jobs = variants.quota(variants.eligible(rows), counts, variants.fan_out(spark, target=a.target)).withColumnRenamed("text", "original_text")
        jobs = jobs.withColumn("prompt", variants.prompt(F.col("original_text"), F.col("variant_type"))).withColumn("temperature", variants.temperature(F.col("variant_type")))
        jobs = jobs.select("row_id", "original_text", "variant_type", "doc_id", "year", "para_type", "chapter_role", "split", "prompt", "temperature")
        sinks.write_variants(variants.generate(jobs).withColumn("variant_text", F.col("answer")).drop("prompt", "temperature", "answer"), out)
    elif a.stage == "fix":
        rows = splitting.repaired_years(spark.read.parquet(a.input), spark.read.parquet(a.metadata))
        sinks.write_table(splitting.moved(rows), out)
    elif a.stage == "features":
        rows = features.training_rows(spark.read.parquet(a.input), spark.read.parquet(a.variants))
        sinks.write_features(features.training_features(rows, encoder), out)
    elif a.stage == "train":
        fitted, metrics, best = training.train(documents.read_features(spark, a.input))
        training.save_training(fitted, metrics, best, out)
    elif a.stage == "evaluate":
        rows = documents.read_features(spark, a.input)
        scorers = {n: (lambda d, n=n: training.score(training.load_model(a.models, n), d)) for n in ("gbdt", "rf", "lr")}
        sinks.write_evaluation(*evaluation.run(rows, scorers), out)
    else:
        docs = documents.read_documents(spark, a.input).select(metadata.stem(F.col("path")).alias("doc_id"), "text")
        d = detector(spark, a.models, a.mode, encoder=encoder)
        if out:
            sinks.write_json(d.results(docs), out)
        else:
            text = fusion.report_text() if d.calibrated else F.to_json(F.struct("*"))
            for r in d.detect(docs).select(text.alias("t")).toLocalIterator():
                print(r["t"])
    release(spark)


if __name__ == "__main__":
    main()
