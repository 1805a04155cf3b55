"""Detectors made from a folder of models: fusion by mode or threshold, calibrated scores, whole documents."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.operators import features, fusion, segmentation, training

#: Names the folder of models where no other is given.
MODELS_VARIABLE, MODELS_FOLDER = "SCRIPTORIUM_MODELS", "./models"


@dataclass
class Detector:
    """Five trees and the way their decisions are joined; an encoder where the trees read embeddings."""

    bundle: dict[str, dict]
    fusion: fusion.Fusion = field(default_factory=fusion.Fusion)
    calibrated: bool = False
    encoder: object = None
    dim: int = 64

    def vectors(self, docs: DataFrame) -> DataFrame:
        """(doc_id, para_index, features) of the paragraphs of docs (doc_id, text)."""
        paras = docs.select("doc_id", F.posexplode(segmentation.split_for_scoring(F.col("text"))).alias("para_index", "text"))
        v = features.embed(features.with_online(paras), encoder=self.encoder or features.hashed_encoder(self.dim))
        return v.withColumn("features", features.combine(features.vector(features.ONLINE), F.col("embedding"), online=True)).select("doc_id", "para_index", "features")

    def paragraphs(self, vectors: DataFrame) -> DataFrame:
        """The rows with a decision each."""
        scored = training.score_trees(vectors, {m: b["tree"] for m, b in self.bundle.items()})
        return fusion.fuse_calibrated(scored) if self.calibrated else self.fusion.fuse(scored)

    def documents(self, fused: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        return fusion.document_scores_calibrated(fused) if self.calibrated else fusion.document_scores(fused, docs)

    def detect(self, docs: DataFrame) -> DataFrame:
        """Scored documents. One exchange, by document."""
        return self.documents(self.paragraphs(self.vectors(docs)))

    def results(self, docs: DataFrame, first: int = 20) -> DataFrame:
        """(doc_id, ..., paragraphs): scored documents with the decisions on their first paragraphs."""
        fused = self.paragraphs(self.vectors(docs))
        if self.calibrated:
            fused = fused.withColumn("confidence", F.col("calibrated_score"))
        return self.documents(fused).join(fusion.paragraph_list(fused, first=first), "doc_id", "left")


def create_detector(spark: SparkSession, models: str | None = None, mode: str = "balanced", **more) -> Detector:
    """A detector with the fusion of a mode, from the models in a folder or, where none is given, in `base` beside the working folder."""
    return Detector(training.load_bundle(spark, models or "./base"), fusion.Fusion(mode), **more)


def create_calibrated_detector(spark: SparkSession, models: str | None = None, **more) -> Detector:
    """A calibrated detector; the folder may also be named by the environment. A missing folder is an error."""
    return Detector(training.load_bundle(spark, models or os.getenv(MODELS_VARIABLE, MODELS_FOLDER)), calibrated=True, **more)


def detector(spark: SparkSession, models: str | None, mode: str = "calibrated", **more) -> Detector:
    return create_calibrated_detector(spark, models, **more) if mode == "calibrated" else create_detector(spark, models, mode if mode in P.MODES else "balanced", **more)
