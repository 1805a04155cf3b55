"""OR-fusion of small trees on probability columns, calibrated or not, and the roll-up to documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.text import fixed


@dataclass
class Fusion:
    """Threshold of the fusion, by mode or of one's own."""

    mode: str = "balanced"
    threshold: float | None = None

    def __post_init__(self) -> None:
        if self.threshold is None:
            self.threshold = P.MODES.get(self.mode, 0.35)

    def set_mode(self, mode: str) -> None:
        if mode not in P.MODES:
            raise ValueError(f"unknown mode {mode}; one of {sorted(P.MODES)}")
        self.mode, self.threshold = mode, P.MODES[mode]

    def set_threshold(self, threshold: float) -> None:
        if not 0.0 <= threshold <= 1.0:
            raise ValueError("a threshold lies between 0 and 1")
        self.mode, self.threshold = f"custom_{threshold:.2f}", threshold

    def fuse(self, df: DataFrame) -> DataFrame:
        return fuse(df, self.threshold)


def _first_over(probs: list[Column], limits: list[float]) -> Column:
    """The number (from 1) of the first model over its limit, null if none is."""
    out = None
    for i, (p, t) in enumerate(zip(probs, limits), 1):
        out = F.when(p > t, i) if out is None else out.when(p > t, i)
    return out


def _names() -> Column:
    return F.array(*(F.lit(m) for m in P.MODELS))


def _map(k: Column, probs: Column) -> Column:
    """The probabilities of the models evaluated up to the one that triggered."""
    return F.map_from_arrays(F.slice(_names(), F.lit(1), k), F.slice(probs, F.lit(1), k))


def fuse(df: DataFrame, threshold: float = 0.35, models: tuple[str, ...] = P.MODELS) -> DataFrame:
    """is_ai, confidence, triggered_by, all_model_probs, max_prob of each row with a probability column per model."""
    probs = [F.col(m) for m in models]
    d = df.withColumn("_p", F.array(*probs)).withColumn("_k", _first_over(probs, [threshold] * len(models)))
    hit = F.col("_k").isNotNull()
    return (
        d.withColumn("is_ai", hit).withColumn("max_prob", F.greatest(*probs)).withColumn("confidence", F.when(hit, F.get("_p", F.col("_k") - 1)).otherwise(F.greatest(*probs)))
        .withColumn("triggered_by", F.when(hit, F.get(_names(), F.col("_k") - 1)).otherwise("none"))
        .withColumn("all_model_probs", _map(F.coalesce("_k", F.lit(len(models))), F.col("_p"))).drop("_p", "_k")
    )


def fuse_calibrated(df: DataFrame, factor: float = P.CALIBRATION, limits: dict[str, float] | None = None) -> DataFrame:
    """is_ai, raw_probability, calibrated_score, triggered_by: the first model over its own limit, else the first of the greatest."""
    limits = limits or P.CALIBRATED
    probs = [F.col(m) for m in P.MODELS]
    d = df.withColumn("_p", F.array(*probs)).withColumn("_k", _first_over(probs, [limits[m] for m in P.MODELS]))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    d = d.withColumn("_b", F.coalesce("_k", best)).withColumn("raw_probability", F.get("_p", F.col("_b") - 1))
    return (
        d.withColumn("is_ai", F.col("_k").isNotNull() | (F.col("raw_probability") > 0.50)).withColumn("calibrated_score", F.col("raw_probability") * F.lit(factor))
        .withColumn("triggered_by", F.get(_names(), F.col("_b") - 1)).withColumn("all_model_probs", _map(F.coalesce("_k", F.lit(len(P.MODELS))), F.col("_p"))).drop("_p", "_k", "_b")
    )


def paragraph_risk(confidence: Column) -> Column:
    """Fixed cut-offs, whatever the mode is."""
    return F.when(confidence > 0.5, "high").when(confidence > 0.35, "medium").otherwise("low")


def document_scores(fused: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Per document: mean confidence, counts and shares of risks; documents without paragraphs score 0."""
    r = fused.withColumn("risk", paragraph_risk(F.col("confidence")))
    d = r.groupBy("doc_id").agg(F.avg("confidence").alias("doc_ai_score"), F.count("*").alias("n"), *(F.count_if(F.col("risk") == k).alias(f"{k}_risk_count") for k in ("high", "medium", "low")))
    if docs is not None:
        d = docs.select("doc_id").distinct().join(d, "doc_id", "left").fillna(0)
    share = [F.when(F.col("n") > 0, F.col(f"{k}_risk_count") / F.col("n")).otherwise(0.0).alias(f"{k}_share") for k in ("high", "medium", "low")]
    return d.select("doc_id", F.coalesce("doc_ai_score", F.lit(0.0)).alias("doc_ai_score"), "n", "high_risk_count", "medium_risk_count", "low_risk_count", *share)


def paragraph_list(fused: DataFrame, order: str = "para_index", first: int | None = None) -> DataFrame:
    """(doc_id, paragraphs): the ordered results of a document as an array; reports may show the first ones only, and then no more are gathered."""
    if first:
        w = Window.partitionBy("doc_id").orderBy(order)
        fused = fused.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first).drop("_rn")
    item = F.struct(F.col(order).alias("paragraph_id"), "is_ai", "confidence", "triggered_by", paragraph_risk(F.col("confidence")).alias("risk_level"))
    return fused.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("paragraphs"))


def document_risk(score: Column) -> Column:
    out = None
    for cut, name in P.RISKS:
        out = F.when(score < cut, name) if out is None else out.when(score < cut, name)
    return out.otherwise(P.HIGHEST_RISK)


def document_scores_calibrated(fused: DataFrame, factor: float = P.CALIBRATION) -> DataFrame:
    d = fused.groupBy("doc_id").agg(F.avg("calibrated_score").alias("doc_calibrated_score"), F.count_if("is_ai").alias("ai_paragraph_count"), F.count("*").alias("total_paragraphs"))
    return d.select(
        "doc_id", "doc_calibrated_score", (F.col("doc_calibrated_score") / factor).alias("doc_raw_score"), document_risk(F.round("doc_calibrated_score", 12)).alias("risk_level"),
        "ai_paragraph_count", "total_paragraphs", (F.col("ai_paragraph_count") / F.col("total_paragraphs")).alias("ai_ratio"))


def model_descriptors(spark, dims: dict[str, int] | None = None, bundle: dict[str, dict] | None = None) -> DataFrame:
    """(model, feature_dim, use_embedding, has_selector), of a loaded bundle or by the names of the models."""
    dims, bundle = dims or {}, bundle or {}
    rows = [(m, int(bundle.get(m, {}).get("feature_dim", dims.get(m, 0))), bool(bundle.get(m, {}).get("use_embedding", m.startswith("bert"))), bool(bundle.get(m, {}).get("has_selector", not m.startswith("bert")))) for m in P.MODELS]
    return spark.createDataFrame(rows, "model string, feature_dim int, use_embedding boolean, has_selector boolean")


def explain(fused: DataFrame, threshold: float = 0.35) -> Column:
    """A text on each decision: models by falling probability, those over the threshold marked."""
    rows = F.array_sort(F.map_entries("all_model_probs"), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))
    lines = F.transform(rows, lambda e: F.concat(F.format_string("  %-20s: %.3f", e["key"], e["value"]), F.when(e["value"] > threshold, " ✓").otherwise("")))
    head = F.concat_ws(
        "\n", F.concat(F.lit("AIGC检测结果: "), F.when(F.col("is_ai"), "高风险").otherwise("低风险")), F.lit(f"触发阈值: {threshold}"), F.format_string("最高置信度: %.3f", F.col("confidence")), F.concat(F.lit("触发模型: "), F.col("triggered_by")), F.lit(""), F.lit("各模型概率:"))
    return F.concat(head, F.lit("\n"), F.array_join(lines, "\n"))


def report_line() -> Column:
    """One line on a calibrated document."""
    return F.format_string("%s: %s%% %s, %d/%d (%s%%)", F.col("doc_id").cast("string"), fixed(F.col("doc_calibrated_score") * 100, 1), "risk_level", "ai_paragraph_count", "total_paragraphs", fixed(F.col("ai_ratio") * 100, 1))


def report_text() -> Column:
    """The report on a calibrated document with the scale of risks, as it is printed."""
    rule = "=" * 60
    return F.concat_ws(
        "\n", F.lit(rule), F.lit("AIGC检测结果 (CNKI校准版)"), F.lit(rule), F.lit(""), F.format_string("文档级AIGC分数: %s%%", fixed(F.col("doc_calibrated_score") * 100, 1)), F.concat(F.lit("风险等级: "), "risk_level"),
        F.format_string("AI段落: %d/%d (%s%%)", "ai_paragraph_count", "total_paragraphs", fixed(F.col("ai_ratio") * 100, 1)), F.lit(""), F.lit("说明: 该分数经过CNKI校准，更接近知网AIGC检测的AI特征值"), F.lit(""),
        F.lit("风险阈值参考:"), F.lit("  - 低风险: <15%"), F.lit("  - 中风险: 15-30%"), F.lit("  - 较高风险: 30-50%"), F.lit("  - 高风险: >50%"), F.lit(rule))
