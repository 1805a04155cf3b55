"""Metrics of scored rows: (model, split, difficulty, y, p, pred)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import fixed


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def auc(df: DataFrame, keys: list[str], out: str = "auc") -> DataFrame:
    """The area under the ROC curve by mid-ranks; null unless both classes occur.

    Rows are first counted by distinct probability, so the window runs over probabilities and not over rows.
    """
    h = df.groupBy(*keys, "p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    g = h.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return g.select(*keys, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).alias(out))


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, precision, recall and F1 of class 1, accuracy, macro F1 and the share of uncertain rows, in one aggregation."""
    y, q = F.col("y") == 1, F.col("pred") == 1
    g = df.groupBy(*keys).agg(
        F.count("*").alias("total_samples"), F.count_if(y).alias("positive_samples"), F.count_if(~y).alias("negative_samples"),
        F.count_if(y & q).cast("double").alias("tp"), F.count_if(~y & q).cast("double").alias("fp"), F.count_if(y & ~q).cast("double").alias("fn"), F.count_if(~y & ~q).cast("double").alias("tn"),
        F.avg(F.col("p").between(0.4, 0.6).cast("double")).alias("uncertain_ratio"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    # a class that neither occurs nor is predicted is no class of the macro mean
    n1, n0 = (tp + fp + fn > 0).cast("double"), (tn + fp + fn > 0).cast("double")
    return g.select(
        *keys, "total_samples", "positive_samples", "negative_samples", _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), f1.alias("f1"),
        ((tp + tn) / F.col("total_samples")).alias("accuracy"), _div(f1 * n1 + f0 * n0, n1 + n0).alias("macro_f1"), "uncertain_ratio")


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, pred_0, pred_1): rows are the true class."""
    return df.groupBy(*keys, "y").pivot("pred", [0, 1]).agg(F.count("p")).select(*keys, "y", F.coalesce("0", F.lit(0)).alias("pred_0"), F.coalesce("1", F.lit(0)).alias("pred_1"))


def by_difficulty(df: DataFrame, keys: list[str]) -> DataFrame:
    """AUC of standard and of hard rows; of hard rows recall, the figure published as precision (the same mean over positives), and true precision. Null where a class is missing."""
    s = auc(df.where("difficulty = 'standard'"), keys, "standard_auc")
    hard = df.where("difficulty = 'hard'")
    h = auc(hard, keys, "hard_auc")
    y, q = F.col("y") == 1, F.col("pred") == 1
    tp, pos, said = F.count_if(y & q), F.count_if(y), F.count_if(q)
    g = hard.groupBy(*keys).agg((tp / F.when(pos > 0, pos)).alias("hard_recall"), (tp / F.when(said > 0, said)).alias("hard_precision_true"))
    h = h.join(g, keys).select(*keys, "hard_auc", *(F.when(F.col("hard_auc").isNotNull(), F.col(c)).alias(o) for c, o in (("hard_recall", "hard_precision"), ("hard_recall", "hard_recall"), ("hard_precision_true", "hard_precision_true"))))
    return s.join(h, keys, "full")


def overfit_risk(metric: DataFrame, standard: str = "dev", hard: str = "dev_hard") -> DataFrame:
    """(model, gap, risk) from the F1 of the standard and the hard split."""
    a = metric.where(F.col("split") == standard).select("model", F.col("f1").alias("a"))
    b = metric.where(F.col("split") == hard).select("model", F.col("f1").alias("b"))
    gap = F.col("a") - F.col("b")
    return a.join(b, "model").select("model", gap.alias("gap"), F.when(gap > 0.2, "high").when(gap > 0.1, "medium").otherwise("low").alias("risk"))


def best_model(metric: DataFrame, order: tuple[str, ...] = ("gbdt", "rf", "lr"), hard: str = "dev_hard", standard: str = "dev") -> DataFrame:
    """The model with the best F1 on the hard split if there is one, else on the standard split; of equal ones the first."""
    rank = F.array_position(F.array(*(F.lit(m) for m in order)), F.col("model"))
    pick = metric.where(F.col("split").isin(hard, standard)).withColumn("is_hard", (F.col("split") == hard).cast("int"))
    top = pick.agg(F.max("is_hard").alias("m"))
    return pick.join(F.broadcast(top)).where("is_hard = m").orderBy(F.desc("f1"), rank).limit(1).select("model", "split", "f1")  # one row


def summary_line() -> Column:
    return F.format_string("%s %s: F1 %s, precision %s, recall %s, uncertain %s%%", "model", "split", *(fixed(F.col(c), 3) for c in ("f1", "precision", "recall")), fixed(F.col("uncertain_ratio") * 100, 1))


def run(rows: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], splits: tuple[str, ...] = ("dev", "test", "dev_hard", "test_hard")) -> tuple[DataFrame, DataFrame]:
    """(results, risks): every metric of each model on each split, and the risk of overfitting of each model.

    rows: features, label, split, difficulty_level; a scorer adds p and pred. What fails on one split, or for one model, is an error in that row only; a
    split without rows gives none.
    """
    spark = rows.sparkSession
    parts, failed = [], []
    for model, scorer in scorers.items():
        for split in splits:
            try:
                s = scorer(rows.where(F.col("split") == split)).select(F.lit(model).alias("model"), "split", F.col("difficulty_level").alias("difficulty"), F.col("label").cast("int").alias("y"), "p", "pred")
                keys = ["model", "split"]
                one = metrics(s, keys).join(auc(s, keys), keys, "left").join(by_difficulty(s, keys), keys, "left")
                parts.append(spark.createDataFrame(one.collect(), one.schema))  # one row
            except Exception as e:
                failed.append((model, split, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]))
    errors = spark.createDataFrame(failed, "model string, split string, error string")
    if not parts:
        return errors, spark.createDataFrame([], "model string, gap double, risk string")
    results = reduce(DataFrame.unionByName, parts).withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
    return results, overfit_risk(results.where("error IS NULL"))


def summary_text() -> Column:
    """The lines on one model and split in the summary of an evaluation; figures that there are none of are left out."""
    line = lambda name, c, digits=3, k=1, unit="": F.when(F.col(c).isNotNull(), F.concat(F.lit(f"    {name}: "), fixed(F.col(c) * k, digits), F.lit(unit)))
    return F.concat_ws("\n", F.concat(F.lit("  "), F.col("split"), F.lit(":")), line("F1", "f1"), line("Precision", "precision"), line("Recall", "recall"), line("AUC", "auc"), line("Hard AUC", "hard_auc"), line("Uncertain Ratio", "uncertain_ratio", 1, 100, "%"), F.lit(""))
