"""Classifiers on feature vectors: the three standard models and the five fusion trees, exported as plain expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.operators import evaluation
from scriptorium.runtime import cut

SEED = 42
#: Features kept and depth of each fusion tree (fixed values, from the names of the models).
TREES = {"select5_tree_d2": (5, 2), "select10_tree_d2": (10, 2), "select15_tree_d3": (15, 3), "select20_tree_d2": (20, 2), "bert_tree_d1": (None, 1)}


def with_vector(df: DataFrame, array_col: str = "features") -> DataFrame:
    return df.withColumn("vec", array_to_vector(F.col(array_col).cast("array<double>"))).withColumn("label", F.col("label").cast("double"))


def models(n: int) -> dict:
    """Boosted trees, a forest, and a logistic regression with the usual penalty of 1."""
    return {
        "gbdt": GBTClassifier(featuresCol="vec", maxIter=100, maxDepth=5, stepSize=0.1, seed=SEED),
        "rf": RandomForestClassifier(featuresCol="vec", numTrees=100, maxDepth=10, seed=SEED),
        "lr": LogisticRegression(featuresCol="vec", maxIter=1000, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False),
    }


def fit(train: DataFrame, name: str, **overrides):
    t = with_vector(train)
    est = models(t.count())[name]
    return est.copy({est.getParam(k): v for k, v in overrides.items()}).fit(t)


def score(model, df: DataFrame) -> DataFrame:
    """The input with p and pred."""
    d = model.transform(with_vector(df))
    return d.withColumn("p", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int")).drop("vec", "rawPrediction", "probability", "prediction")


def fit_tree(train: DataFrame, name: str):
    """One fusion tree behind its selector of features."""
    keep, depth = TREES[name]
    t = with_vector(train)
    tree = DecisionTreeClassifier(featuresCol="sel" if keep else "vec", maxDepth=depth, seed=SEED)
    stages = [tree]
    if keep:
        sel = UnivariateFeatureSelector(featuresCol="vec", outputCol="sel", labelCol="label", selectionMode="numTopFeatures")
        sel = sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(keep)
        stages = [sel, tree]
    return Pipeline(stages=stages).fit(t)


def tree_spec(pipeline) -> dict:
    """A fitted tree as nested dicts over the positions of the whole vector."""
    sel = pipeline.stages[0].selectedFeatures if len(pipeline.stages) > 1 else None
    root = pipeline.stages[-1]._java_obj.rootNode()

    def walk(n) -> dict:
        if n.subtreeDepth() == 0:
            s = list(n.impurityStats().stats())
            return {"p": s[1] / sum(s) if len(s) > 1 and sum(s) else 0.0}
        split = n.split()
        i = split.featureIndex()
        return {"feature": sel[i] if sel else i, "threshold": split.threshold(), "left": walk(n.leftChild()), "right": walk(n.rightChild())}

    return walk(root)


def tree_column(spec: dict, vector: Column) -> Column:
    """A tree as an expression: scoring then needs no model and no Python."""
    if "p" in spec:
        return F.lit(float(spec["p"]))
    return F.when(F.get(vector, F.lit(spec["feature"])) <= spec["threshold"], tree_column(spec["left"], vector)).otherwise(tree_column(spec["right"], vector))


def score_trees(df: DataFrame, specs: dict[str, dict], array_col: str = "features") -> DataFrame:
    for m in P.MODELS:
        df = df.withColumn(m, tree_column(specs[m], F.col(array_col)))
    return df


def spec_of(pipeline, feature_dim: int, use_embedding: bool) -> dict:
    """What a fitted fusion tree is saved as: the tree over the whole vector, the positions its selector kept, and what it reads."""
    keep = [int(i) for i in pipeline.stages[0].selectedFeatures] if len(pipeline.stages) > 1 else None
    return {"tree": tree_spec(pipeline), "selected": keep, "feature_dim": feature_dim, "use_embedding": use_embedding, "has_selector": keep is not None}


BUNDLE = "model string, tree string, selected array<int>, feature_dim int, use_embedding boolean, has_selector boolean"


def save_specs(spark, specs: dict[str, dict], path: str) -> None:
    """Trees, with or without what goes with them, one row a model."""
    full = {k: v if "tree" in v else {"tree": v, "selected": None, "feature_dim": 0, "use_embedding": k.startswith("bert"), "has_selector": False} for k, v in specs.items()}
    rows = [(k, json.dumps(v["tree"]), v["selected"], v["feature_dim"], v["use_embedding"], v["has_selector"]) for k, v in full.items()]
    spark.createDataFrame(rows, BUNDLE).coalesce(1).write.mode("overwrite").json(path)


def load_bundle(spark, path: str) -> dict[str, dict]:
    """The five models of a folder, each with its tree, selector and metadata; a missing folder or model is an error. At most one row a model."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no folder of models: {path}")
    rows = {r["model"]: r for r in spark.read.schema(BUNDLE).json(path).collect()}
    missing = [m for m in P.MODELS if m not in rows or rows[m]["tree"] is None]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    return {m: {"tree": json.loads(rows[m]["tree"]), "selected": rows[m]["selected"], "feature_dim": rows[m]["feature_dim"] or 0, "use_embedding": bool(rows[m]["use_embedding"]), "has_selector": bool(rows[m]["has_selector"])} for m in P.MODELS}


def load_specs(spark, path: str) -> dict[str, dict]:
    return {m: b["tree"] for m, b in load_bundle(spark, path).items()}


def train_time_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, precision, recall, f1, auc, hard_auc): what training reports of a split; hard_auc is null unless its hard rows are of both classes."""
    m = evaluation.metrics(scored, keys).select(*keys, "precision", "recall", "f1")
    return m.join(evaluation.auc(scored, keys), keys, "left").join(evaluation.auc(scored.where("difficulty = 'hard'"), keys, "hard_auc"), keys, "left")


def train(rows: DataFrame, names: tuple[str, ...] = ("gbdt", "rf", "lr"), split: str = "train", check: tuple[str, ...] = ("dev", "dev_hard"), **overrides) -> tuple[dict, DataFrame, str | None]:
    """Fitted models, their metrics on the checked splits, and the name of the best one: by F1 on the hard split where it has rows, else on the standard one.

    rows: features, label, split, difficulty_level. A model that can't be fitted is left out and named in the error column of the metrics.
    """
    data = rows.where(F.col("split") == split)
    held = rows.where(F.col("split").isin(*check))
    fitted, parts, failed = {}, [], []
    for name in names:
        try:
            fitted[name] = fit(data, name, **{k: v for k, v in overrides.items() if k in FITS.get(name, ())})
        except Exception as e:
            failed.append((name, f"{type(e).__name__}: {e}"[:200]))
            continue
        s = score(fitted[name], held)
        parts.append(train_time_metrics(s.select(F.lit(name).alias("model"), "split", F.col("difficulty_level").alias("difficulty"), F.col("label").cast("int").alias("y"), "p", "pred"), ["model", "split"]))
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "model string, split string, precision double, recall double, f1 double, auc double, hard_auc double")
    metrics = reduce(DataFrame.unionByName, parts, empty).withColumn("error", F.lit(None).cast("string"))
    if failed:
        metrics = metrics.unionByName(spark.createDataFrame(failed, "model string, error string"), allowMissingColumns=True)
    metrics = cut(metrics, "training_results")  # a row a model and split
    best = evaluation.best_model(metrics.where("f1 > 0"), order=names).first()
    return fitted, metrics, best["model"] if best else None


#: Settings of each model that a run may override.
FITS = {"gbdt": ("maxIter", "maxDepth", "stepSize"), "rf": ("numTrees", "maxDepth"), "lr": ("maxIter", "regParam")}


def save_training(fitted: dict, metrics: DataFrame, best: str | None, path: str) -> None:
    """Models, training_results and the name of the best model under one path."""
    for name, model in fitted.items():
        model.write().overwrite().save(f"{path}/{name}_model")
    metrics.withColumn("best", F.col("model").eqNullSafe(F.lit(best))).coalesce(1).write.mode("overwrite").json(f"{path}/training_results")


def load_model(path: str, name: str):
    """A saved model of `save_training`."""
    kind = {"gbdt": GBTClassificationModel, "rf": RandomForestClassificationModel, "lr": LogisticRegressionModel}[name]
    return kind.load(f"{path}/{name}_model")
