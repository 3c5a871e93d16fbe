"""Classifiers of flows with Spark's own tree ensembles, and checks of their data."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import aggregates
from weirflow.operators.joins import small


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with weight: rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weights = sizes.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return df.join(small(weights), label)


def _vectors(names: tuple[str, ...]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="_features", handleInvalid="keep")


def random_forest(df: DataFrame, names: tuple[str, ...], label: str, trees: int = 100, depth: int = 12, seed: int = 42) -> PipelineModel:
    """A forest with classes weighted by their sizes; label is 0/1 or an index."""
    model = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_vectors(names), model]).fit(balanced(df, label))


def boosted(df: DataFrame, names: tuple[str, ...], label: str, rounds: int = 400, rate: float = 0.05, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Boosted trees for 0/1 labels."""
    model = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_vectors(names), model]).fit(df)


def multiclass(df: DataFrame, names: tuple[str, ...], label: str, trees: int = 100, depth: int = 12, seed: int = 42) -> tuple[PipelineModel, tuple[str, ...]]:
    """A forest over named classes, and the names in the order of its probabilities."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    assert isinstance(index, StringIndexerModel)
    return random_forest(index.transform(df), names, "_label", trees, depth, seed), tuple(index.labels)


def _transformed(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the model's probabilities as the array _p; df's own columns stay, also those named like the model's."""
    clash = [c for c in ("rawPrediction", "probability", "prediction", "_features") if c in df.columns]
    aside = df.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    out = model.transform(aside).withColumn("_p", vector_to_array("probability"))
    return out.select(*[F.col(f"_own_{c}").alias(c) if c in clash else F.col(c) for c in df.columns], "_p")


def probability(model: PipelineModel, df: DataFrame, name: str = "probability", of: int = 1) -> DataFrame:
    """df with the probability of a class."""
    out = _transformed(model, df)
    return out.select(*[c for c in df.columns if c != name], F.col("_p")[of].alias(name))


def second_stage(model: PipelineModel, classes: tuple[str, ...], df: DataFrame, first: str, floor: float = 0.70) -> DataFrame:
    """df with attack_type and attack_confidence, unknown and 0 where the first stage's probability is below the floor."""
    out = _transformed(model, df)
    best = F.array_max("_p")
    named = F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("_p", best).cast("int") - 1)
    hit = F.col(first) >= floor
    return out.select(*df.columns, F.when(hit, named).otherwise("unknown").alias("attack_type"), F.when(hit, best).otherwise(0.0).alias("attack_confidence"))


def save(model: PipelineModel, path: str, config: dict) -> None:
    """A model with its settings (feature_names at least), in one folder."""
    if "feature_names" not in config:
        raise ValueError("a model's settings need feature_names")
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A model and its settings; a missing part is an error, never a stand-in."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    return PipelineModel.load(f"{path}/model"), config


def audit(df: DataFrame, names: tuple[str, ...], label: str, key: str, fit, seed: int = 42, folds: int = 5, noise: tuple[float, ...] = (0.1, 0.5)) -> dict:
    """Area under the curve across folds, on shuffled labels, under noise and without the strongest columns; fit(train, names) gives a model."""
    from weirflow.operators.sampling import folds as dealt

    rows = dealt(df, key, folds, seed=seed)
    auc = lambda model, data: float(aggregates.roc_auc(probability(model, data, "_score"), label, "_score").first()[0] or 0.0)
    out: dict = {"folds": []}
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if train.select(label).distinct().count() == 2 and test.select(label).distinct().count() == 2:
            out["folds"].append(auc(fit(train, names), test))
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    mixed = train.withColumn(label, (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2))).cast("int"))
    out["shuffled_labels"] = auc(fit(mixed, names), test)
    model = fit(train, names)
    spread = {r.feature: r.deviation or 0.0 for r in aggregates.feature_health(train, names).collect()}
    for level in noise:
        shaken = test.withColumns({n: F.col(n) + F.randn(seed + i) * level * spread.get(n, 0.0) for i, n in enumerate(names)})
        out[f"noise_{level}"] = auc(model, shaken)
    strongest = model.stages[-1].featureImportances.toArray().argsort()[::-1][:5]
    rest = tuple(n for i, n in enumerate(names) if i not in set(strongest.tolist()))
    if rest:
        out["without_strongest"] = auc(fit(train, rest), test)
    return out


def verdict(measures: dict, least: float = 0.9, chance: float = 0.6) -> str:
    """pass, or what speaks against the model: weak folds, or labels that can be learned though they are shuffled."""
    against = []
    if measures.get("folds") and min(measures["folds"]) < least:
        against.append("weak")
    if measures.get("shuffled_labels", 0.5) > chance:
        against.append("leakage")
    return ",".join(against) or "pass"
