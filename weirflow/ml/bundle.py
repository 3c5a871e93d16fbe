"""A bundle of all that scoring needs, in one folder, and the path from events to decisions through it."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import coerce, decisions
from weirflow.ml import classifiers
from weirflow.ml.isolation import Forest, Tree
from weirflow.ml.scaling import Scaler
from weirflow.operators import features
from weirflow.plans.pipelines import FlowOptions, ScoreOptions, decided, flow_features
from weirflow.sources import eve

#: Mapped attack rows without which no classifier of families is fitted.
LEAST_ATTACKS = 1000


@dataclass(frozen=True)
class Bundle:
    """A first stage, and if there: a second one with its classes, a forest with its scaler, a forest of probabilities over scaled columns."""

    first: PipelineModel
    first_names: tuple[str, ...]
    second: PipelineModel | None = None
    second_names: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    forest: Forest | None = None
    scaler: Scaler | None = None

    def __post_init__(self) -> None:
        for names in (self.first_names, self.second_names, self.forest.names if self.forest else ()):
            if unknown := [n for n in names if n not in features.NAMES]:
                raise ValueError(f"no such features: {', '.join(unknown)}")
        if self.forest is not None and self.scaler is None:
            raise ValueError("a forest needs its scaler")
        if self.second is not None and not (self.second_names and self.classes):
            raise ValueError("a second stage needs its features and classes")


def forest_json(forest: Forest) -> str:
    trees = [{k: getattr(t, k).tolist() for k in ("column", "cut", "left", "right", "depth")} for t in forest.trees]
    return json.dumps({"names": forest.names, "sample": forest.sample, "offset": forest.offset, "trees": trees})


def forest_of(text: str) -> Forest:
    d = json.loads(text)
    whole = {"column", "left", "right"}
    trees = [Tree(**{k: np.array(v, np.int64 if k in whole else float) for k, v in t.items()}) for t in d["trees"]]
    return Forest(tuple(d["names"]), trees, d["sample"], d["offset"])


def save(bundle: Bundle, path: str) -> None:
    """A bundle in one folder: models by Spark, the rest as one line of JSON each."""
    spark = SparkSession.active()
    classifiers.save(bundle.first, f"{path}/first", {"feature_names": bundle.first_names})
    if bundle.second is not None:
        classifiers.save(bundle.second, f"{path}/second", {"feature_names": bundle.second_names, "classes": bundle.classes})
    parts = {"has_second": bundle.second is not None, "forest": forest_json(bundle.forest) if bundle.forest else None}
    parts["scaler"] = [bundle.scaler.names, bundle.scaler.means, bundle.scaler.deviations] if bundle.scaler else None
    spark.createDataFrame([(json.dumps(parts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parts")


def load(spark: SparkSession, path: str) -> Bundle:
    """A bundle that was saved; a part that is missing is an error, never a stand-in."""
    parts = json.loads(spark.read.text(f"{path}/parts").first()[0])
    first, config = classifiers.load(spark, f"{path}/first")
    second, more = classifiers.load(spark, f"{path}/second") if parts["has_second"] else (None, {"feature_names": [], "classes": []})
    scaler = Scaler(*[tuple(x) for x in parts["scaler"]]) if parts["scaler"] else None
    forest = forest_of(parts["forest"]) if parts["forest"] else None
    return Bundle(first, tuple(config["feature_names"]), second, tuple(more["feature_names"]), tuple(more["classes"]), forest, scaler)


def with_scores(df: DataFrame, bundle: Bundle, second_floor: float = 0.70) -> DataFrame:
    """df (with features) with probability, anomaly, if_raw, attack_type and attack_confidence.

    The first and the second stage read plain features, the forest scaled ones. Without a forest anomaly is 0 and if_raw null; without a second stage the type is unknown.
    """
    plain = df.withColumns({n: F.lit(0.0) for n in features.NAMES if n not in df.columns})
    out = classifiers.probability(bundle.first, plain)
    if bundle.second is not None:
        out = classifiers.second_stage(bundle.second, bundle.classes, out, "probability", second_floor)
    else:
        out = out.withColumns({"attack_type": F.lit("unknown"), "attack_confidence": F.lit(0.0)})
    if bundle.forest is None:
        return out.withColumns({"if_raw": F.lit(None).cast("double"), "anomaly": F.lit(0.0)})
    # The scaled columns stand beside the plain ones only while the forest reads them.
    own = {n: f"scaled_{n}" for n in bundle.forest.names}
    at = {n: (m, d) for n, m, d in zip(bundle.scaler.names, bundle.scaler.means, bundle.scaler.deviations)}
    out = out.withColumns({s: (F.col(n) - F.lit(at[n][0])) / F.lit(at[n][1]) for n, s in own.items()})
    forest = Forest(tuple(own.values()), bundle.forest.trees, bundle.forest.sample, bundle.forest.offset)
    out = forest.scored(out).drop(*own.values())
    return out.withColumn("anomaly", decisions.anomaly_sigmoid(F.col("if_raw")))


def scored_events(events: DataFrame, bundle: Bundle, flows: FlowOptions = FlowOptions(), options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """Decisions on events: flows, features, both stages, the anomaly, and what thresholds and context make of them."""
    rows = with_scores(flow_features(events, flows), bundle, options.thresholds.second_stage)
    return decided(rows, options)


def scored_table(df: DataFrame, bundle: Bundle, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """Decisions on a table of features under any of the usual headers; features that it lacks are 0."""
    return decided(with_scores(features.sane_all(eve.scoring_rows(df, features.NAMES)), bundle, options.thresholds.second_stage), options)


def blended_events(rows: DataFrame, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """The older decision on scored rows: a weighted score, with the hybrid rule where a forest has scored."""
    raw = F.coalesce("if_raw", F.lit(float("inf")))
    score, tier = decisions.blended(F.col("anomaly"), F.col("probability"), None, raw, F.col("probability"), options.thresholds)
    return rows.withColumns({"risk": score, "decision": tier, "action": decisions.action(tier)})


def family_classifier(df: DataFrame, names: tuple[str, ...], custom: dict[str, str] | None = None, least: int = LEAST_ATTACKS, key: str = "identity_key", test: float = 0.2, seed: int = 42, **options) -> tuple[PipelineModel, tuple[str, ...], DataFrame]:
    """A classifier of attack families, its classes, and its predictions (family, predicted) on the held-out part.

    df is a training table: binary_label, attack_subclass, features and key. Rows whose subclass belongs to no family are left out; with fewer than
    least mapped attacks nothing is fitted and an error is raised. A key's rows are all fitted on or all held out.
    """
    from weirflow.operators.sampling import group_split

    rows = df.where("binary_label = 1").withColumn("family", coerce.attack_family(F.col("attack_subclass"), custom)).where("family is not null")
    if (n := rows.count()) < least:
        raise ValueError(f"{n} mapped attacks are fewer than {least}")
    rows = group_split(rows, key, test, seed)
    model, classes = classifiers.multiclass(rows.where("split = 'train'"), names, "family", **options)
    held = rows.where("split = 'test'").withColumn("first", F.lit(1.0))
    out = classifiers.second_stage(model, classes, held, "first")
    return model, classes, out.select(key, "family", F.col("attack_type").alias("predicted"), "attack_confidence")
