import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_features import event, iso
from weirflow.ml import bundle as bundles
from weirflow.ml import classifiers, isolation
from weirflow.ml.scaling import fit_scaler
from weirflow.operators import features
from weirflow.operators.context import Rules
from weirflow.plans.pipelines import ScoreOptions, flow_features
from weirflow.sources import eve

NAMES = ("flow_rate_src_10s", "bytes_ratio_fwd_rev", "has_tcp")


@pytest.fixture(scope="module")
def events(spark):
    lines = [event(k, iso(1_700_000_000_000_000 + k * 400_000), f"10.0.0.{k % 4}", "10.1.0.1", 80 + k % 3, 1, 900 if k % 4 == 0 else 10, 5, {"syn": True} if k % 4 == 0 else None) for k in range(240)]
    return eve.parsed(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))


@pytest.fixture(scope="module")
def made(events):
    rows = flow_features(events).withColumn("y", (F.col("src_ip") == "10.0.0.0").cast("int")).withColumn("kind", F.concat(F.lit("k"), F.col("dst_port").cast("string"))).cache()
    first = classifiers.random_forest(rows, NAMES, "y", trees=8, depth=4)
    second, classes = classifiers.multiclass(rows, NAMES, "kind", trees=5, depth=3)
    scaler = fit_scaler(rows, features.NAMES)
    forest = isolation.fit_forest(scaler.scaled(rows), NAMES, "seq", trees=10, sample=64)
    return rows, bundles.Bundle(first, NAMES, second, NAMES, classes, forest, scaler)


def test_a_bundle_scores_the_same_after_it_was_saved(spark, events, made, tmp_path):
    rows, bundle = made
    bundles.save(bundle, str(tmp_path / "b"))
    again = bundles.load(spark, str(tmp_path / "b"))
    columns = ("probability", "anomaly", "attack_type", "attack_confidence", "risk", "decision", "action")
    a, b = ({r.seq: tuple(r[c] for c in columns) for r in bundles.scored_events(events, x).collect()} for x in (bundle, again))
    assert a == b and len(a) == 240
    assert {v[5] for v in a.values()} == {"HIGH", "LOW"} and all((v[4] >= 0.7) == (v[5] == "HIGH") or v[1] >= 0.8 for v in a.values())
    assert all((v[2] == "unknown") == (v[0] < 0.7) for v in a.values())
    # The anomaly by hand.
    x = np.array([[getattr(r, n) for n in NAMES] for r in bundle.scaler.scaled(rows).orderBy("seq").collect()])
    want = 1 / (1 + np.exp(-np.clip(-bundle.forest.decision(x), -50, 50)))
    assert [a[k][1] for k in sorted(a)] == pytest.approx(want.tolist())
    assert bundles.scored_events(events, again, options=ScoreOptions(rules=Rules())).count() == 240
    older = bundles.blended_events(bundles.with_scores(rows, again)).collect()
    assert all(r.decision == "HIGH" for r in older if r.probability >= 0.7) and {r.action for r in older} <= {"BLOCK", "ALERT", "ALLOW"}


def test_parts_that_are_missing_are_errors(spark, made, tmp_path):
    rows, whole = made
    for bad in ({"first_names": ("no_such",)}, {"scaler": None}, {"classes": ()}):
        with pytest.raises(ValueError):
            bundles.Bundle(**{**whole.__dict__, **bad})
    plain = bundles.Bundle(whole.first, NAMES)
    bundles.save(plain, str(tmp_path / "b"))
    again = bundles.load(spark, str(tmp_path / "b"))
    r = bundles.with_scores(rows, again).first()
    assert (r.anomaly, r.if_raw, r.attack_type) == (0.0, None, "unknown")
    with pytest.raises(Exception):
        bundles.load(spark, str(tmp_path / "none"))
    table = rows.select(F.col("src_ip").alias("Source IP"), F.col("dst_port").alias("Dst Port"), *NAMES).limit(5)
    assert bundles.scored_table(table, again).count() == 5
    assert json.loads(bundles.forest_json(whole.forest))["names"] == list(NAMES)


def test_families_need_rows_enough(made):
    rows, _ = made
    table = rows.withColumn("binary_label", F.lit(1)).withColumn("attack_subclass", F.when(F.col("y") == 1, "DDoS-x").when(F.col("seq") % 7 == 0, "odd").otherwise("PortScan"))
    with pytest.raises(ValueError, match="fewer than 1000"):
        bundles.family_classifier(table, NAMES)
    _, classes, held = bundles.family_classifier(table, NAMES, least=100, trees=8, depth=4)
    got = held.collect()
    assert classes == ("DDoS", "Recon") and got and sum(r.family == r.predicted for r in got) >= 0.9 * len(got)


def test_boosted_trees_tell_classes_apart(made):
    rows, _ = made
    model = classifiers.boosted(rows, NAMES, "y", rounds=5, depth=3)
    got = classifiers.probability(model, rows, "p").select("y", "p").collect()
    assert min(r.p for r in got if r.y) > max(r.p for r in got if not r.y)
