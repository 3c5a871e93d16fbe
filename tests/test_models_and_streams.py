import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_features import event, iso
from weirflow.ml import classifiers, isolation
from weirflow.ml.scaling import fit_scaler
from weirflow.operators import context
from weirflow.operators.sweep import BySource
from weirflow.sources import eve
from weirflow.streaming import events as streams


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        y = int(i % 3 == 0)
        rows.append((i, rng.gauss(2 * y, 1), rng.gauss(-y, 1), 7.0, y, ["dos", "scan", "bot"][i % 3]))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, kind string").persist()


def test_scaler_uses_population_deviation(points):
    s = fit_scaler(points, ("a", "c"))
    r = s.scaled(points).agg(F.stddev_pop("a").alias("d"), F.avg("a").alias("m"), F.max("c").alias("c")).first()
    assert r.d == pytest.approx(1) and r.m == pytest.approx(0) and r.c == 0.0


def test_isolation_forest_finds_the_far_ones(points):
    forest = isolation.fit_forest(points, ("a", "b"), "id", trees=40)
    assert forest.decision(np.array([[9.0, 9.0]]))[0] < forest.decision(np.array([[0.5, -0.3]]))[0]
    scored = forest.scored(points)
    share = scored.where("if_raw < 0").count() / 600
    assert 0.05 < share < 0.2 and scored.columns == [*points.columns, "if_raw"]
    assert isolation.path_length(2) == 1.0 and isolation.path_length(256) == pytest.approx(10.2448, abs=1e-3)


def test_classifiers(spark, points, tmp_path):
    model = classifiers.random_forest(points, ("a", "b"), "y", trees=10, depth=4)
    scored = classifiers.probability(model, points)
    assert scored.columns == [*points.columns, "probability"]
    from weirflow.operators.aggregates import roc_auc

    assert roc_auc(scored, "y", "probability").first()[0] > 0.85
    classifiers.save(model, str(tmp_path / "m"), {"feature_names": ["a", "b"]})
    again, config = classifiers.load(spark, str(tmp_path / "m"))
    assert config == {"feature_names": ["a", "b"]} and again.transform(points).count() == 600
    with pytest.raises(ValueError):
        classifiers.save(model, str(tmp_path / "n"), {})
    multi, names = classifiers.multiclass(points, ("a", "b"), "kind", trees=5, depth=3)
    assert names == ("bot", "dos", "scan")
    out = classifiers.second_stage(multi, names, scored, "probability")
    assert out.where("probability < 0.7 and attack_type <> 'unknown'").count() == 0
    assert {r.attack_type for r in out.where("probability >= 0.7").collect()} <= set(names)


def test_audit(points):
    fit = lambda train, names: classifiers.random_forest(train, names, "y", trees=5, depth=3)
    measures = classifiers.audit(points, ("a", "b", "c"), "y", "id", fit, folds=3, noise=(0.1,))
    assert len(measures["folds"]) == 3 and min(measures["folds"]) > 0.75 and 0.3 < measures["shuffled_labels"] < 0.7
    assert classifiers.verdict({"folds": [0.95], "shuffled_labels": 0.8}) == "leakage" and classifiers.verdict({"folds": [0.95]}) == "pass"


def lines(n=120):
    rng = random.Random(4)
    t, out = 1_700_000_000_000_000, []
    for i in range(n):
        t += rng.choice([0, 500_000, 2_000_000, 30_000_000])
        out.append(event(i, iso(t), f"10.0.0.{rng.randint(1, 3)}", f"10.1.0.{rng.randint(1, 4)}", rng.choice([22, 80]), 1, 100, 50, {"syn": True}))
    out.append(event(n, iso(t + 3_600_000_000), "10.9.9.9", "10.9.9.8", 1, 0, 0, 0, None))  # moves the watermark past all others
    return out


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    all_lines = lines()
    for k in range(4):
        (folder / f"{k}.json").write_text("\n".join(all_lines[k * 35 : (k + 1) * 35]) + "\n")
        os.utime(folder / f"{k}.json", (1_600_000_000 + k, 1_600_000_000 + k))  # files are taken by their times
    names = ["seq", "ts_us", "src_ip", "dst_ip", "dst_port", "total_bytes", "duration"]
    live = streams.with_event_time(eve.to_flows(streams.read_stream(spark, str(folder), ("flow",), 1)), "5 seconds").select(*names, "event_time")
    schema = "seq long, ts_us long, src_ip string, dst_ip string, dst_port long, total_bytes long, duration double, event_time timestamp, " + ", ".join(f"{n} double" for n in BySource.names)
    q = streams.start(streams.swept_stream(live, BySource, schema), str(tmp_path / "out"), str(tmp_path / "cp"), "parquet")
    assert q.awaitTermination(240)
    got = {r.seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = streams_batch(spark, folder, names)
    want = batch_sweep(rows)
    assert len(got) == len(all_lines) - 1
    for seq, values in want.items():
        if seq in got:
            assert tuple(got[seq][n] for n in BySource.names) == pytest.approx(values)


def streams_batch(spark, folder, names):
    text = spark.read.text(str(folder)).select("value", F.xxhash64("value", "_metadata.file_path").alias("seq"))
    return eve.to_flows(eve.parsed(text, ("flow",))).select(*names)


def batch_sweep(rows):
    data = rows.toPandas().sort_values(["src_ip", "ts_us", "seq"])
    out = BySource()(data)
    return {int(r.seq): tuple(float(getattr(r, n)) for n in BySource.names) for r in out.itertuples()}


def test_dedupe_tumbling_and_blocks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    body = lines(40)
    (folder / "0.json").write_text("\n".join(body + body[:5]) + "\n")
    (folder / "1.json").write_text(json.dumps({"event_type": "dns"}) + "\n" + body[3] + "\n")
    live = streams.with_event_time(eve.to_flows(streams.read_stream(spark, str(folder), ("flow",), 1)), "2 hours")
    q = streams.start(streams.first_of_id(live).select("flow_id", "ts_us"), str(tmp_path / "ids"), str(tmp_path / "cp1"))
    assert q.awaitTermination(120)
    ids = [r.flow_id for r in spark.read.json(str(tmp_path / "ids")).collect()]
    assert len(ids) == len(set(ids)) == 41
    quick = streams.with_event_time(eve.to_flows(streams.read_stream(spark, str(folder), ("flow",))), "1 second")
    q = streams.start(streams.tumbling(quick, 60, "src_ip"), str(tmp_path / "sums"), str(tmp_path / "cp2"))
    assert q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "sums")).agg(F.sum("n")).first()[0] >= 40
    blocked = live.withColumn("action", F.lit("BLOCK"))
    q = streams.keep_blocks(blocked, str(tmp_path / "blocks"), str(tmp_path / "cp3"), context.BlockLimits(ttl=0, most=10, per_minute=0))
    assert q.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "blocks").iterdir() if "=" in p.name)
    assert {r.src_ip for r in spark.read.parquet(str(tmp_path / f"blocks/version={last}")).where("end = 'in force'").collect()} == {"10.0.0.1", "10.0.0.2", "10.0.0.3", "10.9.9.9"}
