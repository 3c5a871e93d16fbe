import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_models_and_streams import lines
from weirflow.operators import context, features
from weirflow.sources import eve
from weirflow.streaming import carried, tail
from weirflow.streaming import events as streams

SECOND = 1_000_000
RULES = context.Rules(window=60, suspicious=0.5, least_events=2, ddos_window=20, ddos_flows=3, ddos_sources=2, fanout_window=60, fanout_ports=2, burst_window=20, burst_flows=3, scan_window=30, scan_ports=2, sweep_window=60, sweep_hosts=3, slow_window=90, slow_ports=2)


@pytest.fixture
def folder(tmp_path):
    """Four files in the order of their times; the second holds a row that is much too late."""
    path = tmp_path / "in"
    path.mkdir()
    body = lines()
    late = body[0].replace('"flow_id": 0', '"flow_id": 777')
    parts = [body[:30], body[30:60] , [late, *body[60:90]], body[90:]]
    for k, part in enumerate(parts):
        (path / f"{k}.json").write_text("\n".join(part) + "\n")
        os.utime(path / f"{k}.json", (1_600_000_000 + k, 1_600_000_000 + k))
    return path


def table(spark, path):
    return spark.read.parquet(str(path)).drop("version")


def test_features_of_a_stream_are_those_of_a_batch(spark, folder, tmp_path):
    live = eve.to_flows(streams.read_stream(spark, str(folder), ("flow",), 1))
    q = carried.feature_stream(live, str(tmp_path / "out"), str(tmp_path / "cp"), 5 * SECOND)
    assert q.awaitTermination(400)
    got = {r.flow_id: r for r in table(spark, tmp_path / "out/rows").collect()}
    assert [r.flow_id for r in table(spark, tmp_path / "out/late").collect()] == ["777"]
    whole = spark.createDataFrame([(k, x) for k, x in enumerate(lines())], "seq long, value string")
    want = {r.flow_id: r for r in features.features(eve.to_flows(eve.parsed(whole))).collect()}
    # The last row, an hour ahead, still waits.
    assert set(got) == set(want) - {"120"}
    for k, r in got.items():
        assert tuple(r[n] for n in features.NAMES) == pytest.approx(tuple(want[k][n] for n in features.NAMES)), k
    assert len(os.listdir(tmp_path / "out/state")) <= 2


def scored(flows):
    n = F.substring("flow_id", 1, 9).cast("long")
    p = F.pmod(n * 37, F.lit(10)) / 10
    return flows.select(n.alias("seq"), "ts_us", "src_ip", "dst_ip", "dst_port", p.alias("risk"), F.when(p > 0.7, "HIGH").otherwise("LOW").alias("decision"))


def test_context_of_a_stream_is_that_of_a_batch(spark, folder, tmp_path):
    live = scored(eve.to_flows(streams.read_stream(spark, str(folder), ("flow",), 1)))
    q = carried.context_stream(live, str(tmp_path / "out"), str(tmp_path / "cp"), RULES, ttl_us=10**15, delay_us=5 * SECOND)
    assert q.awaitTermination(600)
    whole = spark.createDataFrame([(k, x) for k, x in enumerate(lines()[:-1])], "seq long, value string")
    rows = scored(eve.to_flows(eve.parsed(whole)))
    want = {r.seq: (r.context_decision, sorted(r.reasons)) for r in context.escalated(rows, RULES).collect()}
    got = {r.seq: (r.context_decision, sorted(r.reasons)) for r in table(spark, tmp_path / "out/rows").collect()}
    assert got == want and {"HIGH", "LOW"} <= {d for d, _ in got.values()}
    key = lambda r: (r.event_type, r.key, r.ts_us, r.seq, r.observed)
    assert sorted(map(key, table(spark, tmp_path / "out/events").collect())) == sorted(map(key, context.events(rows, RULES).collect()))


def test_quiet_keys_are_forgotten(spark, tmp_path):
    sticky = spark.createDataFrame([("a", "x", (5, 1, 9), 5), ("a", "y", (5, 2, 9), 900 * SECOND)], "event_type string, key string, since struct<ts_us: long, seq: long, observed: long>, seen long")
    sticky.write.parquet(str(tmp_path / "sticky/version=0"))
    rows = spark.createDataFrame([("z", "y", 950 * SECOND)], "src_ip string, dst_ip string, ts_us long")
    hits = spark.createDataFrame([("a", "x", 990 * SECOND, 7, 4), ("a", "y", 990 * SECOND, 8, 4)], "event_type string, key string, ts_us long, seq long, observed long")
    now, new = carried._sticky(carried.Batch(rows, 1_000 * SECOND, 1, str(tmp_path)), hits, rows, 60 * SECOND)
    assert [(r.key, r.seen) for r in now.collect()] == [("y", 950 * SECOND)] and new.count() == 0


def test_a_growing_log_is_followed_over_rotations(spark, tmp_path):
    log, body = tmp_path / "eve.json", [json.dumps({"event_type": "flow", "flow_id": f"r{k}"}) for k in range(9)]
    log.write_text("\n".join(body[:3]) + "\n" + body[3][:10])  # the last line is not whole yet
    run = lambda: streams.start(tail.read_tail(spark, str(log)).select("event.flow_id", "seq"), str(tmp_path / "out"), str(tmp_path / "cp"))
    seen = lambda: sorted(r.flow_id for r in spark.read.json(str(tmp_path / "out")).collect())
    assert run().awaitTermination(200)
    assert seen() == ["r0", "r1", "r2"]
    with open(log, "a") as f:
        f.write(body[3][10:] + "\n" + body[4] + "\n")
    os.rename(log, tmp_path / "eve.json.1")
    log.write_text("\n".join(body[5:]) + "\n")
    assert run().awaitTermination(200)
    assert seen() == [f"r{k}" for k in range(9)]
    reader = tail.TailReader(str(tmp_path / "eve.json.1"), "end")
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    whole = tail.Range(str(tmp_path / "eve.json.1"), 0, os.path.getsize(tmp_path / "eve.json.1"))
    cut = [tail.Range(whole.path, a, min(a + 7, whole.end)) for a in range(0, whole.end, 7)]
    assert [x for p in cut for x in reader.read(p)] == list(reader.read(whole))
