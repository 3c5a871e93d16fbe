import json
import random

import pytest

from tests.simulation import bounded, simulate
from weirflow.operators.features import FEATURES, NAMES, features
from weirflow.sources import eve


def event(i, at, src, dst, dport, age, fwd, rev, tcp):
    body = {"timestamp": at, "event_type": "flow", "flow_id": i, "src_ip": src, "src_port": 1000 + i, "dest_ip": dst, "dest_port": dport, "proto": "tcp", "flow": {"start": at, "age": age, "bytes_toserver": fwd, "bytes_toclient": rev}}
    if tcp is not None:
        body["tcp"] = tcp
    return json.dumps(body)


def iso(us):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(us / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f") + "+0000"


@pytest.fixture(scope="module")
def flows(spark):
    rng = random.Random(5)
    lines, t = [], 1_700_000_000_000_000
    for i in range(260):
        t += rng.choice([0, 0, 250_000, 1_000_000, 3_000_000, 20_000_000, 60_000_000, 60_000_001])
        flags = rng.choice([None, {}, {"syn": True}, {"syn": True, "ack": True}, {"rst": 1, "ack": True}, {"syn": "true", "fin": []}])
        lines.append(event(i, iso(t), f"10.0.0.{rng.randint(1, 3)}", f"10.1.0.{rng.randint(1, 4)}", rng.choice([22, 53, 80]), rng.choice([0, 0.2, 0.5, 5, 30, 130]), rng.choice([0, 60, 100, 300]), rng.choice([0, 40, 200]), flags))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, value string")
    return eve.to_flows(eve.parsed(df))


def test_all_features_match_a_simulation(flows):
    rows = [r.asDict() for r in flows.orderBy("ts_us", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "seq").collect()]
    assert len(rows) == 260
    want = simulate(rows)
    got = {r.seq: r for r in features(flows).collect()}
    bounds = dict(FEATURES)
    assert list(NAMES) == list(want[0])
    for row, w in zip(rows, want):
        for name in NAMES:
            assert got[row["seq"]][name] == pytest.approx(bounded(name, w[name], bounds), abs=1e-9, rel=1e-9), (row["seq"], name)


def test_truth_of_flags_follows_json_types(spark):
    cases = [({}, 0), ({"syn": False}, 0), ({"syn": "false"}, 1), ({"syn": "0"}, 1), ({"syn": 0}, 0), ({"syn": ""}, 0), ({"syn": [0]}, 1), ({"syn": []}, 0), ({"syn": None}, 0), ({"syn": {"a": 1}}, 1)]
    df = spark.createDataFrame([(i, event(i, iso(0), "a", "b", 1, 0, 0, 0, c)) for i, (c, _) in enumerate(cases)], "seq long, value string")
    got = {r.seq: r for r in eve.to_flows(eve.parsed(df)).collect()}
    assert [got[i].syn for i in range(len(cases))] == [w for _, w in cases]
    assert all(got[i].has_tcp == 1 for i in got) and all(got[i].tcp_pkts == 1 for i in got)


@pytest.mark.parametrize("slice_us", [1, 900_000_000])
def test_hot_keys_in_slices_of_time_have_the_same_features(flows, slice_us):
    """Every source and destination is hot here, and rows lie on both sides of many slices."""
    whole, cut = ({r.seq: r for r in x.collect()} for x in (features(flows), features(flows, 20, slice_us)))
    assert len(cut) == len(whole) == 260
    assert all(tuple(cut[k][n] for n in NAMES) == pytest.approx(tuple(whole[k][n] for n in NAMES)) for k in whole)


def test_flows_of_one_time_are_taken_by_flow_id(spark):
    """Not in the order of lines: ties go by id as text, then by endpoints."""
    lines = [event(i, iso(0), "a", "b", 80, 0, 0, 0, None) for i in (7, 30, 4, 12)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "seq long, value string")
    got = {r.flow_id: r.flow_rate_src_10s for r in features(eve.to_flows(eve.parsed(df))).collect()}
    assert got == {"12": 0.0, "30": 0.1, "4": 0.2, "7": 0.3}
