import json

import pytest
from pyspark.sql import functions as F

from weirflow.operators import joins, packs, sampling
from weirflow.sources import eve, sinks


def flow(i, at, **more):
    return {"timestamp": at, "event_type": "flow", "flow_id": i, "src_ip": "10.0.0.1", "src_port": 5, "dest_ip": "10.0.0.2", "dest_port": 80, "proto": "tcp", "flow": {"start": at, "age": 1, "bytes_toserver": 10, "bytes_toclient": 5}} | more


@pytest.fixture
def log(tmp_path):
    at = "2017-07-07T17:29:50.639970+0530"
    lines = [json.dumps(flow("dup", at)), json.dumps(flow("dup", at)), json.dumps(flow(12345, at)), "not json", '{"event_type" :"dns"}', '{"event_type":  "http", "timestamp": "2017-07-07T10:00:00Z", "src_ip": "a", "dest_ip": "b", "http": {"method": "GET", "http_host": "h", "status": 200}}', '{"event_type": "tcp"}', "", json.dumps(flow(None, "bad", flow={"alerted": True})), json.dumps(flow("nan", 5.5, flow=None)), "[1]", json.dumps({"event_type": " FLOW ", "flow": {}})]
    (tmp_path / "sub").mkdir()
    (tmp_path / "eve.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "sub" / "more.json").write_text(json.dumps(flow("sub", at)) + "\n")
    return tmp_path


def test_line_scan(spark, log):
    events = eve.read_events(spark, str(log / "eve.json"))
    assert sorted(r.t for r in events.select(F.coalesce("event.event_type", F.lit("")).alias("t")).collect()) == [" FLOW ", "dns"] + ["flow"] * 5 + ["http", "tcp"]
    only = eve.read_events(spark, str(log / "eve.json"), ("flow",))
    assert only.count() == 6 and eve.read_events(spark, str(log / "eve.json"), ("flow",), most=2).count() == 2
    assert eve.read_events(spark, str(log), ("flow",), recursive=True).count() == 7


def test_flows_of_events(spark, log):
    events = eve.read_events(spark, str(log / "eve.json"))
    flows = eve.to_flows(events)
    rows = {r.flow_id: r for r in flows.collect()}
    assert rows["12345"].identity_key == "12345" and rows["12345"].ts_us == 1_499_428_790_639_970
    assert rows[None].ts_us == 0 and rows[None].flow_key in ("10.0.0.1:5-10.0.0.2:80-TCP_0", "UNKNOWN:0-UNKNOWN:0-TCP_0")
    assert flows.count() == 5 and eve.to_flows(events, dedupe=True).count() == 4
    assert eve.to_flows(events, benign_only=True).count() == 4
    loose = eve.to_flows(events, need_flow=False).where("ts_us = 5500000").collect()
    assert len(loose) == 1 and loose[0].flow_id is None


def test_requests_and_masks(spark, log):
    r = eve.http_rows(eve.read_events(spark, str(log / "eve.json"))).collect()[0]
    assert (r.http_method, r.http_host, r.http_status, r.http_url) == ("GET", "h", "200", "")
    tcp = [{"syn": True, "ack": True}, {"tcp_flags_ts": "02", "tcp_flags_tc": "0x12"}, {"tcp_flags": "1b"}, {"tcp_flags": "S"}, None]
    df = spark.createDataFrame([(i, json.dumps(flow(i, "2020-01-01T00:00:00Z", tcp=t))) for i, t in enumerate(tcp)], "seq long, value string")
    assert [x.m for x in eve.parsed(df).select(eve.mask(None).alias("m"), "seq").orderBy("seq").collect()] == [0x12, 0x12, 0x1B, 0, 0]


def test_pretty_printed_files(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(flow(i, "2020-01-01T00:00:00Z"), indent=2) for i in range(3)))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(flow(i, "2020-01-01T00:00:00Z")) for i in range(3)))
    assert not eve.is_line_wise(spark, str(tmp_path / "p.json")) and eve.is_line_wise(spark, str(tmp_path / "l.json"))
    for name in ("p", "l"):
        events = eve.read_any(spark, str(tmp_path / f"{name}.json"), ("flow",)).orderBy("seq").collect()
        assert [r.event.flow_id for r in events] == ["0", "1", "2"], name


def test_labels_and_scoring_tables(spark, tmp_path):
    (tmp_path / "l.csv").write_text("flow_id ,label,src_ip,dst_ip,src_port,dst_port,proto,timestamp,attack_type\n# note\n123.0,attack,a,b,1,2,tcp,2020-01-01T00:00:00Z,DoS\nnan,0,a,b,1,2,tcp,1577836800,\n,benign,a,b,1,2,tcp,1577836800000,none\n")
    rows = eve.read_labels(eve.read_csv(spark, str(tmp_path / "l.csv"))).orderBy("seq").collect()
    assert [(r.identity_key, r.binary_label, r.attack_subclass) for r in rows] == [("123", 1, "DoS"), ("a:1-b:2-TCP_315567360", 0, ""), ("a:1-b:2-TCP_315567360", 0, "")]
    with pytest.raises(ValueError):
        eve.read_labels(spark.createDataFrame([("x",)], "flow_id string"))
    (tmp_path / "s.csv").write_text("Source IP,dst_port,has_tcp\n1.2.3.4,80,x\n")
    r = eve.scoring_rows(eve.read_csv(spark, str(tmp_path / "s.csv")), ("has_tcp", "flow_rate_src_10s")).collect()[0]
    assert (r.has_tcp, r.flow_rate_src_10s, r.src_ip, r.dst_port, r.dst_ip) == (0.0, 0.0, "1.2.3.4", "80", None)


def test_sinks(spark, tmp_path, log):
    df = spark.createDataFrame([(1, "x"), (0, "y"), (1, "z")], "label int, v string")
    sinks.split_tables(df, str(tmp_path / "split"), F.col("label") == 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "split/part=attack")).count() == 2
    sinks.capped_table(df, str(tmp_path / "capped"), 2)
    assert spark.read.parquet(str(tmp_path / "capped")).count() == 2
    events = eve.read_events(spark, str(log / "eve.json"), ("flow",))
    sinks.original_lines(events, str(tmp_path / "lines"), [F.col("seq").desc()])
    assert spark.read.text(str(tmp_path / "lines")).count() == 6
    assert sinks.in_order(df, sinks.GROUND_TRUTH).columns == list(sinks.GROUND_TRUTH)
    tiers = spark.createDataFrame([("k", "medium", "r"), ("j", "normal", "none")], "flow_key string, tier string, rule string")
    assert [tuple(r) for r in sinks.weights(tiers).orderBy("flow_key").collect()] == [("j", "1.000", "mawi_normal", "none"), ("k", "0.400", "mawi_medium", "r")]
    rows = df.selectExpr("1500000L as ts_us", "v as src_ip", "v as dst_ip", "1 as dst_port", "0.5D as probability", "0.5D as risk", "0.1D as anomaly", "'HIGH' as decision")
    r = sinks.decision_rows(rows).collect()[0]
    assert (r.timestamp, r.action, r.is_attack) == ("1970-01-01T00:00:01.500000Z", "BLOCK", True)
    sinks.append_json(sinks.decision_rows(rows), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_flat_records_ids_and_scans(spark):
    flat = spark.createDataFrame([("2020-01-01T00:00:00Z", "7", "a", "b", 1, 2, "udp", 0.0, 3)], "timestamp string, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, proto string, duration double, bytes_toserver long")
    r = eve.to_flows(eve.parsed(eve.from_flat(flat).withColumn("seq", F.lit(0)))).collect()[0]
    assert (r.duration, r.fwd_bytes, r.syn, r.ack, r.proto, r.flow_id) == (0.001, 3, 1, 1, "UDP", "7")
    ids = spark.createDataFrame([(1, "flow", None), (2, "dns", None), (3, "flow", "x"), (4, "flow", "")], "seq int, event_type string, flow_id string")
    assert [x.flow_id for x in eve.with_ids(ids, [F.col("seq")]).orderBy("seq").collect()] == ["dec0de0000000000", None, "x", "dec0de0000000001"]
    scan = eve.to_flows(eve.parsed(eve.synthetic_scan(spark, 50).withColumn("seq", F.monotonically_increasing_id())))
    assert scan.count() == 50 and scan.where("syn = 1").count() == 50
    assert sampling.is_in_order(scan, "ts_us", "seq").first()[0]


def netflow(i, at, **body):
    return json.dumps({"event_type": "netflow", "timestamp": at, "src_ip": "10.0.0.1", "src_port": 5, "dest_ip": "10.0.0.2", "dest_port": 80, "netflow": body})


def test_netflow(spark):
    lines = [netflow(0, 3, pkt_per_sec=4, iatmin="x", inter_arrival_min=2), netflow(1, 3, other=1), netflow(2, 4, pkt_rate="nan", pktrate=7)]
    got = eve.netflow_metrics(eve.parsed(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))).orderBy("seq").collect()
    assert [(r.seq, r.ts_us, r.pkt_rate, r.iat_min, r.iat_max, r.flow_key) for r in got] == [(0, 3_000_000, 4.0, 2.0, None, "10.0.0.1:5-10.0.0.2:80-TCP_0"), (2, 4_000_000, 7.0, None, None, "10.0.0.1:5-10.0.0.2:80-TCP_0")]


def test_flows_take_the_pace_of_their_latest_record(spark):
    lines = [netflow(0, 2, pkt_rate=9, iat_max=1.5), json.dumps(flow("a", 3)), netflow(2, 4, byte_rate=8), json.dumps(flow("b", 4.5)), json.dumps(flow("c", 1)), json.dumps(flow("d", 7))]
    events = eve.parsed(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))
    flows = eve.to_flows(events.where("lower(event.event_type) = 'flow'"))
    got = {r.flow_id: (r.pkt_rate, r.byte_rate, r.iat_max) for r in packs.enriched(flows, eve.netflow_metrics(events)).collect()}
    assert got == {"a": (9.0, 15.0, 1.5), "b": (0.0, 8.0, 0.0), "c": (0.0, 15.0, 0.0), "d": (0.0, 15.0, 0.0)}


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    """The second file is the largest, which is read first, and its splits are many; names hold spaces."""
    (tmp_path / "a 1.json").write_text("a1\na2\n")
    (tmp_path / "b 2.json").write_text("".join(f"b{k}\n" for k in range(5000)))
    (tmp_path / "c.json").write_text("c1\nc2")
    (tmp_path / "c.json0").write_text("d\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = eve.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.seq for r in rows}) == len(rows)
    assert [r.value for r in sorted(rows, key=lambda r: r.seq)] == ["a1", "a2", *[f"b{k}" for k in range(5000)], "c1", "c2", "d"]


def test_first_events_and_last_labels_over_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text(json.dumps(flow("first", 1)) + "\n")
    (tmp_path / "log" / "b.json").write_text("".join(json.dumps(flow(f"b{k}", 1)) + "\n" for k in range(400)))
    first = eve.read_events(spark, str(tmp_path / "log"), ("flow",), most=2)
    assert sorted(r.i for r in first.select(F.col("event.flow_id").alias("i")).collect()) == ["b0", "first"]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "1.csv").write_text("flow_id,label\nx,0\n")
    (tmp_path / "labels" / "2.csv").write_text("flow_id,label\n" + "".join(f"y{k},1\n" for k in range(300)) + "x,1\n")
    labels = eve.read_labels(eve.read_csv(spark, str(tmp_path / "labels")))
    last = joins.last_wins(labels, "identity_key").where("identity_key = 'x'").collect()
    assert [(r.identity_key, r.binary_label) for r in last] == [("x", 1)]


def test_lines_that_are_no_json_objects_are_left_out(spark):
    lines = ['{"event_type": "flow"}', '{"event_type": "flow"', "{'event_type': 'flow'}", '[{"event_type": "flow"}]', "", "{}", "null", '"flow"', '{"event_type": "flow", "flow": {"age": NaN}}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "seq long, value string")
    assert sorted(r.seq for r in eve.parsed(df).collect()) == [0, 5, 8]
    assert "_not_json" not in eve.parsed(df).columns


def test_flows_are_estimated_by_their_own_width(spark):
    """Rows cut from parsed lines are not taken for a thousandth of their size, which would have them broadcast."""
    n = 5_000
    lines = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit('{"event_type":"flow","flow_id":"f'), F.col("id").cast("string"), F.lit('","flow":{"age":1},"tcp":{"syn":true}}')).alias("value"))
    flows = eve.to_flows(eve.parsed(lines, ("flow",)))
    assert int(flows.select("seq")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= 8 * n
    assert flows.count() == n


def test_large_tables_by_event_are_not_broadcast(spark):
    """Neither side of these joins has fewer rows than there are events."""
    from weirflow.plans import queries as plans

    for name in ("score_functions", "training_table"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan()
        assert _least_side(plan, name) >= 8 * 100_000, name


def _least_side(plan, name):
    """Bytes that the smaller side of the plan's first join is estimated at."""
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    return min(int(plan.children().apply(k).stats().sizeInBytes()) for k in range(2))
