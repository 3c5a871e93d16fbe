import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weirflow.functions import coerce, decisions, network, stats, times
from weirflow.operators import aggregates, context, joins, labeling, sampling, sets, windows
from weirflow.operators.blocking import Blocks
from weirflow.operators.sweep import BySource, Gaps, Histogram
from weirflow.plans import pipelines


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_sliced_windows_equal_whole_ones(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 400), "hot" if i % 3 else "k", rng.randint(1, 9)) for i in range(600)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "seq long, ts_us long, key string, v long")
    whole = df.withColumn("s", windows.prior_sum(F.col("v"), ["key"], 50))
    cut = windows.sliced(df, ["key"], 50, 60).withColumn("s", windows.prior_sum(F.col("v"), ["key", "slice"], 50)).where("not context")
    assert {(r.seq, r.s) for r in whole.collect()} == {(r.seq, r.s) for r in cut.collect()}


def test_distinct_by_running_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 60), rng.choice("ab"), rng.choice("xyz")) for i in range(300)]
    got = {r.seq: r.n for r in windows.prior_distinct(spark.createDataFrame(rows, "seq long, ts_us long, key string, v string"), "n", "v", ["key"], 7).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, (s, t, k, _) in enumerate(order):
        assert got[s] == len({p[3] for p in order[:i] if p[2] == k and p[1] >= t - 7})


def test_sweep_parts_agree_with_direct_ones():
    rng = random.Random(3)
    h, g, values, moments = Histogram(), Gaps(), [], []
    t = 0
    for _ in range(400):
        if values and rng.random() < 0.4:
            h.remove(values.pop(0))
            moments.pop(0)
            g.remove()
        t += rng.choice([0, 5, 1_000_000, 777])
        values.append(rng.randint(0, 5))
        moments.append(t)
        h.add(values[-1])
        g.add(t)
        assert h.distinct == len(set(values)) and h.most == max(Counter(values).values())
        from tests.simulation import autocorrelation, entropy, gaps, variation

        assert h.entropy() == pytest.approx(entropy(Counter(values).values()))
        assert g.variation() == pytest.approx(variation(gaps(moments)), abs=1e-9)
        assert g.autocorrelation() == pytest.approx(autocorrelation(gaps(moments)), abs=1e-6)


def test_array_statistics(spark):
    r = one(spark, e=stats.entropy(F.array(*[F.lit(x) for x in "aab"]), 0.0), m=stats.first_mode(F.array(*[F.lit(x) for x in "baab"])), g=stats.gaps(F.array(F.lit(5), F.lit(1), F.lit(2))), v=stats.variance_of(F.array(F.lit(1.0), F.lit(3.0))), n=stats.variation(F.array().cast("array<double>")), a=stats.autocorrelation(F.array(*[F.lit(float(x)) for x in (1, 2, 1, 2, 1)])))
    assert r.e == pytest.approx(0.9182958) and r.m == "b" and r.g == [1, 3] and r.v == 1.0 and r.n == 0.0 and r.a == pytest.approx(-1.0)


def test_coercions(spark):
    lit = F.lit
    r = one(spark, a=coerce.safe_int(lit("3.9")), b=coerce.safe_int(lit("x")), c=coerce.safe_float(lit("NaN"), 7.0), d=coerce.address(lit("  ")), e=coerce.label_id(lit("12.0")), f=coerce.event_id(lit("None")), g=coerce.port(lit("70000")), h=coerce.plain_address(lit("::FFFF:1.2.3.4")), i=coerce.prefix24(lit("1.2.3.4")), j=coerce.binary_label(lit("0.5")), k=coerce.table_text(lit("<NA>")), m=coerce.attack_family(lit("x"), {"X ": "Recon"}), n=coerce.plain_label(lit(" Normal ")))
    assert tuple(r) == (3, 0, 7.0, "UNKNOWN", "12", None, None, "1.2.3.4", "1.2.3", 0, "", "Recon", "benign")
    with pytest.raises(Exception, match="unrecognised"):
        one(spark, a=coerce.binary_label(lit("perhaps")))


def test_times(spark):
    r = one(spark, a=times.parsed_us(F.lit("2017-07-07T17:29:50.639970+0530")), b=times.parsed_us(F.lit("1970-01-01 00:00:01Z")), c=times.parsed_us(F.lit("rubbish")), d=times.label_us(F.lit("1577836800000")), e=times.label_us(F.lit("5")), f=times.log_us(F.lit(1.5e12)), g=times.path_weekday(F.lit("/x/friday/eve.json")), h=times.path_date(F.lit("/x/14-02-2018/y")).cast("string"), i=times.path_date(F.lit("/x/99-99-2018")).cast("string"), j=times.iso_text(F.lit(1_000_000)), k=times.event_us(F.lit(""), F.lit(None).cast("string"), F.lit("3")))
    assert tuple(r) == (1_499_428_790_639_970, 1_000_000, None, 1_577_836_800_000_000, None, 1_500_000_000_000_000, "Friday", "2018-02-14", None, "1970-01-01T00:00:01Z", 3_000_000)


def test_network(spark):
    lit = F.lit
    r = one(spark, a=network.private_address(lit("172.31.0.1")), b=network.private_address(lit("172.32.0.1")), c=network.safe_to_block(lit("224.0.0.5")), d=network.safe_to_block(lit("8.8.8.8")), e=network.same_prefix(lit("1.2.3.4"), lit("1.2.3.200")), f=network.same_prefix(lit("1.2.3.4"), lit("x")), g=network.hex_mask(lit("0x1B")), h=network.failed_connection(lit(1.0), lit(10), lit(1), lit(1)), i=network.flag_score(lit(True), lit(False), lit(False), lit(True)), j=network.fnv1a(lit("foobar")), k=network.duration_bucket(lit(None).cast("double")), m=network.port_bucket(lit("x")), n=network.safe_to_block(lit("::1")))
    assert tuple(r) == (True, False, False, True, True, False, 0x1B, 1, 0.9, "85944171f73967e8", "d_unknown", "unknown", False)
    made = network.basics(lit(-1.0), lit(10), lit(20), lit(2), lit(1)) | network.rhythms(lit(2.0), lit(10), lit(20), lit(2), lit(1), lit(3), lit(0)) | network.advanced(lit(2), lit(2), lit("s")) | network.evasion(F.array(lit(1.0), lit(3.0), lit(None).cast("double")), lit("5"), lit(None).cast("string")) | network.tls_flags(lit("flow"), lit("TLS"), lit("TLS 1.2"))
    r = one(spark, **made)
    assert (r.duration, r.avg_pkt_size, r.pkt_rate, r.iat_avg, r.src_pkts_ratio, r.ttl_variance, r.tls_version, r.tcp_window_size_avg) == (0.0, 10.0, 1.5, 1.0, 0.5, 1.0, 1.2, 5.0)


def test_decisions(spark):
    lit = F.lit
    r = one(spark, a=decisions.primary_tier(lit(0.7), lit(0.0)), b=decisions.primary_tier(lit(0.01), lit(0.8)), c=decisions.primary_tier(lit(0.4), lit(0.1)), d=decisions.severest(lit("MEDIUM"), lit("HIGH")), e=decisions.assisted(lit("MEDIUM"), lit("HIGH")), f=decisions.assisted(lit("LOW"), lit("HIGH")), g=decisions.capped(lit("HIGH"), lit(0.69)), h=decisions.anomaly_sigmoid(lit(0.0)), i=decisions.hybrid_label(lit(0.5), lit(-0.2)), j=decisions.sample_weight(lit("low")), k=decisions.risk(lit(1.0), lit(1.0), lit(2.0)), m=decisions.assisted(lit("LOW"), lit("HIGH"), True))
    assert tuple(r) == ("HIGH", "HIGH", "MEDIUM", "HIGH", "HIGH", "LOW", "MEDIUM", 0.5, "ANOMALY", 0.7, 1.0, "HIGH")


def test_published_schedules(spark):
    s = {r.ordinal: r for r in labeling.schedule_2018(spark).collect()}
    assert len(s) == 22 and s[0].start_us == (1_518_622_320 - 60) * 10**6 and s[3].end_us == (1_518_712_800 + 60) * 10**6 and s[20].both_ways
    inside = s[20].start_us
    rows = [(1, inside, "18.219.211.138", "172.31.69.6"), (2, inside, "172.31.69.6", "18.219.211.138"), (3, inside - 1, "18.219.211.138", "172.31.69.6"), (4, s[5].end_us, "172.31.69.25", "18.219.193.20"), (5, s[5].end_us, "18.219.193.20", "172.31.69.25"), (6, None, "a", "b")]
    got = labeling.by_schedule(spark.createDataFrame(rows, "seq int, ts_us long, src_ip string, dst_ip string"), labeling.schedule_2018(spark))
    assert [(r.label, r.attack_type) for r in got.orderBy("seq").collect()] == [(1, "Bot"), (1, "Bot"), (0, "benign"), (0, "benign"), (1, "DoS-Hulk"), (0, "benign")]
    at = 1_499_365_140 * 10**6  # 2017-07-06 14:19:00 in New York
    rows = [(1, at, "192.168.10.8", "192.168.10.9"), (2, at + 120_999_999, "205.174.165.73", "x"), (3, at + 121_000_000, "205.174.165.73", "x"), (4, at, "x", "y")]
    got = labeling.by_interval(spark.createDataFrame(rows, "seq int, ts_us long, src_ip string, dst_ip string"), labeling.schedule_2017(spark), F.lit("Thursday"))
    assert [r.attack_type for r in got.orderBy("seq").collect()] == ["LateralMovement/Metasploit", "Infiltration/Metasploit", "benign", "benign"]
    assert labeling.for_date(labeling.schedule_2018(spark), F.lit("/14-02-2018/")).count() == 2


def test_truth_tolerance_is_inclusive(spark):
    truth = labeling.truth_rows(spark.createDataFrame([("100", "a", "1", "b", "2", "tcp"), ("x", "a", "1", "b", "2", "tcp"), ("7", "", "1", "b", "2", "tcp")], "ts string, src_ip string, src_port string, dst_ip string, dst_port string, proto string"))
    assert truth.count() == 1
    rows = [(i, t, "a", "b", 1, 2, "TCP") for i, t in enumerate([99_000_000, 98_999_999, 101_000_000, 101_000_001])]
    got = labeling.by_truth(spark.createDataFrame(rows, "seq int, ts_us long, src_ip string, dst_ip string, src_port long, dst_port long, proto string"), truth)
    assert [r.label for r in got.orderBy("seq").collect()] == [1, 0, 1, 0]


def test_weak_indicators(spark):
    schema = "label string, srcIP string, srcPort string, dstIP string, dstPort string, nbDetectors string"
    bad = [("anomalous", "::ffff:1.2.3.4", "80", "", "", "1"), ("suspicious", "5.5.5.5", "90", "", "", "4"), ("suspicious", "6.6.6.6", "x", "", "", "1"), ("suspicious", "6.6.6.6", "", "", "", "1"), ("suspicious", "7.7.7.7", "1", "", "", "1"), ("odd", "8.8.8.8", "", "", "", "")]
    low = [("notice", "9.9.9.9", "1", "", "", "")] + [("notice", "4.4.4.4", "", "", "", "")] * 3
    found = labeling.indicators(spark.createDataFrame(bad, schema), spark.createDataFrame(low, schema))
    rows = [(1, "1.2.3.99", 1, "x", 1), (2, "x", 1, "5.5.5.5", 90), (3, "6.6.6.6", 1, "x", 1), (4, "7.7.7.7", 1, "x", 1), (5, "9.9.9.9", 1, "x", 1), (6, "4.4.4.4", 3, "x", 1), (7, "8.8.8.8", 0, "x", 0)]
    got = labeling.by_indicators(spark.createDataFrame(rows, "seq int, src_ip string, src_port int, dst_ip string, dst_port int"), found, "strict_clean")
    assert [(r.tier, r.rule, r.label, r.keep) for r in got.orderBy("seq").collect()] == [("high", "high_ip", 1, False), ("medium", "medium_ip_port_strong", 1, False), ("medium", "medium_ip_strong", 1, False), ("normal", "none", 0, True), ("low", "low_notice_ip_port", 0, True), ("low", "low_notice_ip_freq", 0, True), ("normal", "none", 0, True)]


def test_last_label_wins(spark):
    labels = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3), (None, 1, 4)], "identity_key string, binary_label int, seq long")
    got = joins.labelled(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "identity_key string"), labels)
    assert sorted((r.identity_key, r.binary_label) for r in got.collect()) == [("a", 1), ("b", 0)]
    assert {r.identity_key for r in aggregates.conflicts(labels, "identity_key", "binary_label").collect()} == {"a"}


def test_quotas_that_must_be_clipped(spark):
    def greedy(items, total):
        out = {k: min(q, a) for k, q, a in items}
        spare = {k: a - out[k] for k, _, a in items}
        need = total - sum(out.values())
        while need > 0 and max(spare.values()) > 0:
            k = max(sorted(spare), key=lambda x: spare[x])
            out[k], spare[k], need = out[k] + 1, spare[k] - 1, need - 1
        return sum(out.values()), sorted(out.values())

    rng = random.Random(8)
    for _ in range(6):
        items = [(k, rng.randint(0, 30), rng.randint(0, 30)) for k in "abcdefg"]
        total = sum(q for _, q, _ in items)
        got = sampling.capped_quotas(spark.createDataFrame(items, "k string, quota long, available long"), total, ["k"]).collect()
        assert (sum(r.quota for r in got), sorted(r.quota for r in got)) == greedy(items, total)


def test_downsampled_rows(spark):
    rows = [(i, "dos" if i % 10 else "benign", i * 1_000_000, f"s{i % 7}", i % 3 * 30000, float(i % 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label string, ts_us long, src_ip string, dst_port long, duration double")
    out = sampling.downsampled(df, "label", {"dos": 400}, "id", phases=3)
    got = Counter(r.label for r in out.collect())
    assert got == {"dos": 400, "benign": 300} and out.columns == df.columns
    again = sampling.downsampled(df.repartition(7), "label", {"dos": 400}, "id", phases=3)
    assert {r.id for r in again.collect()} == {r.id for r in out.collect()}
    assert sampling.relative_caps(df, "label", {"dos": 10_000}, 1.5) == {"dos": 450}
    assert sampling.relative_caps(df, "label", {"dos": 10, "benign": 5}, 1.5) == {"dos": 10, "benign": 5}


def test_orders_and_splits(spark):
    df = spark.createDataFrame([(0, 5), (1, None), (2, 3), (3, 3)], "o long, t long")
    assert [r.o for r in sampling.in_time_order(df, F.col("t"), "o").collect()] == [2, 3, 0, 1]
    assert not sampling.is_in_order(df, "t", "o").first()[0]
    big = spark.range(1000).withColumn("t", F.col("id") * 3).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = Counter(r["range"] for r in sampling.ranges(big, 4, "t", "id").collect())
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) <= 260
    folded = sampling.folds(big.withColumn("g", F.col("id") % 200), "g", 5, "y")
    assert folded.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert len({r.fold for r in folded.collect()}) == 5


def test_sets(spark):
    a = spark.createDataFrame([("x", "1"), ("a", "b"), (None, None)], "a string, b string")
    assert sets.without_headers(a).count() == 1
    assert sets.aligned(a, ("b", "c")).columns == ["b", "c"]
    assert sets.attack_rows(spark.createDataFrame([("DoS",), ("nan",), (None,), ("Benign",)], "l string"), "l").count() == 1
    assert sets.valid_benign(spark.createDataFrame([("0", "1"), ("0", None), ("nan", "2")], "l string, f string"), "l", "f").count() == 1


def test_blocks_by_hand():
    limits = context.BlockLimits(ttl=10, most=2, per_minute=3)
    b = Blocks(limits)
    s = 1_000_000
    assert b.add("a", 0) and b.add("a", 1 * s) and b.add("b", 2 * s)
    assert b.add("c", 3 * s)  # evicts a
    assert not b.add("d", 4 * s)  # the minute's three are used; the eviction stays
    assert [x[0] for x in b.ended] == ["a", "b"] and list(b.since) == ["c"]
    assert b.add("d", 62_000_001) and b.ended[-1][3] == "expired"


def test_block_table(spark):
    rows = [(1, "8.8.8.8", 0, "BLOCK"), (2, "8.8.8.8", 1_000_000, "BLOCK"), (3, "10.0.0.1", 2_000_000, "BLOCK"), (4, "9.9.9.9", 3_000_000, "ALLOW"), (5, "UNKNOWN", 3_000_000, "BLOCK"), (6, "8.8.8.8", 700_000_000, "BLOCK")]
    out = context.block_list(spark.createDataFrame(rows, "seq int, src_ip string, ts_us long, action string"))
    assert sorted((r.src_ip, r.blocked_us, r.ended_us, r.end) for r in out.collect()) == [("10.0.0.1", 2_000_000, 602_000_000, "expired"), ("8.8.8.8", 0, 600_000_000, "expired"), ("8.8.8.8", 700_000_000, None, "in force")]
    assert context.in_force(out, 5_000_000).count() == 2 and context.safe_blocks(out).count() == 2


def test_whole_batch_escalation(spark):
    rows = [(i, i * 1_000_000, "s", f"d{i}", 80, 0.1, "LOW") for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, ts_us long, src_ip string, dst_ip string, dst_port long, risk double, decision string")
    count = lambda **k: context.escalated(df, **k).where("context_decision = 'HIGH'").count()
    assert count() == 3 and count(whole_batch=True) == 12
    first = context.events(df).collect()
    assert [(e.event_type, e.key, e.seq, e.observed) for e in first] == [("source_dst_fanout", "s", 9, 10)]


def test_reachable_flows_suffice(spark):
    rng = random.Random(9)
    rows = [(i, f"s{rng.randint(0, 9)}", f"d{rng.randint(0, 9)}", f"f{i}") for i in range(80)]
    flows = spark.createDataFrame(rows, "seq long, src_ip string, dst_ip string, identity_key string")
    labels = spark.createDataFrame([("f3",), ("f50",)], "identity_key string")
    got = {r.seq for r in pipelines.reachable(flows, labels).collect()}
    s, d = {rows[3][1], rows[50][1]}, {rows[3][2], rows[50][2]}
    assert got == {r[0] for r in rows if r[1] in s or r[2] in d}
    assert pipelines.reachable(flows, labels).count() == len(got)


def test_mode_takes_the_earliest_of_equals():
    sweep = BySource()
    sweep.start()
    modes = [sweep.row(t * 1_000_000, "d", 1, size, 0.0)[6] for t, size in enumerate([128, 256, 256, 128, 0])]
    assert modes == [0, 1, 1, 2, 1]


def test_ground_truth_columns(spark):
    rows = spark.createDataFrame([(1_500_000, "a", "b", 1, 2, "TCP", None, 1, "DoS", "m"), (0, "a", "b", 1, 2, "TCP", "9", 0, "benign", "m")], "ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, flow_id string, label int, attack_type string, labeling_mode string")
    out = pipelines.ground_truth(rows, F.lit("Monday")).collect()
    assert {r.flow_key for r in out} == {"a:1-b:2-TCP-1", "Monday-9"} and len(out[0]) == 18


def test_hot_keys_have_the_same_context(spark):
    """Every source and destination is hot, and cut into slices shorter and longer than the windows."""
    rng = random.Random(12)
    rows, t = [], 0
    for k in range(300):
        t += rng.choice([0, 1, 2, 30]) * 1_000_000
        rows.append((k, t, f"s{rng.randrange(3)}", f"d{rng.randrange(3)}", rng.randrange(5), rng.random()))
    df = spark.createDataFrame(rows, "seq long, ts_us long, src_ip string, dst_ip string, dst_port long, risk double")
    whole = sorted(map(tuple, context.measured(df).collect()))
    for slice_us in (1, 900_000_000):
        assert sorted(map(tuple, context.measured(df, hot_rows=10, slice_us=slice_us).collect())) == whole
    assert len(whole) == 300
