"""Labels of events from attack schedules, ground truth and weak indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import coerce, times
from weirflow.operators.joins import scheduled, tiered, within

# The published schedule of the 2018 attacks, in Eastern wall time taken as UTC-5 (name, day, start, end, attackers, victims).
_LOIC = ("18.216.200.189", "18.216.24.42", "18.218.11.51", "18.218.115.60", "18.218.229.235", "18.218.55.126", "18.219.32.43", "18.219.5.43", "18.219.9.1", "52.14.136.135")
_BOTS = ("172.31.69.6", "172.31.69.8", "172.31.69.10", "172.31.69.12", "172.31.69.14", "172.31.69.17", "172.31.69.23", "172.31.69.26", "172.31.69.29", "172.31.69.30")
SCHEDULE_2018 = (
    ("FTP-BruteForce", "2018-02-14", "10:32", "12:09", ("18.221.219.4", "172.31.70.4"), ("172.31.69.25",)),
    ("SSH-Bruteforce", "2018-02-14", "14:01", "15:31", ("13.58.98.64", "172.31.70.6"), ("172.31.69.25",)),
    ("DoS-GoldenEye", "2018-02-15", "09:26", "10:09", ("18.219.211.138", "172.31.70.46"), ("172.31.69.25",)),
    ("DoS-Slowloris", "2018-02-15", "10:59", "11:40", ("18.217.165.70", "172.31.70.8"), ("172.31.69.25",)),
    ("DoS-SlowHTTPTest", "2018-02-16", "10:12", "11:08", ("13.59.126.31", "172.31.70.23"), ("172.31.69.25",)),
    ("DoS-Hulk", "2018-02-16", "13:45", "14:19", ("18.219.193.20", "172.31.70.16"), ("172.31.69.25",)),
    ("DDoS attacks-LOIC-HTTP", "2018-02-20", "10:12", "11:17", _LOIC, ("172.31.69.25",)),
    ("DDoS-LOIC-UDP", "2018-02-20", "13:13", "13:32", _LOIC, ("172.31.69.25",)),
    ("DDoS-LOIC-UDP", "2018-02-21", "10:09", "10:43", _LOIC, ("172.31.69.28",)),
    ("DDOS-HOIC", "2018-02-21", "14:05", "15:05", _LOIC, ("172.31.69.28",)),
    ("Brute Force -Web", "2018-02-22", "10:17", "11:24", ("18.218.115.60",), ("172.31.69.28",)),
    ("Brute Force -XSS", "2018-02-22", "13:50", "14:29", ("18.218.115.60",), ("172.31.69.28",)),
    ("SQL Injection", "2018-02-22", "16:15", "16:29", ("18.218.115.60",), ("172.31.69.28",)),
    ("Brute Force -Web", "2018-02-23", "10:03", "11:03", ("18.218.115.60",), ("172.31.69.28",)),
    ("Brute Force -XSS", "2018-02-23", "13:00", "14:10", ("18.218.115.60",), ("172.31.69.28",)),
    ("SQL Injection", "2018-02-23", "15:05", "15:18", ("18.218.115.60",), ("172.31.69.28",)),
    ("Infiltration", "2018-02-28", "10:50", "12:05", ("13.58.225.34",), ("172.31.69.24",)),
    ("Infiltration", "2018-02-28", "13:42", "14:40", ("13.58.225.34",), ("172.31.69.24",)),
    ("Infiltration", "2018-03-01", "09:57", "10:55", ("13.58.225.34",), ("172.31.69.13",)),
    ("Infiltration", "2018-03-01", "14:00", "15:37", ("13.58.225.34",), ("172.31.69.13",)),
    ("Bot", "2018-03-02", "10:11", "11:34", ("18.219.211.138",), _BOTS),
    ("Bot", "2018-03-02", "14:24", "15:55", ("18.219.211.138",), _BOTS),
)
# Seconds by which a window is longer at its start and end.
BUFFERS = {
    "DoS-Hulk": (30, 30), "DoS-GoldenEye": (30, 30), "DDoS attacks-LOIC-HTTP": (30, 30), "DDoS-LOIC-UDP": (30, 30), "DDOS-LOIC-UDP": (30, 30), "DDOS-HOIC": (30, 30),
    "DoS-Slowloris": (120, 60), "DoS-SlowHTTPTest": (120, 60), "Bot": (180, 180), "Infiltration": (180, 180),
}
OTHER_BUFFER = (60, 60)
#: Attacks of which both directions count.
BOTH_WAYS = ("Bot", "Infiltration")

# The published schedule of the 2017 attacks, in New York wall time, ends inclusive (day, date, start, end, type, subtype).
SCHEDULE_2017 = (
    ("Tuesday", "2017-07-04", "09:20", "10:20", "BruteForce", "FTP-Patator"),
    ("Tuesday", "2017-07-04", "14:00", "15:00", "BruteForce", "SSH-Patator"),
    ("Wednesday", "2017-07-05", "09:47", "10:10", "DoS", "Slowloris"),
    ("Wednesday", "2017-07-05", "10:14", "10:35", "DoS", "SlowHTTPTest"),
    ("Wednesday", "2017-07-05", "10:43", "11:00", "DoS", "Hulk"),
    ("Wednesday", "2017-07-05", "11:10", "11:23", "DoS", "GoldenEye"),
    ("Wednesday", "2017-07-05", "15:12", "15:32", "Exploitation", "Heartbleed"),
    ("Thursday", "2017-07-06", "09:20", "10:00", "WebAttack", "BruteForce"),
    ("Thursday", "2017-07-06", "10:15", "10:35", "WebAttack", "XSS"),
    ("Thursday", "2017-07-06", "10:40", "10:42", "WebAttack", "SQLi"),
    ("Thursday", "2017-07-06", "14:19", "14:21", "Infiltration", "Metasploit"),
    ("Thursday", "2017-07-06", "14:33", "14:35", "Infiltration", "Metasploit"),
    ("Thursday", "2017-07-06", "14:53", "15:00", "Infiltration", "Mac"),
    ("Thursday", "2017-07-06", "15:04", "15:45", "Infiltration", "Dropbox"),
    ("Friday", "2017-07-07", "10:02", "11:02", "Botnet", "ARES"),
    ("Friday", "2017-07-07", "13:55", "14:24", "Recon", "PortScan"),
    ("Friday", "2017-07-07", "14:51", "15:29", "Recon", "PortScanVariants"),
    ("Friday", "2017-07-07", "15:56", "16:16", "DDoS", "LOIT"),
)
ATTACKERS_2017 = ("205.174.165.73", "205.174.165.69", "205.174.165.70", "205.174.165.71")
FIREWALLS_2017 = ("205.174.165.80", "172.16.0.1")
VICTIMS_2017 = ("192.168.10.50", "192.168.10.51", "192.168.10.8", "192.168.10.25", "192.168.10.5", "192.168.10.9", "192.168.10.14", "192.168.10.15")
LATERAL_SOURCE = "192.168.10.8"


def schedule_2018(spark: SparkSession) -> DataFrame:
    """ordinal, name, start_us, end_us (both inclusive, buffers in), attackers, victims, both_ways."""
    rows = spark.createDataFrame([(i, n, f"{d} {s}:00", f"{d} {e}:00", list(a), list(v)) for i, (n, d, s, e, a, v) in enumerate(SCHEDULE_2018)], "ordinal int, name string, s string, e string, attackers array<string>, victims array<string>")
    shift = 5 * 3600
    early, late = F.lit(OTHER_BUFFER[0]), F.lit(OTHER_BUFFER[1])
    for name, (a, b) in BUFFERS.items():
        early, late = F.when(F.col("name") == name, a).otherwise(early), F.when(F.col("name") == name, b).otherwise(late)
    us = lambda c, more: F.unix_micros(F.to_utc_timestamp(F.to_timestamp(c), "UTC")) + (F.lit(shift) + more).cast("long") * 1_000_000
    return rows.select("ordinal", "name", us("s", -early).alias("start_us"), us("e", late).alias("end_us"), "attackers", "victims", F.col("name").isin(*BOTH_WAYS).alias("both_ways"))


def schedule_2017(spark: SparkSession) -> DataFrame:
    """ordinal, day, start_us, end_us (exclusive, a second after the last), kind, subtype."""
    rows = spark.createDataFrame([(i, day, f"{d} {s}:00", f"{d} {e}:00", k, t) for i, (day, d, s, e, k, t) in enumerate(SCHEDULE_2017)], "ordinal int, day string, s string, e string, kind string, subtype string")
    zone = "America/New_York"
    return rows.select("ordinal", "day", times.wall_us(F.col("s"), zone).alias("start_us"), (times.wall_us(F.col("e"), zone) + 1_000_000).alias("end_us"), "kind", "subtype")


def in_window(ts: Column, src: Column, dst: Column):
    """Whether a schedule's row (start_us, end_us, attackers, victims, both_ways) covers an event, both ends included."""

    def matches(w: Column) -> Column:
        there = lambda who, ip: F.array_contains(who, ip)
        a, v = w["attackers"], w["victims"]
        forward = there(a, src) & there(v, dst)
        pair = forward | (w["both_ways"] & there(v, src) & there(a, dst))
        hit = F.when((F.size(a) > 0) & (F.size(v) > 0), pair).when(F.size(a) > 0, there(a, src)).otherwise(there(v, src) | there(v, dst))
        return ts.isNotNull() & ts.between(w["start_us"], w["end_us"]) & F.coalesce(hit, F.lit(False))

    return matches


def by_schedule(events: DataFrame, schedule: DataFrame, ts: str = "ts_us", src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """events with label, attack_type: the first window of the schedule, by ordinal, that covers each."""
    out = scheduled(events, schedule, in_window(F.col(ts), F.col(src), F.col(dst)), "ordinal", ["name"], "_w_")
    return _named(out, F.col("_w_name").isNotNull(), F.col("_w_name"), "window_based").drop("_w_name")


def _named(df: DataFrame, attack: Column, name: Column, mode: str) -> DataFrame:
    return df.withColumn("label", attack.cast("int")).withColumn("attack_type", F.when(attack, name).otherwise("benign")).withColumn("labeling_mode", F.lit(mode))


def by_interval(events: DataFrame, intervals: DataFrame, day: Column, ts: str = "ts_us", src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """events with label, attack_type "Kind/Subtype": inside an interval of their day, and from an attacker or to a victim or firewall.

    What the lateral source infiltrates is a kind of its own.
    """
    inside = lambda w: (w["day"] == day) & (F.col(ts) >= w["start_us"]) & (F.col(ts) < w["end_us"])
    out = scheduled(events, intervals, inside, "ordinal", ["kind", "subtype"], "_w_")
    party = F.col(src).isin(*ATTACKERS_2017) | F.col(dst).isin(*VICTIMS_2017) | F.col(dst).isin(*FIREWALLS_2017)
    kind = F.when((F.col("_w_kind") == "Infiltration") & (F.col(src) == LATERAL_SOURCE), "LateralMovement").otherwise(F.col("_w_kind"))
    attack = F.coalesce(F.col("_w_kind").isNotNull() & party, F.lit(False))
    return _named(out, attack, F.concat(kind, F.lit("/"), F.col("_w_subtype")), "cicids2017_interval_bisect").drop("_w_kind", "_w_subtype")


TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "proto")


def truth_rows(df: DataFrame) -> DataFrame:
    """The five-tuple and time of a ground-truth table's rows; those without an address or time are left out."""
    at = F.col("ts") if "ts" in df.columns else F.col("timestamp")
    text = lambda n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))
    whole = lambda n: F.when(text(n) == "", 0).otherwise(text(n).try_cast("long"))
    rows = df.select(text("src_ip").alias("src_ip"), text("dst_ip").alias("dst_ip"), whole("src_port").alias("src_port"), whole("dst_port").alias("dst_port"), F.upper(text("proto")).alias("proto"), times.parsed_us(at).alias("ts_us"))
    return rows.where("src_ip <> '' and dst_ip <> '' and src_port is not null and dst_port is not null and ts_us is not null")


def by_truth(events: DataFrame, truth: DataFrame, tolerance_us: int = 1_000_000) -> DataFrame:
    """events with label, attack_type "backdoor" where the truth has their five-tuple at most tolerance away."""
    out = within(events, truth, TUPLE, tolerance_us)
    return _named(out, F.col("matched"), F.lit("backdoor"), "ground_truth_flow_match").drop("matched")


def all_attacks(events: DataFrame, name: str = "synthetic") -> DataFrame:
    return _named(events, F.lit(True), F.lit(name), "full_attack_dataset")


def indicators(anomalies: DataFrame, notices: DataFrame | None, detectors: int = 4, repeat_medium: int = 2, repeat_high: int = 2, repeat_low: int = 3) -> DataFrame:
    """kind, value: weak indicators of tables with label, srcIP, srcPort, dstIP, dstPort (and nbDetectors).

    Values are addresses, "address:port" and the first three parts of addresses. What repeats often enough, or is seen by enough
    detectors, has a kind of its own.
    """

    def sides(df: DataFrame) -> DataFrame:
        ip = lambda n: coerce.plain_address(F.col(n))
        side = lambda n: F.struct(ip(f"{n}IP").alias("ip"), coerce.port(F.col(f"{n}Port")).alias("port"))
        seen = F.col("nbDetectors").try_cast("double").try_cast("long") if "nbDetectors" in df.columns else F.lit(None).cast("long")
        rows = df.select(F.lower(F.trim("label")).alias("label"), seen.alias("seen"), F.explode(F.array(side("src"), side("dst"))).alias("s"))
        rows = rows.select("label", "seen", F.col("s.ip").alias("ip"), F.when(F.col("s.port").isNotNull(), F.concat("s.ip", F.lit(":"), F.col("s.port").cast("string"))).alias("ip_port")).where("ip <> ''")
        values = rows.select("label", "seen", F.explode(F.array(F.struct(F.lit("ip").alias("what"), F.col("ip").alias("value")), F.struct(F.lit("ip_port").alias("what"), F.col("ip_port").alias("value")))).alias("v"))
        return values.select("label", "seen", "v.what", "v.value").where("value is not null")

    counted = sides(anomalies).groupBy("label", "what", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("seen"))
    high, medium = counted.where("label = 'anomalous'"), counted.where("label = 'suspicious'")
    strong = (F.col("n") >= repeat_medium) | F.coalesce(F.col("seen") >= detectors, F.lit(False))
    parts = [
        high.select(F.concat(F.lit("high_"), "what").alias("kind"), "value"),
        high.where("what = 'ip'").select(F.lit("high_subnet").alias("kind"), coerce.prefix24(F.col("value")).alias("value")).where("value <> ''"),
        high.where((F.col("what") == "ip") & (F.col("n") >= repeat_high)).select(F.lit("high_freq_ip").alias("kind"), "value"),
        medium.select(F.concat(F.lit("medium_"), "what").alias("kind"), "value"),
        medium.where(strong).select(F.concat(F.lit("strong_"), "what").alias("kind"), "value"),
    ]
    if notices is not None:
        low = sides(notices).where("label = 'notice'").groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))
        parts += [low.select(F.concat(F.lit("low_"), "what").alias("kind"), "value"), low.where((F.col("what") == "ip") & (F.col("n") >= repeat_low)).select(F.lit("low_freq_ip").alias("kind"), "value")]
    return reduce(DataFrame.unionByName, parts).distinct()


#: (tier, rule, kind of indicator, facts), the first that holds; the second and third are there for their names, as the first covers them.
WEAK_RULES = (
    ("high", "high_ip", "high_ip", ("src", "dst")),
    ("high", "high_ip", "high_subnet", ("src_net", "dst_net")),
    ("high", "high_ip_port", "high_ip_port", ("src_port", "dst_port")),
    ("high", "high_ip_freq", "high_freq_ip", ("src", "dst")),
    ("medium", "medium_ip_port_strong", "strong_ip_port", ("src_port", "dst_port")),
    ("medium", "medium_ip_strong", "strong_ip", ("src", "dst")),
    ("low", "low_notice_ip_port", "low_ip_port", ("src_port", "dst_port")),
    ("low", "low_notice_ip_freq", "low_freq_ip", ("src", "dst")),
)


def by_indicators(events: DataFrame, found: DataFrame, clean: str = "balanced_clean") -> DataFrame:
    """events with tier, rule, label (1 for high and medium), attack_type and keep (by the cleaning mode)."""
    src, dst = coerce.plain_address(F.col("src_ip")), coerce.plain_address(F.col("dst_ip"))
    at = lambda ip, p: F.concat(ip, F.lit(":"), F.col(p).cast("string"))
    facts = {"src": src, "dst": dst, "src_net": coerce.prefix24(src), "dst_net": coerce.prefix24(dst), "src_port": at(src, "src_port"), "dst_port": at(dst, "dst_port")}
    out = tiered(events, found, WEAK_RULES, facts)
    removed = {"strict_clean": ("high", "medium"), "balanced_clean": ("high",), "no_clean": ()}[clean]
    out = out.withColumn("label", F.col("tier").isin("high", "medium").cast("int"))
    out = out.withColumn("attack_type", F.when(F.col("tier") == "normal", "benign").otherwise(F.concat(F.lit("mawi_"), "tier")))
    return out.withColumn("labeling_mode", F.lit("mawi_weak_supervision")).withColumn("keep", ~F.col("tier").isin(*removed) if removed else F.lit(True))


def involvement(events: DataFrame, schedule: DataFrame, ts: str = "ts_us", src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """events with involved: whether an attacker of a window that covers their time is on either side."""
    covers = lambda w: F.col(ts).between(w["start_us"], w["end_us"]) & (F.array_contains(w["attackers"], F.col(src)) | F.array_contains(w["attackers"], F.col(dst)))
    out = scheduled(events, schedule, covers, "ordinal", ["name"], "_w_")
    return out.withColumn("involved", F.col("_w_name").isNotNull()).drop("_w_name")


def for_date(schedule: DataFrame, path: Column) -> DataFrame:
    """The windows that begin on the date in a path; all of them where it has none."""
    day = times.path_date(path)
    return schedule.where(day.isNull() | (F.to_date(F.timestamp_micros("start_us")) == day))


def truth_key(day: Column, flow_id: Column, src: Column, sport: Column, dst: Column, dport: Column, proto: Column, ts_us: Column) -> Column:
    """The key of a label table's row: "day-id", or the five-tuple and whole second."""
    second = F.floor(F.coalesce(ts_us, F.lit(0)) / 1_000_000).cast("string")
    return F.when(flow_id.isNotNull(), F.concat(day, F.lit("-"), flow_id)).otherwise(F.concat(src, F.lit(":"), sport.cast("string"), F.lit("-"), dst, F.lit(":"), dport.cast("string"), F.lit("-"), proto, F.lit("-"), second))
