"""The operators as queries over the driver's tables, each with independent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import coerce, decisions, identity, network, stats, times
from weirflow.operators import aggregates, context, features, joins, labeling, sampling, sets, windows
from weirflow.plans import pipelines
from weirflow.sources import eve
from weirflow.sources.scratch import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000
#: Columns are rounded where sums of doubles may differ in their last bits.
DIGITS = 6


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), DIGITS) for n in names})


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as seq, ts_us, user_id, event_type, value, k."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(F.col("event_id").alias("seq"), us.alias("ts_us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


E_SQL = "e AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"

# --- windows -----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {E_SQL}
SELECT a.seq, count(b.seq) FILTER (WHERE b.ts_us >= a.ts_us - {DAY}) AS n_1d, count(b.seq) AS n_3d,
       CAST(coalesce(sum(b.k) FILTER (WHERE b.ts_us >= a.ts_us - {DAY}), 0) AS BIGINT) AS sum_1d,
       round((count(b.seq) FILTER (WHERE b.ts_us >= a.ts_us - {DAY})) / (count(b.seq) / 3.0 + 1e-6), 6) AS rate_ratio
FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.ts_us BETWEEN a.ts_us - {3 * DAY} AND a.ts_us AND b.seq < a.seq
GROUP BY a.seq
""")
def prior_window_events(spark, sf_dir):
    """Counts and sums of the day and three days before each event of a user."""
    keys = ("user_id",)
    out = windows.with_prior(event_rows(spark, sf_dir), {"n_1d": (F.lit(1), keys, DAY), "n_3d": (F.lit(1), keys, 3 * DAY), "sum_1d": (F.col("k"), keys, DAY)})
    return rounded(out.select("seq", "n_1d", "n_3d", "sum_1d", (F.col("n_1d") / (F.col("n_3d") / 3 + 1e-6)).alias("rate_ratio")), "rate_ratio")


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
    seq = ((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    return li.select(seq.alias("seq"), us.alias("ts_us"), "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), "l_returnflag")


@query(f"""
WITH l AS (SELECT ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS seq, epoch_us(l_shipdate) AS ts_us, l_suppkey, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)
SELECT a.seq, count(b.seq) AS n_30d, CAST(coalesce(sum(b.qty), 0) AS BIGINT) AS qty_30d
FROM l a LEFT JOIN l b ON b.l_suppkey = a.l_suppkey AND b.ts_us >= a.ts_us - {30 * DAY} AND (b.ts_us < a.ts_us OR b.ts_us = a.ts_us AND b.seq < a.seq)
GROUP BY a.seq
""")
def prior_window_ties(spark, sf_dir):
    """The 30 days before each line of a supplier, where many lines share a date."""
    keys = ("l_suppkey",)
    out = windows.with_prior(_lines(spark, sf_dir), {"n_30d": (F.lit(1), keys, 30 * DAY), "qty_30d": (F.col("qty"), keys, 30 * DAY)})
    return out.select("seq", "n_30d", "qty_30d")


@query(f"""
WITH {E_SQL}
SELECT a.seq, count(DISTINCT b.event_type) AS types_3d, count(DISTINCT b.k) AS ks_3d
FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.ts_us BETWEEN a.ts_us - {3 * DAY} AND a.ts_us AND b.seq < a.seq
GROUP BY a.seq
""")
def prior_distinct_events(spark, sf_dir):
    """Distinct values of the three days before each event, by running sums."""
    e = event_rows(spark, sf_dir)
    out = windows.prior_distinct(e, "types_3d", "event_type", ["user_id"], 3 * DAY)
    out = windows.prior_distinct(out, "ks_3d", "k", ["user_id"], 3 * DAY)
    return out.select("seq", F.col("types_3d").cast("long").alias("types_3d"), F.col("ks_3d").cast("long").alias("ks_3d"))


@query(f"""
WITH l AS (SELECT ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS seq, epoch_us(l_shipdate) AS ts_us, l_suppkey, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)
SELECT a.seq, count(DISTINCT b.qty) AS quantities
FROM l a LEFT JOIN l b ON b.l_suppkey = a.l_suppkey AND b.ts_us >= a.ts_us - {30 * DAY} AND (b.ts_us < a.ts_us OR b.ts_us = a.ts_us AND b.seq < a.seq)
GROUP BY a.seq
""")
def prior_distinct_ties(spark, sf_dir):
    out = windows.prior_distinct(_lines(spark, sf_dir), "quantities", "qty", ["l_suppkey"], 30 * DAY)
    return out.select("seq", F.col("quantities").cast("long").alias("quantities"))


@query(f"""
WITH {E_SQL},
p AS (SELECT a.seq, b.event_type, count(*) AS c, min(b.seq) AS first FROM e a JOIN e b ON b.user_id = a.user_id AND b.ts_us BETWEEN a.ts_us - {7 * DAY} AND a.ts_us AND b.seq < a.seq GROUP BY ALL),
t AS (SELECT seq, sum(c) AS n FROM p GROUP BY seq),
h AS (SELECT p.seq, -sum((c / n) * log2(c / n + 1e-6)) AS entropy, max(c) / max(n) AS top, arg_max(event_type, struct_pack(c := c, f := -first)) AS mode FROM p JOIN t USING (seq) GROUP BY p.seq)
SELECT e.seq, round(coalesce(entropy, 0.0), 6) AS entropy, round(coalesce(top, 0.0), 6) AS top, coalesce(mode, '') AS mode FROM e LEFT JOIN h USING (seq)
""")
def prior_entropy_events(spark, sf_dir):
    """Entropy, most frequent value and its share in the week before each event."""
    held = windows.prior_list(F.col("event_type"), ["user_id"], 7 * DAY)
    out = event_rows(spark, sf_dir).withColumn("held", held)
    n = F.size("held")
    top = F.when(n > 0, F.array_max(stats.value_counts(F.col("held"))) / n).otherwise(0.0)
    return rounded(out.select("seq", stats.entropy(F.col("held")).alias("entropy"), top.alias("top"), F.coalesce(stats.first_mode(F.col("held")), F.lit("")).alias("mode")), "entropy", "top")


@query(f"""
WITH {E_SQL},
p AS (SELECT a.seq, b.ts_us / 1e6 AS t, lag(b.ts_us / 1e6) OVER (PARTITION BY a.seq ORDER BY b.ts_us) AS prev FROM e a JOIN e b ON b.user_id = a.user_id AND b.ts_us BETWEEN a.ts_us - {5 * DAY} AND a.ts_us AND b.seq < a.seq),
g AS (SELECT seq, t - prev AS gap, lag(t - prev) OVER (PARTITION BY seq ORDER BY t) AS before FROM p WHERE prev IS NOT NULL),
s AS (SELECT seq, count(*) AS n, stddev_pop(gap) / (avg(gap) + 1e-6) AS cv, corr(gap, before) AS ac FROM g GROUP BY seq)
SELECT e.seq, round(coalesce(cv, 0.0), 5) AS gap_cv, round(CASE WHEN n >= 4 THEN coalesce(ac, 0.0) ELSE 0.0 END, 5) AS gap_autocorr FROM e LEFT JOIN s USING (seq)
""")
def prior_gaps_events(spark, sf_dir):
    """Variation and autocorrelation of the gaps between the events of the five days before."""
    held = windows.prior_list(F.col("ts_us") / 1e6, ["user_id"], 5 * DAY)
    out = event_rows(spark, sf_dir).withColumn("gaps", stats.gaps(held))
    ac = F.when(F.size("gaps") >= 4, stats.autocorrelation(F.col("gaps"))).otherwise(0.0)
    return out.select("seq", F.round(stats.variation(F.col("gaps")), 5).alias("gap_cv"), F.round(ac, 5).alias("gap_autocorr"))


# --- flows: the events table as an event log, thirty days of it pressed into a quarter of an hour ----------------------------------

PRESS, START = 3000, 1_704_067_200_000_000
#: Ports of the event types in that log.
PORTS = {"click": 80, "view": 443, "signup": 22, "purchase": 53, "error": 8080}


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, value: a log line of JSON for each event."""
    e = event_rows(spark, sf_dir)
    at = (F.col("ts_us") - START).cast("long")
    at = F.floor(at / PRESS) + START
    iso = F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(F.timestamp_micros(at), F.current_timezone()), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX")
    port = F.lit(0)
    for name, number in PORTS.items():
        port = F.when(F.col("event_type") == name, number).otherwise(port)
    is_ = lambda *n: F.col("event_type").isin(*n)
    tcp = F.when(is_("signup"), None).when(is_("purchase"), F.struct(F.lit(None).cast("boolean").alias("syn"), F.lit(None).cast("boolean").alias("ack"), F.lit(None).cast("boolean").alias("rst")))
    tcp = tcp.otherwise(F.struct(is_("click", "view").alias("syn"), is_("view", "error").alias("ack"), is_("error").alias("rst")))
    flow = F.struct(iso.alias("start"), (F.pmod("seq", F.lit(50)) / 10).alias("age"), F.floor(F.col("value") * 2).cast("long").alias("bytes_toserver"), F.pmod(F.col("k") * 7, F.lit(300)).alias("bytes_toclient"), (F.pmod("k", F.lit(5)) + 1).alias("pkts_toserver"), F.pmod("k", F.lit(3)).alias("pkts_toclient"))
    body = F.struct(iso.alias("timestamp"), F.lit("flow").alias("event_type"), F.concat(F.lit("f"), F.col("seq").cast("string")).alias("flow_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"), F.lit(40000).alias("src_port"), F.concat(F.lit("h"), F.pmod("k", F.lit(20)).cast("string")).alias("dest_ip"), port.alias("dest_port"), F.lit("tcp").alias("proto"), flow.alias("flow"), tcp.alias("tcp"))
    # As if it had been read: a generator of one row, so that filters on the line do not write it again.
    return e.select("seq", F.explode(F.array(F.to_json(body))).alias("value"))


def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eve.to_flows(eve.parsed(event_lines(spark, sf_dir), ("flow",)))


FLOW_SQL = f"""{E_SQL},
f AS (SELECT seq, (ts_us - {START}) // {PRESS} + {START} AS ts_us, 'u' || user_id AS src_ip, 'h' || (k % 20) AS dst_ip,
      CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'signup' THEN 22 WHEN 'purchase' THEN 53 ELSE 8080 END AS dst_port,
      (seq % 50) / 10.0 AS duration, CAST(floor(value * 2) AS BIGINT) AS fwd, (k * 7) % 300 AS rev, k % 5 + 1 AS fwd_pkts, k % 3 AS rev_pkts,
      CAST(event_type IN ('click', 'view') AS INT) AS syn, CAST(event_type IN ('view', 'error') AS INT) AS ack, CAST(event_type = 'error' AS INT) AS rst,
      CAST(event_type <> 'signup' AS INT) AS has_tcp FROM e)"""


@query(f"""
WITH {FLOW_SQL}
SELECT seq, ts_us, 'f' || seq AS flow_id, src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, CAST(duration AS DOUBLE) AS duration, fwd AS fwd_bytes, rev AS rev_bytes, fwd + rev AS total_bytes,
       CAST(syn AS BIGINT) AS syn, CAST(ack AS BIGINT) AS ack, CAST(rst AS BIGINT) AS rst, CAST(CASE WHEN has_tcp = 0 THEN 0 ELSE greatest(1, syn + ack + rst) END AS BIGINT) AS tcp_pkts, CAST(has_tcp AS BIGINT) AS has_tcp,
       src_ip || ':40000-' || dst_ip || ':' || dst_port || '-TCP_' || CAST(ts_us // 5000000 AS VARCHAR) AS flow_key
FROM f
""")
def flows(spark, sf_dir):
    """Typed flows from JSON lines."""
    names = ["seq", "ts_us", "flow_id", "src_ip", "dst_ip", "dst_port", "duration", "fwd_bytes", "rev_bytes", "total_bytes", "syn", "ack", "rst", "tcp_pkts"]
    return flow_rows(spark, sf_dir).select(*names, F.col("has_tcp").cast("long").alias("has_tcp"), "flow_key")


@query(f"""
WITH {FLOW_SQL},
s AS (SELECT a.seq, count(b.seq) AS n300, count(b.seq) FILTER (WHERE b.ts_us >= a.ts_us - 60000000) AS n60, count(b.seq) FILTER (WHERE b.ts_us >= a.ts_us - 10000000) AS n10,
        count(DISTINCT b.dst_ip) AS dsts, count(DISTINCT b.dst_port) AS ports, count(DISTINCT (b.dst_ip, b.dst_port)) FILTER (WHERE b.seq IS NOT NULL) AS pairs,
        count(b.seq) FILTER (WHERE b.ts_us >= a.ts_us - 10000000 AND a.ts_us <= b.ts_us + b.duration * 1000000) AS active,
        coalesce(sum(b.syn) FILTER (WHERE b.ts_us >= a.ts_us - 60000000), 0) AS syn60, coalesce(sum(b.ack) FILTER (WHERE b.ts_us >= a.ts_us - 60000000), 0) AS ack60,
        count(b.seq) FILTER (WHERE b.duration < 1) AS short300, coalesce(sum(b.fwd + b.rev), 0) AS bytes300
      FROM f a LEFT JOIN f b ON b.src_ip = a.src_ip AND b.ts_us BETWEEN a.ts_us - 300000000 AND a.ts_us AND b.seq < a.seq GROUP BY a.seq),
d AS (SELECT a.seq, count(b.seq) AS n60, count(DISTINCT b.src_ip) AS srcs60, count(b.seq) FILTER (WHERE b.src_ip = a.src_ip) AS mine
      FROM f a LEFT JOIN f b ON b.dst_ip = a.dst_ip AND b.ts_us BETWEEN a.ts_us - 60000000 AND a.ts_us AND b.seq < a.seq GROUP BY a.seq),
p AS (SELECT a.seq, count(b.seq) AS n, coalesce(sum(b.fwd + b.rev), 0) AS bytes FROM f a LEFT JOIN f b ON b.src_ip = a.src_ip AND b.dst_ip = a.dst_ip AND b.seq < a.seq GROUP BY a.seq),
t AS (SELECT a.seq, count(b.seq) AS n FROM f a LEFT JOIN f b ON b.src_ip = a.src_ip AND b.seq < a.seq GROUP BY a.seq)
SELECT s.seq, round(s.n10 / 10, 6) AS flow_rate_src_10s, round((s.n60 / 60) / (s.n300 / 300 + 1e-6), 6) AS rate_ratio_src_60s_300s, CAST(s.active AS DOUBLE) AS concurrent_flows_src_10s,
       CAST(d.srcs60 AS DOUBLE) AS unique_src_ips_by_dst_60s, round(CASE WHEN s.n300 > 1 THEN s.dsts / s.n300 ELSE 0 END, 6) AS new_dst_ip_ratio_src_300s, round(CASE WHEN s.n300 > 1 THEN s.ports / 300 ELSE 0 END, 6) AS new_dst_ports_per_sec,
       round((s.n300 - s.pairs) / (s.n300 + 1e-6), 6) AS retry_rate_same_dstport_300s, round(s.syn60 / (s.ack60 + 1e-6), 4) AS syn_to_established_ratio, round(s.short300 / (s.n300 + 1e-6), 6) AS short_flow_ratio_src_300s,
       round(s.bytes300 / (s.n300 + 1e-6), 4) AS avg_bytes_per_flow_src_300s, round(p.bytes / (p.n + 1e-6), 4) AS bytes_per_flow_srcdst, round(p.n / (t.n + 1e-6), 6) AS connection_reuse_ratio_srcdst, round(d.mine / (d.n60 + 1e-6), 6) AS src_contribution_to_dst_ratio_60s
FROM s JOIN d USING (seq) JOIN p USING (seq) JOIN t USING (seq)
""")
def flow_features(spark, sf_dir):
    """Features of flows that self-joins can check; the others are checked against a simulation in the tests."""
    six = ["flow_rate_src_10s", "rate_ratio_src_60s_300s", "concurrent_flows_src_10s", "unique_src_ips_by_dst_60s", "new_dst_ip_ratio_src_300s", "new_dst_ports_per_sec", "retry_rate_same_dstport_300s", "short_flow_ratio_src_300s", "connection_reuse_ratio_srcdst", "src_contribution_to_dst_ratio_60s"]
    four = ["syn_to_established_ratio", "avg_bytes_per_flow_src_300s", "bytes_per_flow_srcdst"]
    out = features.features(flow_rows(spark, sf_dir))
    return out.select("seq", *[F.round(n, 6).alias(n) for n in six], *[F.round(n, 4).alias(n) for n in four])


def label_rows(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """Labels of the flows of all events (or of those which chooses), the multiples of 15 labelled twice."""
    e = event_rows(spark, sf_dir).where(which)
    first = e.select(F.concat(F.lit("f"), F.col("seq").cast("string")).alias("identity_key"), (F.col("event_type") == "error").cast("int").alias("binary_label"), F.col("event_type").alias("attack_subclass"), "seq")
    again = e.where("seq % 15 = 0").select(F.concat(F.lit("f"), F.col("seq").cast("string")).alias("identity_key"), F.lit(1).alias("binary_label"), F.lit("again").alias("attack_subclass"), (F.col("seq") + 10_000_000_000).alias("seq"))
    return first.unionByName(again)


#: Where keys without a label are what a query is about, only every third event has one.
PARTLY = "seq % 3 = 0"


@query(f"""
WITH {E_SQL}
SELECT seq, CAST(CASE WHEN seq % 15 = 0 THEN 1 ELSE CAST(event_type = 'error' AS INT) END AS BIGINT) AS binary_label, CASE WHEN seq % 15 = 0 THEN 'again' ELSE event_type END AS attack_subclass FROM e WHERE seq % 3 = 0
""")
def label_join(spark, sf_dir):
    """Flows with the last label of their key."""
    out = joins.labelled(flow_rows(spark, sf_dir).withColumnRenamed("seq", "flow_seq"), label_rows(spark, sf_dir, PARTLY))
    return out.select(F.col("flow_seq").alias("seq"), F.col("binary_label").cast("long").alias("binary_label"), "attack_subclass")


@query(f"""
WITH {E_SQL}, k AS (SELECT DISTINCT seq FROM e WHERE seq % 3 = 0 UNION SELECT DISTINCT -doc_id - 1 FROM labels)
SELECT count(*) FILTER (WHERE k.seq >= 0) AS matched, count(*) AS label_keys, round(count(*) FILTER (WHERE k.seq >= 0) / count(*), 6) AS ratio FROM k
""")
def label_coverage(spark, sf_dir):
    other = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("identity_key"))
    return rounded(joins.coverage(flow_rows(spark, sf_dir), label_rows(spark, sf_dir, PARTLY).select("identity_key").unionByName(other)), "ratio")


@query("""
SELECT identity_key FROM (SELECT DISTINCT 'f' || event_id AS identity_key FROM events WHERE event_id % 3 <> 0) ORDER BY identity_key LIMIT 100
""")
def unmatched_keys(spark, sf_dir):
    return joins.unmatched(flow_rows(spark, sf_dir), label_rows(spark, sf_dir, PARTLY))


@query("""
SELECT count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE a AND NOT b) AS only_train, count(*) FILTER (WHERE b AND NOT a) AS only_test
FROM (SELECT o_custkey, bool_or(o_orderkey % 5 <> 0) AS a, bool_or(o_orderkey % 5 = 0) AS b FROM orders GROUP BY o_custkey)
""")
def key_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return joins.overlap(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), "o_custkey")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_documents(spark, sf_dir):
    return joins.restored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "n_chars")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join_customers(spark, sf_dir):
    return joins.not_chosen(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey").select(F.col("o_custkey").alias("c_custkey"), "c_mktsegment")


#: A schedule over users and hosts of the event log (ordinal, name, start second, end second, attackers, victims, both ways).
SCHEDULE = (
    (0, "burst", 60, 200, ["u3", "u4", "u5"], ["h1", "h2", "h3"], False),
    (1, "tunnel", 150, 500, ["u5", "u6"], ["h3", "h4"], True),
    (2, "scan", 100, 700, ["u1", "u2", "u3", "u7"], [], False),
)


def _schedule(spark: SparkSession) -> DataFrame:
    rows = [(o, n, START + s * 1_000_000, START + e * 1_000_000, a, v, b) for o, n, s, e, a, v, b in SCHEDULE]
    return spark.createDataFrame(rows, "ordinal int, name string, start_us long, end_us long, attackers array<string>, victims array<string>, both_ways boolean")


_S = START
_SCHEDULE_SQL = ", ".join(f"({o}, '{n}', {_S + s * 1_000_000}, {_S + e * 1_000_000}, {a}, {v if v else 'CAST([] AS VARCHAR[])'}, {str(b).lower()})" for o, n, s, e, a, v, b in SCHEDULE)


@query(f"""
WITH {FLOW_SQL}, w(ordinal, name, s, e2, attackers, victims, both_ways) AS (VALUES {_SCHEDULE_SQL}),
m AS (SELECT f.seq, arg_min(w.name, w.ordinal) AS name FROM f JOIN w ON f.ts_us BETWEEN w.s AND w.e2 AND (
        (len(victims) > 0 AND (list_contains(attackers, src_ip) AND list_contains(victims, dst_ip) OR both_ways AND list_contains(victims, src_ip) AND list_contains(attackers, dst_ip)))
        OR (len(victims) = 0 AND list_contains(attackers, src_ip))) GROUP BY f.seq)
SELECT f.seq, CAST(m.name IS NOT NULL AS INT) AS label, coalesce(m.name, 'benign') AS attack_type FROM f LEFT JOIN m USING (seq)
""")
def schedule_labels(spark, sf_dir):
    """The first window of a schedule that covers each flow."""
    return labeling.by_schedule(flow_rows(spark, sf_dir), _schedule(spark)).select("seq", "label", "attack_type")


@query(f"""
WITH {FLOW_SQL}, w(ordinal, name, s, e2, attackers, victims, both_ways) AS (VALUES {_SCHEDULE_SQL})
SELECT count(*) AS n FROM f WHERE EXISTS (SELECT 1 FROM w WHERE f.ts_us BETWEEN s AND e2 AND (list_contains(attackers, src_ip) OR list_contains(attackers, dst_ip)))
""")
def attacker_involvement(spark, sf_dir):
    return labeling.involvement(flow_rows(spark, sf_dir), _schedule(spark)).where("involved").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w(ordinal, kind, s, e) AS (VALUES (0, 'A', DATE '1996-01-01', DATE '1996-07-01'), (1, 'B', DATE '1996-07-01', DATE '1996-09-01'), (2, 'C', DATE '1998-01-01', DATE '1999-01-01'))
SELECT o_orderkey, coalesce((SELECT kind FROM w WHERE o_orderdate >= s AND o_orderdate < e), 'none') AS kind FROM orders
""")
def interval_lookup(spark, sf_dir):
    """Orders by disjoint intervals of time, starts included and ends not."""
    w = spark.createDataFrame([(0, "A", "1996-01-01", "1996-07-01"), (1, "B", "1996-07-01", "1996-09-01"), (2, "C", "1998-01-01", "1999-01-01")], "ordinal int, kind string, s string, e string")
    day = F.col("o_orderdate").cast("date").cast("string")
    out = joins.scheduled(table(spark, sf_dir, "orders"), w, lambda x: (day >= x["s"]) & (day < x["e"]), "ordinal", ["kind"])
    return out.select("o_orderkey", F.coalesce("kind", F.lit("none")).alias("kind"))


@query(f"""
WITH {E_SQL}
SELECT a.seq, CASE WHEN a.ts_us - b.ts_us <= {2 * DAY} THEN b.k END AS last_k FROM (SELECT * FROM e WHERE event_type <> 'purchase') a
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts_us >= b.ts_us
""")
def as_of_join(spark, sf_dir):
    """The user's last purchase before each other event, if not older than two days."""
    e = event_rows(spark, sf_dir)
    facts = e.where("event_type = 'purchase'").select("user_id", "ts_us", "seq", F.col("k").alias("last_k"))
    return joins.as_of(e.where("event_type <> 'purchase'"), facts, ["user_id"], ["last_k"], 2 * DAY).select("seq", "last_k")


@query(f"""
WITH {E_SQL}
SELECT a.seq, EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND abs(b.ts_us - a.ts_us) <= {DAY // 8}) AS matched FROM e a WHERE a.event_type = 'click'
""")
def tolerance_join(spark, sf_dir):
    """Clicks with an error of the same user at most three hours away."""
    e = event_rows(spark, sf_dir)
    return joins.within(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"], DAY // 8).select("seq", "matched")


@query("""
WITH n AS (SELECT o_custkey AS c, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, max(o_totalprice) AS most FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN f >= 8 THEN 'high' WHEN p >= 6 THEN 'medium' WHEN most > 490000 THEN 'low' ELSE 'normal' END AS tier,
       CASE WHEN f >= 8 THEN 'many_f' WHEN p >= 6 THEN 'many_p' WHEN most > 490000 THEN 'dear' ELSE 'none' END AS rule
FROM customer LEFT JOIN n ON c = c_custkey
""")
def indicator_tiers(spark, sf_dir):
    """Customers by the first of several indicators that names them."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("value")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.max("o_totalprice").alias("most"))
    kinds = F.array(F.when(F.col("f") >= 8, "f"), F.when(F.col("p") >= 6, "p"), F.when(F.col("most") > 490000, "dear"))
    found = n.select("value", F.explode(F.array_compact(kinds)).alias("kind"))
    rules = (("high", "many_f", "f", ("c",)), ("medium", "many_p", "p", ("c",)), ("low", "dear", "dear", ("c",)))
    return joins.tiered(table(spark, sf_dir, "customer"), found, rules, {"c": F.col("c_custkey").cast("string")}).select("c_custkey", "tier", "rule")


@query("""
WITH s AS (SELECT 'c' || l_partkey % 200 AS src, 'd' || l_suppkey AS dst, l_returnflag AS f FROM lineitem),
v AS (SELECT f, src AS ip FROM s UNION ALL SELECT f, dst FROM s), c AS (SELECT f, ip, count(*) AS n FROM v GROUP BY ALL)
SELECT 'anomalous' AS label, count(*) AS n, count(*) FILTER (WHERE n >= 400) AS repeated FROM c WHERE f = 'R'
""")
def repeated_indicators(spark, sf_dir):
    """Addresses of weak labels, and those that repeat often enough."""
    li = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "anomalous").when(F.col("l_returnflag") == "A", "suspicious").otherwise("other")
    rows = li.select(label.alias("label"), F.concat(F.lit("c"), F.pmod("l_partkey", F.lit(200)).cast("string")).alias("srcIP"), F.lit("").alias("srcPort"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("dstIP"), F.lit("").alias("dstPort"))
    out = labeling.indicators(rows, None, repeat_high=400)
    return out.where("kind in ('high_ip', 'high_freq_ip')").agg(F.first(F.lit("anomalous")).alias("label"), F.count_if(F.col("kind") == "high_ip").alias("n"), F.count_if(F.col("kind") == "high_freq_ip").alias("repeated"))


# --- aggregates ------------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 30")
def type_counts(spark, sf_dir):
    return aggregates.counts(table(spark, sf_dir, "events"), "event_type", most=30)


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE value > 100) AS n_large,
       round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS pct_error, round(100.0 * count(*) FILTER (WHERE value > 100) / count(*), 6) AS pct_large FROM events
""")
def condition_shares(spark, sf_dir):
    return rounded(aggregates.shares(table(spark, sf_dir, "events"), error=F.col("event_type") == "error", large=F.col("value") > 100), "pct_error", "pct_large")


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")
def label_distribution(spark, sf_dir):
    return rounded(aggregates.distribution(table(spark, sf_dir, "documents"), ["lang"], "source"), "share")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 70")
def frequent_keys(spark, sf_dir):
    return aggregates.frequent(table(spark, sf_dir, "events"), "user_id", 70)


@query("SELECT l_orderkey, min(l_returnflag) AS low, max(l_returnflag) AS high, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def label_conflicts(spark, sf_dir):
    return aggregates.conflicts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS rows_in_repeats, max(n) AS max_per_key FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def key_audit(spark, sf_dir):
    return aggregates.key_audit(table(spark, sf_dir, "lineitem"), "l_orderkey")


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, l_returnflag AS flag, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem" for c in NUMBERS) + ")"


@query(f"""
WITH {_LONG} SELECT feature, count(*) AS n, CAST(0 AS BIGINT) AS n_not_finite, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation, round(avg(CAST(value <> 0 AS INT)), 6) AS nonzero,
       min(value) = max(value) AS constant, min(value) = 0 AND max(value) = 0 AS all_zero FROM l GROUP BY 1
""")
def feature_health(spark, sf_dir):
    out = aggregates.feature_health(table(spark, sf_dir, "lineitem"), NUMBERS)
    return rounded(out.withColumn("mean", F.round("mean", 4)).withColumn("deviation", F.round("deviation", 4)), "nonzero")


@query(f"WITH {_LONG} SELECT feature, count(DISTINCT value) AS n_unique, round(count(DISTINCT value) / count(*), 6) AS ratio, count(DISTINCT value) / count(*) > 0.9 AS suspicious FROM l GROUP BY 1")
def uniqueness(spark, sf_dir):
    return rounded(aggregates.uniqueness(table(spark, sf_dir, "lineitem"), NUMBERS), "ratio")


@query(f"WITH {_LONG} SELECT feature, flag AS l_returnflag, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS deviation, count(value) AS n FROM l GROUP BY 1, 2")
def separability(spark, sf_dir):
    out = aggregates.separability(table(spark, sf_dir, "lineitem"), NUMBERS, "l_returnflag")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("deviation", F.round("deviation", 4))


@query(f"WITH {_LONG} SELECT feature, round(corr(value, label), 6) AS correlation, abs(corr(value, label)) > 0.9 AS suspicious FROM l GROUP BY 1")
def label_correlation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(aggregates.label_correlation(li, NUMBERS, "label"), "correlation")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlations(spark, sf_dir):
    return rounded(aggregates.correlations(table(spark, sf_dir, "lineitem"), NUMBERS), "correlation")


@query("""
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(19, floor((o_totalprice - lo) / (hi - lo) * 20)) AS INT) AS bin, count(*) AS n FROM orders, b GROUP BY 1
""")
def histogram(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20)


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def exact_duplicates(spark, sf_dir):
    return aggregates.exact_duplicates(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("""
SELECT count(*) AS n_shared FROM (SELECT DISTINCT round(l_discount, 6) AS d, round(l_quantity, 6) AS q FROM lineitem WHERE l_orderkey % 5 <> 0 INTERSECT SELECT DISTINCT round(l_discount, 6), round(l_quantity, 6) FROM lineitem WHERE l_orderkey % 5 = 0)
""")
def near_overlap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return aggregates.near_overlap(li.where("l_orderkey % 5 <> 0"), li.where("l_orderkey % 5 = 0"), ["l_discount", "l_quantity"])


@query("""
WITH n AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS a, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, round(a / sum(a) OVER (), 6) AS train, round(b / sum(b) OVER (), 6) AS test, round(abs(a / sum(a) OVER () - b / sum(b) OVER ()), 6) AS delta FROM n
""")
def class_balance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(aggregates.balance(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), "o_orderpriority"), "train", "test", "delta")


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a probability and an anomaly that their event's number gives."""
    f = flow_rows(spark, sf_dir)
    return f.withColumn("probability", F.pmod(F.col("seq") * 37, F.lit(1000)) / 1000).withColumn("anomaly", F.pmod(F.col("seq") * 91, F.lit(997)) / 997).withColumn("label", (F.pmod(F.col("seq") * 37 + F.pmod("seq", F.lit(7)) * 60, F.lit(1400)) > 600).cast("int"))


_SCORED = """s AS (SELECT *, (seq * 37) % 1000 / 1000 AS probability, (seq * 91) % 997 / 997 AS anomaly, CAST((seq * 37 + seq % 7 * 60) % 1400 > 600 AS INT) AS label FROM f),
d AS (SELECT *, CASE WHEN anomaly >= 0.8 OR probability >= 0.7 THEN 'HIGH' WHEN probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS decision FROM s)"""


@query(f"""
WITH {FLOW_SQL}, {_SCORED}
SELECT seq, round(probability, 6) AS risk, decision, CASE decision WHEN 'HIGH' THEN 'BLOCK' WHEN 'MEDIUM' THEN 'ALERT' ELSE 'ALLOW' END AS action FROM d
""")
def tier_decisions(spark, sf_dir):
    return rounded(pipelines.decided(scored_rows(spark, sf_dir)).select("seq", "risk", "decision", "action"), "risk")


@query(f"""
WITH {FLOW_SQL}, {_SCORED},
r AS (SELECT seq, least(1, greatest(0, 0.4 * anomaly + 0.4 * probability)) AS risk, probability, 0.3 - anomaly AS raw FROM s),
t AS (SELECT *, CASE WHEN probability >= 0.7 THEN greatest(risk, 0.6) ELSE risk END AS adjusted, CASE WHEN probability >= 0.7 OR risk >= 0.6 THEN 3 WHEN risk >= 0.3 THEN 2 ELSE 1 END AS own, CASE WHEN probability > 0.9 THEN 3 WHEN raw < -0.12 THEN 2 ELSE 1 END AS hybrid FROM r)
SELECT seq, round(adjusted, 6) AS risk, CASE greatest(own, hybrid) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS decision FROM t
""")
def blended_decisions(spark, sf_dir):
    """The weighted score with the hybrid rule."""
    s = scored_rows(spark, sf_dir)
    risk, tier = decisions.blended(F.col("anomaly"), F.col("probability"), None, F.lit(0.3) - F.col("anomaly"), F.col("probability"))
    return rounded(s.select("seq", risk.alias("risk"), tier.alias("decision")), "risk")


@query(f"""
WITH {FLOW_SQL}, {_SCORED}
SELECT count(*) AS total_processed, count(*) FILTER (WHERE decision = 'LOW') AS count_low, count(*) FILTER (WHERE decision = 'MEDIUM') AS count_medium, count(*) FILTER (WHERE decision = 'HIGH') AS count_high,
       round(sum(probability), 3) AS sum_risk, round(max(probability), 6) AS max_risk, round(avg(probability), 6) AS avg_risk FROM d
""")
def run_summary(spark, sf_dir):
    out = aggregates.run_summary(pipelines.decided(scored_rows(spark, sf_dir)))
    return rounded(out.withColumn("sum_risk", F.round("sum_risk", 3)), "max_risk", "avg_risk")


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND decision = 'HIGH') AS tp, count(*) FILTER (WHERE label = 0 AND decision = 'HIGH') AS fp, count(*) FILTER (WHERE label = 0 AND decision <> 'HIGH') AS tn, count(*) FILTER (WHERE label = 1 AND decision <> 'HIGH') AS fn FROM d)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""")
def confusion(spark, sf_dir):
    d = pipelines.decided(scored_rows(spark, sf_dir)).withColumn("p", (F.col("decision") == "HIGH").cast("int"))
    return rounded(aggregates.confusion(d, "label", "p"), "accuracy", "fpr", "precision", "recall", "f1")


@query("""
WITH p AS (SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 4 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS g FROM orders), l AS (SELECT DISTINCT a AS label FROM p UNION SELECT g FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE a = label) AS support, (SELECT count(*) FROM p WHERE g = label) AS guessed, (SELECT count(*) FROM p WHERE a = label AND g = label) AS ok FROM l)
SELECT label, round(ok / guessed, 6) AS precision, round(ok / support, 6) AS recall, round(2 * (ok / guessed) * (ok / support) / (ok / guessed + ok / support), 6) AS f1, support FROM c
""")
def class_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("g", F.when(F.col("o_orderkey") % 4 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")))
    return rounded(aggregates.class_report(o, "o_orderpriority", "g"), "precision", "recall", "f1")


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, g AS (SELECT probability AS p, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1), r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r
""")
def area_under_curve(spark, sf_dir):
    return rounded(aggregates.roc_auc(scored_rows(spark, sf_dir), "label", "probability"), "auc")


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, c AS (SELECT unnest(quantile_cont(probability, [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95])) AS cut FROM s),
m AS (SELECT cut, count(*) FILTER (WHERE label = 1 AND probability >= cut) AS tp, count(*) FILTER (WHERE label = 0 AND probability >= cut) AS fp, count(*) FILTER (WHERE label = 1) AS a FROM s, c GROUP BY 1),
b AS (SELECT 2 * tp / (tp + fp + a) AS f1, cut, tp / a AS recall FROM m)
SELECT round(cut, 6) AS threshold, round(f1, 6) AS f1, round(recall, 6) AS recall FROM b ORDER BY b.f1 DESC, cut DESC LIMIT 1
""")
def best_threshold(spark, sf_dir):
    return rounded(aggregates.best_threshold(scored_rows(spark, sf_dir), "label", "probability"), "threshold", "f1", "recall")


@query(f"""
WITH {FLOW_SQL}, {_SCORED}
SELECT CAST(label AS INT) AS label, count(*) AS n, round(avg(probability), 6) AS mean, round(min(probability), 6) AS low, round(max(probability), 6) AS high, count(*) FILTER (WHERE decision = 'LOW') AS n_low, count(*) FILTER (WHERE decision = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE decision = 'HIGH') AS n_high FROM d GROUP BY 1
""")
def scores_by_class(spark, sf_dir):
    return rounded(aggregates.scores_by_class(pipelines.decided(scored_rows(spark, sf_dir)), "label", "probability", "decision"), "mean", "low", "high")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality <> 1) AS n_bad_label FROM labels")
def label_verification(spark, sf_dir):
    return aggregates.verification(table(spark, sf_dir, "labels"), "quality", 1)


@query(f"WITH {FLOW_SQL}, {_SCORED} SELECT min(ts_us) FILTER (WHERE decision = 'HIGH') AS first_us, min(ts_us) FILTER (WHERE decision = 'HIGH') - min(ts_us) AS latency_us FROM d")
def first_block(spark, sf_dir):
    return aggregates.first_block(pipelines.decided(scored_rows(spark, sf_dir)))


@query("SELECT count(*) FILTER (WHERE c_name IS NULL) AS c_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def null_counts(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return aggregates.null_counts(c.join(o, c.c_custkey == o.o_custkey, "left").select("c_name", "o_orderkey"))


@query("""
WITH t AS (SELECT CASE WHEN c_acctbal < 0 THEN 'high' WHEN c_acctbal < 2000 THEN 'medium' ELSE 'normal' END AS tier, c_mktsegment AS rule FROM customer)
SELECT tier, rule, count(*) AS n, count(*) FILTER (WHERE tier = 'high') AS removed, round(100.0 * count(*) FILTER (WHERE tier = 'high') / sum(count(*)) OVER (), 6) AS pct_removed FROM t GROUP BY 1, 2
""")
def weak_report(spark, sf_dir):
    tier = F.when(F.col("c_acctbal") < 0, "high").when(F.col("c_acctbal") < 2000, "medium").otherwise("normal")
    rows = table(spark, sf_dir, "customer").select(tier.alias("tier"), F.col("c_mktsegment").alias("rule")).withColumn("keep", F.col("tier") != "high")
    return rounded(aggregates.weak_report(rows), "pct_removed")


# --- order, quotas and samples -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500 OFFSET 1000")
def line_range(spark, sf_dir):
    """Rows 1000 to 1500 of the time order."""
    return sampling.line_range(table(spark, sf_dir, "orders"), 1000, 1500, F.col("o_orderdate"), "o_orderkey").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("SELECT (SELECT count(*) FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events) WHERE ts < p) = 0 AS events_in_order, (SELECT count(*) FROM (SELECT o_orderdate AS d, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE d < p) = 0 AS orders_in_order")
def order_check(spark, sf_dir):
    e = sampling.is_in_order(event_rows(spark, sf_dir), "ts_us", "seq").withColumnRenamed("in_order", "events_in_order")
    o = sampling.is_in_order(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").withColumnRenamed("in_order", "orders_in_order")
    return e.crossJoin(F.broadcast(o))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_parts(spark, sf_dir):
    return sampling.top(table(spark, sf_dir, "part"), 25, F.col("p_retailprice").desc(), "p_partkey").select("p_partkey", "p_retailprice")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_unique FROM events")
def shuffle_keeps_rows(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "events"), 42, "event_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_unique"))


_REST = """WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), o AS (SELECT source, sum(n) AS w FROM s GROUP BY 1),
a AS (SELECT *, 300.0 * w / sum(w) OVER () AS raw FROM o), b AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, source) AS r FROM a),
q AS (SELECT source, w, CAST(base + CASE WHEN r <= 300 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b)"""


@query(f"{_REST} SELECT source, CAST(w AS BIGINT) AS n, quota FROM q")
def remainder_quotas(spark, sf_dir):
    """300 rows shared by the sources' sizes, by largest remainders."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(sizes, F.lit(300), "source", "n")


@query(f"""{_REST}, i AS (SELECT s.*, q.quota AS share, CAST(q.quota AS DOUBLE) * s.n / sum(s.n) OVER (PARTITION BY source) AS raw FROM s JOIN q USING (source)),
j AS (SELECT *, floor(raw) AS base, row_number() OVER (PARTITION BY source ORDER BY raw - floor(raw) DESC, lang) AS r FROM i)
SELECT source, lang, n, CAST(base + CASE WHEN r <= share - sum(base) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM j""")
def nested_quotas(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return sampling.nested_quotas(sizes, 300, "source", "lang")


@query("""
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(n) AS m FROM n WHERE event_type NOT IN ('error', 'click'))
SELECT event_type, least(n, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'click' THEN 900 ELSE n END) AS n FROM n
""")
def downsampled_classes(spark, sf_dir):
    """Rows by class after two classes were cut down; the rows themselves are checked in the tests."""
    f = event_rows(spark, sf_dir).withColumn("src_ip", F.col("user_id").cast("string")).withColumn("dst_port", F.col("k") * 700).withColumn("duration", F.col("value") / 50)
    out = sampling.downsampled(f, "event_type", {"error": 500, "click": 900}, "seq", bucket_seconds=86_400, phases=4)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_per_key(spark, sf_dir):
    return sampling.first_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS users_on_both_sides FROM events")
def group_split(spark, sf_dir):
    s = sampling.group_split(table(spark, sf_dir, "events"), "user_id")
    both = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("k"))
    return both.agg(F.sum("n").alias("n"), F.count_if(F.col("k") > 1).alias("users_on_both_sides"))


@query("WITH c AS (SELECT quantile_cont(epoch_us(ts), 0.8) AS cut FROM events) SELECT CASE WHEN epoch_us(ts) > cut THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM events, c GROUP BY 1")
def temporal_split(spark, sf_dir):
    return sampling.temporal_split(event_rows(spark, sf_dir), "ts_us").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {E_SQL}, m AS (SELECT event_type, min(ts_us) AS lo, max(ts_us) AS hi FROM e GROUP BY 1)
SELECT event_type, 'phase_' || CAST(least(3, floor((ts_us - lo) / (hi - lo) * 4)) AS INT) AS phase, count(*) AS n FROM e JOIN m USING (event_type) GROUP BY 1, 2
""")
def time_phases(spark, sf_dir):
    return sampling.with_phase(event_rows(spark, sf_dir), "ts_us", 4, ["event_type"]).groupBy("event_type", "phase").agg(F.count(F.lit(1)).alias("n"))


# --- sets -----------------------------------------------------------------------------------------------------------------------


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return sets.union_all(c, s)


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def keys_in_common(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return sets.keys_in_common(c, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def keys_only_in_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return sets.keys_only_in(o, o.where("o_totalprice > 300000"), "k")


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 495000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < -900")
def either_threshold(spark, sf_dir):
    return sets.either(table(spark, sf_dir, "orders").where("o_totalprice > 495000").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("k")))


# --- scalars ---------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {E_SQL}
SELECT seq, CASE WHEN k * 700 <= 1023 THEN 'well_known' WHEN k * 700 <= 49151 THEN 'registered' ELSE 'dynamic' END AS port_bucket,
       CASE WHEN value / 50 <= 0.05 THEN 'd_micro' WHEN value / 50 <= 0.5 THEN 'd_short' WHEN value / 50 <= 2 THEN 'd_medium' WHEN value / 50 <= 10 THEN 'd_long' ELSE 'd_very_long' END AS duration_bucket,
       CASE k WHEN 53 THEN 'dns' WHEN 22 THEN 'ssh' WHEN 80 THEN 'http' ELSE 'other' END AS service, k % 4 IN (0, 1) AS private,
       CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS label, CASE event_type WHEN 'error' THEN 'DDoS' WHEN 'click' THEN 'Bruteforce' WHEN 'view' THEN 'Recon' END AS family,
       CASE k % 4 WHEN 0 THEN '10.1.2' WHEN 1 THEN '192.168.7' WHEN 2 THEN '8.8.8' ELSE '172.40.0' END AS prefix
FROM e
""")
def scalar_functions(spark, sf_dir):
    """Buckets, services, address ranges, label words and families."""
    e = event_rows(spark, sf_dir)
    ip = F.when(F.col("k") % 4 == 0, "10.1.2.3").when(F.col("k") % 4 == 1, "::FFFF:192.168.7.1").when(F.col("k") % 4 == 2, "8.8.8.8").otherwise("172.40.0.9")
    word = F.when(F.col("event_type") == "click", "Benign").when(F.col("event_type") == "view", "0.0").when(F.col("event_type") == "error", "attack").otherwise("7")
    name = F.when(F.col("event_type") == "error", "DDoS-LOIC").when(F.col("event_type") == "click", "SSH-Patator").when(F.col("event_type") == "view", "PortScan").otherwise("benign")
    plain = coerce.plain_address(ip)
    return e.select("seq", network.port_bucket(F.col("k") * 700).alias("port_bucket"), network.duration_bucket(F.col("value") / 50).alias("duration_bucket"), network.service(F.col("k"), F.lit("tcp")).alias("service"), network.private_address(plain).alias("private"), coerce.binary_label(word).alias("label"), coerce.attack_family(name).alias("family"), coerce.prefix24(plain).alias("prefix"))


@query(f"""
WITH {E_SQL}
SELECT seq, 'u' || user_id || ':' || k || '-h:0-UDP_' || CAST(ts_us // 5000000 AS VARCHAR) AS flow_key, CASE WHEN k % 10 = 0 THEN 'u' || user_id || ':' || k || '-h:0-UDP_' || CAST(ts_us // 5000000 AS VARCHAR) ELSE CAST(seq AS VARCHAR) END AS identity_key FROM e
""")
def identity_keys(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    key = identity.flow_key(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("k"), F.lit(" h "), F.lit("x"), F.lit(" udp"), F.col("ts_us") / 1e6)
    flow_id = F.when(F.col("k") % 10 == 0, "NaN").otherwise(F.concat(F.col("seq").cast("string"), F.lit(".0")))
    return e.select("seq", key.alias("flow_key"), identity.identity_key(coerce.label_id(flow_id), key).alias("identity_key"))


@query(f"""
WITH {E_SQL} SELECT seq, ts_us AS from_iso, ts_us // 1000000 * 1000000 AS from_seconds, ts_us // 1000 * 1000 AS from_millis FROM e
""")
def time_parsing(spark, sf_dir):
    """Times as ISO text with an offset, as seconds and as milliseconds."""
    e = event_rows(spark, sf_dir)
    shifted = F.concat(F.date_format(F.expr("timestampadd(MICROSECOND, ts_us + 19800000000, TIMESTAMP_NTZ '1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0530"))
    return e.select("seq", times.parsed_us(shifted).alias("from_iso"), times.label_us(F.floor(F.col("ts_us") / 1_000_000).cast("string")).alias("from_seconds"), times.log_us(F.floor(F.col("ts_us") / 1000).cast("string")).alias("from_millis"))


# --- context ----------------------------------------------------------------------------------------------------------------------

RULES = context.Rules(window=300, suspicious=0.5, least_events=2, ddos_window=60, ddos_flows=25, ddos_sources=15, fanout_window=120, fanout_ports=5, burst_window=60, burst_flows=12, scan_window=120, scan_ports=5, sweep_window=120, sweep_hosts=12, slow_window=400, slow_ports=5)


def _windowed(key: str, seconds: int, what: str) -> str:
    return f"(SELECT {what} FROM d b WHERE b.{key} = a.{key} AND b.ts_us >= a.ts_us - {seconds}000000 AND (b.seq <= a.seq))"


_CONTEXT = f"""c AS (SELECT a.*, (SELECT count(*) FROM d b WHERE b.src_ip = a.src_ip AND b.dst_ip = a.dst_ip AND b.dst_port = a.dst_port AND b.ts_us >= a.ts_us - 300000000 AND b.seq <= a.seq AND b.probability >= 0.5) AS suspicious,
  {_windowed('dst_ip', 60, 'count(*)')} AS dst_flows, {_windowed('dst_ip', 60, 'count(DISTINCT b.src_ip)')} AS dst_sources, {_windowed('dst_ip', 120, 'count(DISTINCT b.dst_port)')} AS dst_ports,
  {_windowed('src_ip', 60, 'count(*)')} AS src_flows, {_windowed('src_ip', 120, 'count(DISTINCT b.dst_port)')} AS src_ports, {_windowed('src_ip', 120, 'count(DISTINCT b.dst_ip)')} AS src_hosts FROM d a),
g AS (SELECT *, dst_flows >= 25 AND dst_sources >= 15 AS t1, dst_ports >= 5 AS t2, src_flows >= 12 AS t3, src_ports >= 5 AS t4, src_hosts >= 12 AS t5, {_windowed('src_ip', 400, 'count(DISTINCT b.dst_port)').replace('FROM d b', 'FROM c b')} >= 5 AS t6 FROM c a),
h AS (SELECT *, suspicious >= 2 OR bool_or(t1 OR t2) OVER (PARTITION BY dst_ip ORDER BY ts_us, seq) OR bool_or(t3 OR t4 OR t5 OR t6) OVER (PARTITION BY src_ip ORDER BY ts_us, seq) AS up FROM g)"""


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, {_CONTEXT}
SELECT seq, CAST(suspicious AS BIGINT) AS suspicious, CAST(dst_sources AS BIGINT) AS dst_sources, CAST(src_hosts AS BIGINT) AS src_hosts, CASE WHEN up THEN 'HIGH' ELSE decision END AS context_decision FROM h
""")
def context_escalation(spark, sf_dir):
    """Decisions after a row's neighbours in time were looked at."""
    d = pipelines.decided(scored_rows(spark, sf_dir))
    out = context.escalated(d, RULES)
    return out.select("seq", F.col("suspicious").cast("long").alias("suspicious"), F.col("dst_sources").cast("long").alias("dst_sources"), F.col("src_hosts").cast("long").alias("src_hosts"), "context_decision")


@query()
def block_list(spark, sf_dir):
    """Blocks by event time under the list's limits."""
    return context.block_list(pipelines.decided(scored_rows(spark, sf_dir)), context.BlockLimits(ttl=60, most=100, per_minute=60))


@query()
def isolation_scores(spark, sf_dir):
    """An isolation forest over line items, fitted on a bounded sample."""
    from weirflow.functions.decisions import anomaly_sigmoid
    from weirflow.ml.isolation import fit_forest

    li = _lines(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey").select("seq", F.col("qty").cast("double").alias("qty"), "s_acctbal")
    out = fit_forest(li, ("qty", "s_acctbal"), "seq", trees=25).scored(li)
    return out.select("seq", anomaly_sigmoid(F.col("if_raw")).alias("anomaly"))


@query()
def forest_probabilities(spark, sf_dir):
    """A classifier of flows fitted on their features and labels."""
    from weirflow.ml.classifiers import probability, random_forest

    names = ("flow_rate_src_10s", "bytes_ratio_fwd_rev", "syn_heavy_ratio_src_60s", "has_tcp")
    path = new_folder(spark, "training")
    pipelines.training_table(eve.parsed(event_lines(spark, sf_dir), ("flow",)), label_rows(spark, sf_dir)).select("identity_key", "binary_label", *names).write.parquet(path)
    rows = spark.read.parquet(path)
    return probability(random_forest(rows, names, "binary_label", trees=10, depth=5), rows).select("identity_key", "probability")


def _load() -> None:
    """The modules that register queries of their own."""
    from weirflow.plans import flow_queries, table_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def __getattr__(name: str) -> Query:
    """The queries of the other modules, by name."""
    if not name.startswith("_") and name in queries():
        return QUERIES[name]
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
