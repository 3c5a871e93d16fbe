"""Queries over flows: all features, the smaller packs, both published schedules, enrichment; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import features, joins, labeling, packs
from weirflow.plans.queries import FLOW_SQL, event_rows, flow_rows, label_rows, query
from weirflow.sources import eve

#: Flows in their order of processing, with the derived columns that windows need.
ORDERED_SQL = f"""{FLOW_SQL},
o AS (SELECT *, fwd + rev AS total, (fwd + rev) // 128 AS size,
      CASE WHEN has_tcp = 0 THEN 0 ELSE greatest(1, syn + ack + rst) END AS pkts,
      row_number() OVER (ORDER BY ts_us, 'f' || seq, src_ip, dst_ip, dst_port) AS ord FROM f)"""

_S300 = "SELECT a.seq, b.* EXCLUDE (seq), a.ts_us AS now FROM o a JOIN o b ON b.src_ip = a.src_ip AND b.ord < a.ord AND b.ts_us >= a.ts_us - 300000000"
_D60 = "SELECT a.seq, b.* EXCLUDE (seq), a.ts_us AS now, a.src_ip AS me, a.dst_port AS my_port FROM o a JOIN o b ON b.dst_ip = a.dst_ip AND b.ord < a.ord AND b.ts_us >= a.ts_us - 60000000"
_IN60, _IN10 = "ts_us >= now - 60000000", "ts_us >= now - 10000000"


def _entropy(source: str, value: str, eps: str = "1e-6") -> str:
    """SQL of seq, h, most: the entropy of a column over a row's window, and its largest count."""
    return f"""(SELECT seq, sum(-(c / n) * log2(c / n + {eps})) AS h, max(c) AS most
      FROM (SELECT seq, {value}, count(*) AS c, sum(count(*)) OVER (PARTITION BY seq) AS n FROM {source} GROUP BY seq, {value}) GROUP BY seq)"""


def _gaps(source: str) -> str:
    """SQL of seq, cv, ac: variation of the gaps in a row's window, and the correlation of neighbours."""
    return f"""(SELECT seq, stddev_pop(g) / (avg(g) + 1e-6) AS cv,
       CASE WHEN count(p) >= 2 AND stddev_pop(g) FILTER (WHERE p IS NOT NULL) > 1e-6 AND stddev_pop(p) > 1e-6 THEN corr(g, p) ELSE 0 END AS ac
      FROM (SELECT seq, g, lag(g) OVER (PARTITION BY seq ORDER BY ord) AS p FROM
        (SELECT seq, ord, (ts_us - lag(ts_us) OVER (PARTITION BY seq ORDER BY ord)) / 1e6 AS g FROM {source}) WHERE g IS NOT NULL) GROUP BY seq)"""


_FEATURES_SQL = f"""
WITH {ORDERED_SQL}, s AS MATERIALIZED ({_S300}), d AS MATERIALIZED ({_D60}),
s60 AS (SELECT * FROM s WHERE {_IN60}), p300 AS (SELECT s.* FROM s JOIN o ON o.seq = s.seq AND o.dst_ip = s.dst_ip),
a AS (SELECT seq, count(*) AS n300, count(*) FILTER (WHERE {_IN60}) AS n60, count(*) FILTER (WHERE {_IN10}) AS n10,
  count(*) FILTER (WHERE {_IN10} AND now <= ts_us + floor(duration * 1000000 + 0.000001)) AS active, count(DISTINCT dst_ip) AS dsts, count(DISTINCT dst_port) AS ports,
  count(DISTINCT (dst_ip, dst_port)) AS pairs, sum(syn) FILTER (WHERE {_IN60}) AS syn, sum(ack) FILTER (WHERE {_IN60}) AS ack, sum(rst) FILTER (WHERE {_IN60}) AS rst,
  sum(pkts) FILTER (WHERE {_IN60}) AS pkts, count(*) FILTER (WHERE ack > 0) AS acked, count(*) FILTER (WHERE duration < 1) AS short,
  count(*) FILTER (WHERE duration > 120 AND total / (duration + 1e-6) < 64) AS slow, sum(total) AS bytes,
  count(*) FILTER (WHERE {_IN60} AND rev < 128 AND fwd > 256) AS small,
  count(*) FILTER (WHERE {_IN60} AND rst > 0 AND duration <= 0.5 AND total <= 150 AND fwd <= 120 AND rev <= 120) AS micro,
  count(*) FILTER (WHERE {_IN60} AND rst > 0 AND ack > 0) AS rst_ack FROM s GROUP BY seq),
m AS (SELECT seq, arg_max(size, (c, -first)) AS mode FROM (SELECT seq, size, count(*) AS c, min(ord) AS first FROM s GROUP BY seq, size) GROUP BY seq),
b AS (SELECT seq, count(*) AS n60, count(*) FILTER (WHERE {_IN10}) AS n10, count(DISTINCT src_ip) AS srcs60, count(DISTINCT src_ip) FILTER (WHERE {_IN10}) AS srcs10,
  count(*) FILTER (WHERE src_ip = me) AS mine, count(*) FILTER (WHERE {_IN10} AND now <= ts_us + floor(duration * 1000000 + 0.000001)) AS active,
  count(*) FILTER (WHERE {_IN10} AND now <= ts_us + floor(duration * 1000000 + 0.000001) AND dst_port = my_port) AS service FROM d GROUP BY seq),
p AS (SELECT a.seq, count(b.seq) AS n, coalesce(sum(b.total), 0) AS bytes FROM o a LEFT JOIN o b ON b.src_ip = a.src_ip AND b.dst_ip = a.dst_ip AND b.ord < a.ord GROUP BY a.seq),
t AS (SELECT a.seq, count(b.seq) AS n FROM o a LEFT JOIN o b ON b.src_ip = a.src_ip AND b.ord < a.ord GROUP BY a.seq),
z AS (SELECT o.seq, o.fwd, o.rev, o.has_tcp, coalesce(a.n10, 0) AS n10, coalesce(a.n60, 0) AS n60, coalesce(a.n300, 0) AS n300, coalesce(a.active, 0) AS active, coalesce(dsts, 0) AS dsts,
  coalesce(ports, 0) AS ports, coalesce(pairs, 0) AS pairs, coalesce(a.syn, 0) AS syn, coalesce(a.ack, 0) AS ack, coalesce(a.rst, 0) AS rst, coalesce(a.pkts, 0) AS pkts, coalesce(acked, 0) AS acked,
  coalesce(short, 0) AS short, coalesce(slow, 0) AS slow, coalesce(a.bytes, 0) AS bytes, coalesce(small, 0) AS small, coalesce(micro, 0) AS micro, coalesce(rst_ack, 0) AS rst_ack,
  coalesce(mode, 0) AS mode, coalesce(b.n60, 0) AS d60, coalesce(b.n10, 0) AS d10, coalesce(srcs60, 0) AS srcs60, coalesce(srcs10, 0) AS srcs10, coalesce(mine, 0) AS mine,
  coalesce(b.active, 0) AS dactive, coalesce(service, 0) AS service, p.n AS pn, p.bytes AS pbytes, t.n AS tn, coalesce(hd.h, 0) AS hd, coalesce(hp.h, 0) AS hp, coalesce(hp.most, 0) AS most,
  coalesce(hp60.most, 0) AS most60, coalesce(hs.h, 0) AS hs, coalesce(g60.cv, 0) AS cv60, coalesce(gp.cv, 0) AS cvp, coalesce(gp.ac, 0) AS acp
  FROM o LEFT JOIN a ON a.seq = o.seq LEFT JOIN m ON m.seq = o.seq LEFT JOIN b ON b.seq = o.seq JOIN p ON p.seq = o.seq JOIN t ON t.seq = o.seq
  LEFT JOIN {_entropy('s', 'dst_ip')} hd ON hd.seq = o.seq LEFT JOIN {_entropy('s', 'dst_port')} hp ON hp.seq = o.seq LEFT JOIN {_entropy('s60', 'dst_port')} hp60 ON hp60.seq = o.seq
  LEFT JOIN {_entropy('d', 'src_ip')} hs ON hs.seq = o.seq LEFT JOIN {_gaps('s60')} g60 ON g60.seq = o.seq LEFT JOIN {_gaps('p300')} gp ON gp.seq = o.seq),
e1 AS (SELECT *, n10 / 10 AS r10, n60 / 60 AS r60, syn + ack + rst AS flags FROM z)
"""

_SHARE = "least(1.0, greatest(0.0, {}))"
#: SQL of each feature over z, and the digits that both sides are rounded to.
_FEATURE_SQL = {
    "flow_rate_src_10s": "r10",
    "flow_rate_src_60s": "r60",
    "flow_rate_dst_10s": "d10 / 10",
    "rate_ratio_src_10s_60s": "r10 / (r60 + 1e-6)",
    "rate_ratio_src_60s_300s": "r60 / (n300 / 300 + 1e-6)",
    "concurrent_flows_src_10s": "active",
    "concurrent_flows_dst_10s": "dactive",
    "concurrent_flows_per_dst_port_10s": "service",
    "unique_src_ips_by_dst_60s": "srcs60",
    "dst_ip_unique_src_ips_10s": "srcs10",
    "new_dst_ip_ratio_src_300s": "CASE WHEN n300 > 1 THEN dsts / n300 ELSE 0 END",
    "new_dst_port_ratio_src_300s": "CASE WHEN n300 > 1 THEN ports / n300 ELSE 0 END",
    "new_dst_ips_per_sec": "CASE WHEN n300 > 1 THEN dsts / 300 ELSE 0 END",
    "new_dst_ports_per_sec": "CASE WHEN n300 > 1 THEN ports / 300 ELSE 0 END",
    "dst_ip_entropy_src_300s": "greatest(0, hd)",
    "dst_port_entropy_src_300s": "greatest(0, hp)",
    "iat_cv_src_60s": "cv60",
    "iat_cv_srcdst_300s": "cvp",
    "iat_autocorr_srcdst_300s": "acp",
    "bytes_ratio_fwd_rev": "fwd / (rev + 1)",
    "short_flow_ratio_src_300s": "short / (n300 + 1e-6)",
    "avg_bytes_per_flow_src_300s": "bytes / (n300 + 1e-6)",
    "bytes_per_flow_srcdst": "pbytes / (pn + 1e-6)",
    "connection_reuse_ratio_srcdst": "pn / (tn + 1e-6)",
    "flow_size_mode_src_300s": "mode",
    "retry_rate_same_dstport_300s": "(n300 - pairs) / (n300 + 1e-6)",
    "retry_rate_same_dstip_300s": "(n300 - dsts) / (n300 + 1e-6)",
    "dst_port_reuse_ratio_src_300s": "most / (n300 + 1e-6)",
    "syn_heavy_ratio_src_60s": "syn / (pkts + 1e-6)",
    "syn_to_established_ratio": "syn / (ack + 1e-6)",
    "rst_ratio_src_60s": "rst / (n60 + 1e-6)",
    "rst_to_syn_ratio_src_60s": "rst / (syn + 1e-6)",
    "tcp_flag_entropy_src_60s": "CASE WHEN flags > 0 THEN greatest(0, " + " + ".join(f"CASE WHEN {x} > 0 THEN -({x} / flags) * log2({x} / flags + 1e-6) ELSE 0 END" for x in ("syn", "ack", "rst")) + ") ELSE 0 END",
    "ack_presence_ratio": "acked / (n300 + 1e-6)",
    "small_response_ratio_src_60s": "CASE WHEN n60 > 0 THEN small / n60 ELSE 0 END",
    "incomplete_flow_duration_ratio_src_300s": "short / (n300 + 1e-6)",
    "low_data_rate_long_flow_ratio_src_300s": "slow / (n300 + 1e-6)",
    "src_contribution_to_dst_ratio_60s": "mine / (d60 + 1e-6)",
    "rst_micro_flow_ratio_src_60s": "CASE WHEN n60 >= 5 THEN micro / (n60 + 1e-6) ELSE 0 END",
    "single_dst_port_focus_src_60s": "CASE WHEN n60 >= 5 THEN most60 / (n60 + 1e-6) ELSE 0 END",
    "rst_after_ack_ratio_src_60s": "CASE WHEN has_tcp > 0 AND n60 >= 5 THEN rst_ack / (n60 + 1e-6) ELSE 0 END",
    "dst_src_ip_entropy_60s": "greatest(0, hs)",
    "avg_flow_per_src_to_dst_10s": "d10 / (srcs10 + 1e-6)",
    "iat_regularity_src_60s": "CASE WHEN n60 >= 5 AND cv60 > 0 THEN 1 / (cv60 + 1e-6) ELSE 0 END",
    "has_tcp": "has_tcp",
}
#: Ratios over a count that may be 0 are as large as a million times their numerator.
_COARSE = {"syn_to_established_ratio": 2, "rst_to_syn_ratio_src_60s": 2, "avg_bytes_per_flow_src_300s": 3, "bytes_per_flow_srcdst": 3}


def _digits(name: str) -> int:
    return _COARSE.get(name, 5)


def _feature_columns(names: tuple[str, ...]) -> str:
    bounds = dict(features.FEATURES)
    sql = {n: (_SHARE.format(_FEATURE_SQL[n]) if bounds[n] == 1.0 and n != features.AUTOCORRELATION else _FEATURE_SQL[n]) for n in names}
    return ", ".join(f"round(CAST({x} AS DOUBLE), {_digits(n)}) AS {n}" for n, x in sql.items())


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(n, _digits(n)).alias(n) for n in features.NAMES])


@query(f"{_FEATURES_SQL} SELECT seq, {_feature_columns(features.NAMES)} FROM e1")
def all_flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 45 features."""
    return _rounded(features.features(flow_rows(spark, sf_dir)), "seq")


@query(f"""{_FEATURES_SQL}, q AS (SELECT seq, {_feature_columns(features.NAMES)} FROM e1)
SELECT q.* EXCLUDE (seq), CAST(CASE WHEN e.seq % 15 = 0 THEN 1 ELSE CAST(event_type = 'error' AS INT) END AS BIGINT) AS binary_label,
CASE WHEN e.seq % 15 = 0 THEN 'again' ELSE event_type END AS attack_subclass, 'f' || e.seq AS identity_key,
src_ip || ':40000-' || dst_ip || ':' || dst_port || '-TCP_' || CAST(o.ts_us // 5000000 AS VARCHAR) AS flow_key FROM q JOIN e ON e.seq = q.seq JOIN o ON o.seq = q.seq""")
def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of labelled flows, labels and keys: the whole plan from log lines."""
    from weirflow.plans import pipelines
    from weirflow.plans.queries import event_lines

    out = pipelines.training_table(eve.parsed(event_lines(spark, sf_dir), ("flow",)), label_rows(spark, sf_dir))
    out = out.withColumn("binary_label", F.col("binary_label").cast("long"))
    return _rounded(out, "binary_label", "attack_subclass", "identity_key", "flow_key")


# --- packs ----------------------------------------------------------------------------------------------------------------------

#: The same flows with the other columns that packs read.
PACK_SQL = f"""{ORDERED_SQL},
k AS (SELECT *, 40000 AS src_port, CASE WHEN fwd_pkts <= 0 THEN 0 WHEN duration > 0 AND duration < 1.5 AND rev < 300 OR fwd_pkts > 3 AND rev_pkts <= 1 THEN 1 ELSE 0 END AS failed,
      CASE dst_port WHEN 53 THEN 'dns' WHEN 22 THEN 'ssh' ELSE 'http' END AS service FROM o)"""


def _around(name: str, key: str, seconds: int, what: str, own: bool = False) -> str:
    """SQL of a measure of the rows before a row (or with it) that share a key."""
    same = " AND ".join(f"b.{c} = a.{c}" for c in key.split())
    turn = "<=" if own else "<"
    return f"(SELECT a.seq, {what} AS {name} FROM k a JOIN k b ON {same} AND b.ord {turn} a.ord AND b.ts_us >= a.ts_us - {seconds}000000 GROUP BY a.seq)"


def _pack_sql(measures: dict[str, tuple], columns: dict[str, str]) -> str:
    joined = " ".join(f"LEFT JOIN {_around(n, *m)} m_{n} ON m_{n}.seq = k.seq" for n, m in measures.items())
    values = ", ".join(f"coalesce({n}, 0) AS {n}" for n in measures)
    out = ", ".join(f"round(CAST({x} AS DOUBLE), 5) AS {c}" for c, x in columns.items())
    return f"WITH {PACK_SQL}, z AS (SELECT k.*, {values} FROM k {joined}) SELECT seq, {out} FROM z"


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_RECENT_SQL = _pack_sql(
    {
        "n60": ("src_ip", 60, "count(*)"), "n120": ("src_ip", 120, "count(*)"), "d60": ("dst_ip", 60, "count(*)"), "sports": ("src_ip", 60, "count(DISTINCT b.src_port)"),
        "dports": ("src_ip", 60, "count(DISTINCT b.dst_port)"), "dsts": ("src_ip", 60, "count(DISTINCT b.dst_ip)"), "bad": ("src_ip", 60, "sum(b.failed)"),
        "http": ("src_ip", 60, _count("b.service = 'http'")), "dns": ("src_ip", 60, _count("b.service = 'dns'")), "ssh": ("src_ip", 60, _count("b.service = 'ssh'")),
    },
    dict(zip(packs.RECENT, ("n60", "d60", "sports", "dports", "http", "dns", "ssh", "n60 - http - dns - ssh", "n120", "(bad + failed) / (n60 + 1)", "dsts", "CASE WHEN n60 > 0 THEN dns / n60 ELSE 0 END"))),
)


def _made(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select("seq", *[F.round(n, 5).alias(n) for n in names])


@query(_RECENT_SQL)
def recent_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last one and two minutes."""
    return _made(packs.recent(flow_rows(spark, sf_dir)), packs.RECENT)


_FLAG_ENTROPY = "CASE WHEN syn6 + ack6 + rst6 > 0 THEN " + " + ".join(f"CASE WHEN {x} > 0 THEN -({x} / (syn6 + ack6 + rst6)) * log2({x} / (syn6 + ack6 + rst6)) ELSE 0 END" for x in ("syn6", "ack6", "rst6")) + " ELSE 0 END"
_TRACKERS_SQL = _pack_sql(
    {
        "n300": ("src_ip", 300, "count(*)"), "spread": ("src_ip", 300, "(count(*) * sum(b.dst_port * b.dst_port) - sum(b.dst_port) * sum(b.dst_port)) / (count(*) * count(*))"), "sources": ("dst_ip", 60, "count(DISTINCT b.src_ip)"),
        "syn6": ("src_ip", 60, "sum(b.syn)"), "ack6": ("src_ip", 60, "sum(b.ack)"), "rst6": ("src_ip", 60, "sum(b.rst)"),
        "times": ("src_ip", 300, "list_sort(list(b.ts_us))"),
    },
    {
        "dst_port_variance_300s": "spread",
        "flow_iat_variance_300s": "CASE WHEN len(times) >= 3 THEN list_var_pop([(x - y) / 1e6 FOR (x, y) IN list_zip(times[2:], times[:-2])]) ELSE 0 END",
        "dst_unique_src_ips_60s": "sources",
        "src_flow_count_300s": "n300",
        "tcp_flag_entropy_60s": _FLAG_ENTROPY,
    },
).replace("coalesce(times, 0) AS times", "coalesce(times, []) AS times").replace("[(x - y) / 1e6 FOR (x, y) IN list_zip(times[2:], times[:-2])]", "list_transform(list_zip(times[2:], times[:-2]), lambda x: (x[1] - x[2]) / 1e6)")


@query(_TRACKERS_SQL)
def tracker_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of ports and gaps, distinct sources, a count, and the entropy of flags."""
    return _made(packs.trackers(flow_rows(spark, sf_dir)), packs.TRACKERS)


@query(_pack_sql(
    {
        "n10": ("src_ip", 10, "count(*)", True), "n60": ("src_ip", 60, "count(*)", True), "s10": ("src_ip dst_ip dst_port", 10, "count(*)", True),
        "s60": ("src_ip dst_ip dst_port", 60, "count(*)", True), "p60": ("src_ip dst_ip", 60, "count(*)", True),
    },
    dict(zip(packs.TEMPORAL, ("n10", "s10", "s60 / n60", "n10 / n60", "p60 / n60"))),
))
def temporal_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a source's last seconds, the row itself included."""
    return _made(packs.temporal(flow_rows(spark, sf_dir)), packs.TEMPORAL)


@query(_pack_sql(
    {
        "n60": ("src_ip", 60, "count(*)", True), "ports": ("src_ip", 60, "count(DISTINCT b.dst_port)", True), "dsts": ("src_ip", 60, "count(DISTINCT b.dst_ip)", True),
        "port60": ("src_ip dst_port", 60, "count(*)", True), "sources": ("dst_ip", 120, "count(DISTINCT b.src_ip)", True),
    },
    dict(zip(packs.BEHAVIOUR, ("n60", "ports", "dsts", "port60", "sources", "0", "0", "0", "CASE WHEN syn = 1 AND ack = 0 THEN 0.9 WHEN rst = 1 THEN 0.5 WHEN syn = 1 AND ack = 1 THEN 0.2 ELSE 0.1 END"))),
))
def behaviour_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last one and two minutes, the row itself included, and its flags."""
    return _made(packs.behaviour(flow_rows(spark, sf_dir)), packs.BEHAVIOUR)


# --- enrichment and schedules -----------------------------------------------------------------------------------------------------


@query(f"""
WITH {FLOW_SQL}, r AS (SELECT ts_us AS at, seq, src_ip, dst_ip, dst_port, (seq % 7) * 1.5 AS pkt_rate, CASE WHEN seq % 2 = 0 THEN seq % 11 END AS iat_max FROM f WHERE seq % 3 = 0),
m AS (SELECT f.seq, arg_max(r.pkt_rate, (r.at, r.seq)) AS pkt_rate, arg_max([r.iat_max], (r.at, r.seq))[1] AS iat_max, count(r.seq) AS n
      FROM f LEFT JOIN r ON r.src_ip = f.src_ip AND r.dst_ip = f.dst_ip AND r.dst_port = f.dst_port AND r.at <= f.ts_us AND r.at // 5000000 = f.ts_us // 5000000 GROUP BY f.seq),
w AS (SELECT f.seq, fwd_pkts + rev_pkts AS p, duration, fwd + rev AS total, m.* EXCLUDE (seq) FROM f JOIN m USING (seq))
SELECT seq, round(CASE WHEN n > 0 THEN pkt_rate WHEN duration > 0 THEN p / duration ELSE 0 END, 6) AS pkt_rate, round(CASE WHEN duration > 0 THEN total / duration ELSE 0 END, 5) AS byte_rate,
       round(coalesce(iat_max, CASE WHEN p > 1 AND duration > 0 THEN duration / (p - 1) ELSE 0 END), 6) AS iat_max FROM w
""")
def enriched_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the pace that netflow records in the same log tell; every third flow has a record of its key and time."""
    flows = flow_rows(spark, sf_dir)
    records = flows.where("seq % 3 = 0").select(
        "seq", "flow_key", "ts_us", (F.col("seq") % 7 * 1.5).alias("pkt_rate"), F.lit(None).cast("double").alias("byte_rate"), F.lit(None).cast("double").alias("iat_min"),
        F.when(F.col("seq") % 2 == 0, F.col("seq") % 11).cast("double").alias("iat_max"), F.lit(None).cast("double").alias("iat_avg"),
    )
    out = packs.enriched(flows, records)
    return out.select("seq", F.round("pkt_rate", 6).alias("pkt_rate"), F.round("byte_rate", 5).alias("byte_rate"), F.round("iat_max", 6).alias("iat_max"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_2018 = ", ".join(
    f"({k}, '{n}', TIMESTAMP '{d} {s}:00' + INTERVAL 5 HOUR - INTERVAL {labeling.BUFFERS.get(n, labeling.OTHER_BUFFER)[0]} SECOND, "
    f"TIMESTAMP '{d} {e}:00' + INTERVAL 5 HOUR + INTERVAL {labeling.BUFFERS.get(n, labeling.OTHER_BUFFER)[1]} SECOND, {_list(a)}, {_list(v)}, {str(n in ('Bot', 'Infiltration')).lower()})"
    for k, (n, d, s, e, a, v) in enumerate(labeling.SCHEDULE_2018)
)
_2018_SQL = f"""w(ordinal, name, s, e2, attackers, victims, both_ways) AS (VALUES {_2018}),
n AS (SELECT event_id AS seq, event_id % 22 AS own, event_id // 22 AS turn FROM events),
x AS (SELECT seq, epoch_us(w.s) + CAST((turn % 14 - 2) * (epoch_us(w.e2) - epoch_us(w.s)) / 10 AS BIGINT) AS ts_us, turn,
      attackers[1 + turn % len(attackers)] AS a, CASE WHEN turn % 5 = 0 THEN '10.0.0.1' ELSE victims[1 + turn % len(victims)] END AS v FROM n JOIN w ON w.ordinal = n.own),
y AS (SELECT seq, ts_us, CASE WHEN turn % 3 = 0 THEN v ELSE a END AS src_ip, CASE WHEN turn % 3 = 0 THEN a ELSE v END AS dst_ip FROM x)"""


def _schedule_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in and around the windows of the 2018 schedule, in both directions, some between other parties."""
    w = F.broadcast(labeling.schedule_2018(spark))
    rows = event_rows(spark, sf_dir).select("seq", (F.col("seq") % 22).cast("int").alias("ordinal"), F.floor(F.col("seq") / 22).alias("turn")).join(w, "ordinal")
    at = F.col("start_us") + F.round((F.col("turn") % 14 - 2) * (F.col("end_us") - F.col("start_us")) / 10).cast("long")
    pick = lambda who: F.element_at(who, (1 + F.col("turn") % F.size(who)).cast("int"))
    other = F.when(F.col("turn") % 5 == 0, "10.0.0.1").otherwise(pick("victims"))
    back = F.col("turn") % 3 == 0
    return rows.select("seq", at.alias("ts_us"), F.when(back, other).otherwise(pick("attackers")).alias("src_ip"), F.when(back, pick("attackers")).otherwise(other).alias("dst_ip"))


@query(f"""
WITH {_2018_SQL},
m AS (SELECT seq, arg_min(name, ordinal) AS name FROM y JOIN w ON ts_us BETWEEN epoch_us(s) AND epoch_us(e2) AND (list_contains(attackers, src_ip) AND list_contains(victims, dst_ip)
      OR both_ways AND list_contains(victims, src_ip) AND list_contains(attackers, dst_ip)) GROUP BY seq)
SELECT seq, CAST(name IS NOT NULL AS INT) AS label, coalesce(name, 'benign') AS attack_type, 'window_based' AS labeling_mode FROM y LEFT JOIN m USING (seq)
""")
def schedule_2018_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows labelled by the published schedule of 2018, with its buffers and both directions."""
    return labeling.by_schedule(_schedule_flows(spark, sf_dir), labeling.schedule_2018(spark)).select("seq", "label", "attack_type", "labeling_mode")


@query(f"""
WITH {_2018_SQL}
SELECT seq, EXISTS (SELECT 1 FROM w WHERE ts_us BETWEEN epoch_us(s) AND epoch_us(e2) AND (list_contains(attackers, src_ip) OR list_contains(attackers, dst_ip))) AS involved FROM y
""")
def involved_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an attacker of a window that covers a flow's time is on either side."""
    return labeling.involvement(_schedule_flows(spark, sf_dir), labeling.schedule_2018(spark)).select("seq", "involved")


_2017 = ", ".join(f"({k}, '{day}', epoch_us(TIMESTAMP '{d} {s}:00') + 14400000000, epoch_us(TIMESTAMP '{d} {e}:00') + 14401000000, '{kind}', '{sub}')" for k, (day, d, s, e, kind, sub) in enumerate(labeling.SCHEDULE_2017))
_PARTIES = ("205.174.165.73", "192.168.10.8", "10.0.0.1", "172.16.0.1", "192.168.10.50", "8.8.8.8")


@query(f"""
WITH w(ordinal, day, s, e2, kind, sub) AS (VALUES {_2017}), n AS (SELECT event_id AS seq, event_id % 18 AS own, event_id // 18 AS turn FROM events),
y AS (SELECT seq, w.s + CAST((turn % 13 - 1) * (w.e2 - w.s) / 10 AS BIGINT) AS ts_us, CASE WHEN turn % 7 = 0 THEN 'Monday' ELSE w.day END AS day,
      {_list(_PARTIES)}[1 + turn % 6] AS src_ip, {_list(_PARTIES)}[1 + (turn // 6) % 6] AS dst_ip FROM n JOIN w ON w.ordinal = n.own),
m AS (SELECT y.seq, arg_min(w.kind, w.ordinal) AS kind, arg_min(w.sub, w.ordinal) AS sub FROM y JOIN w ON w.day = y.day AND ts_us >= s AND ts_us < e2 GROUP BY y.seq),
z AS (SELECT y.*, m.kind, m.sub, kind IS NOT NULL AND (src_ip IN ('205.174.165.73', '205.174.165.69', '205.174.165.70', '205.174.165.71')
      OR dst_ip IN ('192.168.10.50', '192.168.10.51', '192.168.10.8', '192.168.10.25', '192.168.10.5', '192.168.10.9', '192.168.10.14', '192.168.10.15', '205.174.165.80', '172.16.0.1')) AS hit FROM y LEFT JOIN m USING (seq))
SELECT seq, CAST(hit AS INT) AS label, CASE WHEN hit THEN CASE WHEN kind = 'Infiltration' AND src_ip = '192.168.10.8' THEN 'LateralMovement' ELSE kind END || '/' || sub ELSE 'benign' END AS attack_type FROM z
""")
def schedule_2017_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows labelled by the published intervals of 2017: day, time, a party to the attack, and what the lateral source does."""
    w = labeling.schedule_2017(spark)
    rows = event_rows(spark, sf_dir).select("seq", (F.col("seq") % 18).cast("int").alias("ordinal"), F.floor(F.col("seq") / 18).alias("turn")).join(F.broadcast(w), "ordinal")
    parties = F.array(*[F.lit(p) for p in _PARTIES])
    pick = lambda k: F.element_at(parties, (1 + k % 6).cast("int"))
    at = F.col("start_us") + F.round((F.col("turn") % 13 - 1) * (F.col("end_us") - F.col("start_us")) / 10).cast("long")
    day = F.when(F.col("turn") % 7 == 0, "Monday").otherwise(F.col("day"))
    flows = rows.select("seq", at.alias("ts_us"), day.alias("folder"), pick(F.col("turn")).alias("src_ip"), pick(F.floor(F.col("turn") / 6)).alias("dst_ip"))
    return labeling.by_interval(flows, w, F.col("folder")).select("seq", "label", "attack_type")


@query(f"""
WITH {FLOW_SQL}, g AS (SELECT ts_us, src_ip, dst_ip, dst_port FROM f WHERE seq % 5 = 0)
SELECT f.seq, CAST(count(g.ts_us) > 0 AS INT) AS label, CASE WHEN count(g.ts_us) > 0 THEN 'backdoor' ELSE 'benign' END AS attack_type
FROM f LEFT JOIN g ON g.src_ip = f.src_ip AND g.dst_ip = f.dst_ip AND g.dst_port = f.dst_port AND abs(g.ts_us + 300000 - f.ts_us) <= 1000000 GROUP BY f.seq
""")
def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that a ground truth has at most a second away; the truth is a table of texts."""
    flows = flow_rows(spark, sf_dir)
    truth = flows.where("seq % 5 = 0").select(F.format_string("%.6f", (F.col("ts_us") + 300_000) / 1e6).alias("ts"), "src_ip", "dst_ip", F.col("src_port").cast("string").alias("src_port"), F.col("dst_port").cast("string").alias("dst_port"), F.lower("proto").alias("proto"))
    return labeling.by_truth(flows, labeling.truth_rows(truth)).select("seq", "label", "attack_type")


@query(f"""
WITH {FLOW_SQL}, i AS (SELECT 'u' || k AS ip, CASE WHEN k % 10 = 0 THEN 'high' WHEN k % 10 IN (1, 2) THEN 'medium' ELSE 'low' END AS kind FROM range(30) t(k)),
x AS (SELECT f.seq, CASE WHEN count(*) FILTER (WHERE kind = 'high') > 0 THEN 'high' WHEN count(*) FILTER (WHERE kind = 'medium') > 0 THEN 'medium' WHEN count(*) FILTER (WHERE kind = 'low') > 0 THEN 'low' ELSE 'normal' END AS tier
      FROM f LEFT JOIN i ON i.ip = f.src_ip GROUP BY f.seq)
SELECT seq, tier, CASE tier WHEN 'high' THEN 'high_ip' WHEN 'medium' THEN 'medium_ip_strong' WHEN 'low' THEN 'low_notice_ip_freq' ELSE 'none' END AS rule, CAST(tier IN ('high', 'medium') AS INT) AS label,
       CASE WHEN tier = 'normal' THEN 'benign' ELSE 'mawi_' || tier END AS attack_type, tier <> 'high' AS keep FROM x
""")
def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows by weak indicators of their addresses, with the rows that cleaning keeps."""
    k = F.col("id")
    rows = spark.range(30).select(
        F.when(k % 10 == 0, "anomalous").when((k % 10).isin(1, 2), "suspicious").otherwise("notice").alias("label"), F.concat(F.lit("U"), k.cast("string")).alias("srcIP"),
        F.lit("").alias("srcPort"), F.lit("").alias("dstIP"), F.lit("x").alias("dstPort"), F.lit("4").alias("nbDetectors"),
    )
    notices = rows.where("label = 'notice'")
    found = labeling.indicators(rows.where("label <> 'notice'"), notices.unionByName(notices).unionByName(notices))
    return labeling.by_indicators(flow_rows(spark, sf_dir), found).select("seq", "tier", "rule", "label", "attack_type", "keep")


@query(f"""
WITH {FLOW_SQL}, l AS (SELECT DISTINCT src_ip, dst_ip FROM f WHERE seq % 400 = 0)
SELECT f.seq FROM f WHERE src_ip IN (SELECT src_ip FROM l) OR dst_ip IN (SELECT dst_ip FROM l)
""")
def reachable_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows that windows of a few labelled ones can see."""
    from weirflow.plans.pipelines import reachable

    flows = flow_rows(spark, sf_dir)
    labels = flows.where("seq % 400 = 0").select("identity_key")
    return reachable(flows, labels).select("seq")


@query(f"WITH {FLOW_SQL} SELECT min(seq) AS seq, 'u' || CAST(substr(src_ip, 2) AS INT) % 40 AS flow_id FROM f GROUP BY 2")
def first_of_each_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first flow of each id."""
    flows = flow_rows(spark, sf_dir).withColumn("flow_id", F.concat(F.lit("u"), (F.substring("src_ip", 2, 9).cast("int") % 40).cast("string")))
    return eve.first_by(flows, "flow_id", "seq").select("seq", "flow_id")


@query(f"WITH {FLOW_SQL}, k AS (SELECT DISTINCT 'f' || seq AS identity_key, seq AS label FROM f WHERE seq % 4 = 0) SELECT identity_key, CAST(label % 2 AS INT) AS label, 'c' || label % 3 AS subclass FROM k")
def exported_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a table of one row for each key."""
    from weirflow.sources.sinks import label_table

    rows = flow_rows(spark, sf_dir).where("seq % 4 = 0")
    old = rows.select("identity_key", F.lit(9).alias("binary_label"), F.lit("old").alias("attack_subclass"), F.lit(-1).cast("long").alias("seq"))
    new = rows.select("identity_key", (F.col("seq") % 2).cast("int").alias("binary_label"), F.concat(F.lit("c"), (F.col("seq") % 3).cast("string")).alias("attack_subclass"), "seq")
    return label_table(joins.last_wins(old.unionByName(new), "identity_key"))
