"""Queries that read and write tables and logs, and scalar functions that others leave out; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import coerce, decisions, network, times
from weirflow.operators import context, sampling, sets
from weirflow.plans import pipelines
from weirflow.plans.queries import _CONTEXT, _SCORED, E_SQL, FLOW_SQL, RULES, event_lines, event_rows, flow_rows, query, rounded, scored_rows, table
from weirflow.sources import eve, sinks
from weirflow.sources.scratch import new_folder

#: SQL of a time as text, with the fraction only where there is one.
_ISO = "CASE WHEN ts_us % 1000000 = 0 THEN strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') END"

# --- logs and tables that are written and read again ----------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the event log in files of unlike size, lines of other kinds and broken ones among them."""
    path = new_folder(spark, "log")
    lines = event_lines(spark, sf_dir)
    other = lines.where("seq % 10 = 0").select(
        F.when(F.col("seq") % 20 == 0, F.concat(F.lit('{"event_type": "dns", "flow_id": "'), F.col("seq").cast("string"), F.lit('"}')))
        .otherwise(F.substring("value", 1, 40)).alias("value"), "seq"
    )
    rows = lines.select("value", "seq").unionByName(other).withColumn("file", F.when(F.col("seq") % 3 == 0, "a").otherwise(F.when(F.col("seq") % 100 == 1, "b").otherwise("c")))
    rows.repartition("file").sortWithinPartitions("file", "seq").select("file", "value").write.partitionBy("file").text(path)
    return path


@query("SELECT 'f' || event_id AS flow_id, 'u' || user_id AS src_ip FROM events")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a folder of logs, found below it; other kinds and broken lines are left out."""
    events = eve.read_events(spark, _log(spark, sf_dir), ("flow",), recursive=True)
    return events.select("event.flow_id", "event.src_ip")


@query("SELECT count(*) + count(*) FILTER (WHERE event_id % 20 = 0) AS n, count(*) FILTER (WHERE event_id % 20 = 0) AS n_dns FROM events")
def log_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a folder of logs."""
    events = eve.read_events(spark, _log(spark, sf_dir), recursive=True)
    return events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event.event_type") == "dns").alias("n_dns"))


@query("SELECT 'f' || event_id AS flow_id FROM events WHERE event_id % 3 = 0 ORDER BY event_id LIMIT 300")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 flows in the order of files and lines."""
    return eve.read_events(spark, _log(spark, sf_dir), ("flow",), most=300, recursive=True).select("event.flow_id")


@query("SELECT 'f' || event_id AS flow_id, CAST(event_id AS BIGINT) AS place FROM events WHERE event_id % 100 = 1 AND event_id % 3 <> 0")
def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one file in the order of their numbers: the place of each by its id, which rises there."""
    events = eve.read_events(spark, _log(spark, sf_dir), ("flow",), recursive=True).where("path like '%file=b%'")
    ranked = sampling.is_in_order(events.select("seq", F.substring("event.flow_id", 2, 20).cast("long").alias("place")), "place", "seq")
    rows = events.select("event.flow_id", F.substring("event.flow_id", 2, 20).cast("long").alias("place"))
    return rows.crossJoin(F.broadcast(ranked.where("in_order").select(F.lit(1).alias("one")))).drop("one")


@query("SELECT 'f' || event_id AS flow_id, 'u' || user_id AS src_ip FROM events WHERE event_id < 300")
def pretty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of a file that is pretty-printed over many lines."""
    path = new_folder(spark, "pretty")
    line = F.regexp_replace(F.regexp_replace("value", ",", ",\n  "), r"\}$", "\n}")
    event_lines(spark, sf_dir).where("seq < 300").select(line.alias("value")).coalesce(1).write.text(path)
    return eve.read_any(spark, path, ("flow",)).select("event.flow_id", "event.src_ip")


def _csv(df: DataFrame, label: str) -> str:
    path = new_folder(df.sparkSession, label)
    sinks.table(df, path, "csv")
    return path


@query("""
SELECT CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'u' || user_id || ':5-h:0-UDP_' || CAST(epoch_us(ts) // 5000000 AS VARCHAR) END AS identity_key,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS binary_label, CASE WHEN event_type = 'error' THEN 'DoS' ELSE '' END AS attack_subclass FROM events
""")
def label_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a table of texts: ids that went through a float, missing ones under several spellings, times in seconds and milliseconds."""
    e = event_rows(spark, sf_dir)
    odd = F.when(F.col("seq") % 4 == 1, "NaN").when(F.col("seq") % 4 == 3, "")
    label = F.when(F.col("event_type") == "error", "Attack").when(F.col("event_type") == "click", "0.0").otherwise(" benign ")
    at = F.when(F.col("seq") % 3 == 0, F.floor(F.col("ts_us") / 1000).cast("string")).otherwise(times.iso_text(F.col("ts_us")))
    rows = e.select(
        F.when(F.col("seq") % 2 == 0, F.concat(F.col("seq").cast("string"), F.lit(".0"))).otherwise(odd).alias("Flow_ID"), label.alias("Label"), F.concat(F.lit(" u"), F.col("user_id").cast("string")).alias("SRC_IP"),
        F.lit("5").alias("src_port"), F.lit("h").alias("dest_ip"), F.lit("x").alias("dest_port"), F.lit("udp").alias("proto"), at.alias("timestamp"), F.when(F.col("event_type") == "error", "DoS").otherwise("None").alias("attack_type"),
    )
    return eve.read_labels(eve.read_csv(spark, _csv(rows, "labels"))).select("identity_key", "binary_label", "attack_subclass")


@query(f"WITH {FLOW_SQL} SELECT 'u' || user_id AS src_ip, CAST(seq % 3 AS DOUBLE) AS has_tcp, CAST(0 AS DOUBLE) AS flow_rate_src_10s, CAST(k AS VARCHAR) AS dst_port FROM e")
def scoring_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring table under other headers: a feature that it lacks is 0."""
    e = event_rows(spark, sf_dir)
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("Source IP"), F.col("k").alias("Destination Port"), (F.col("seq") % 3).alias("has_tcp"))
    return eve.scoring_rows(eve.read_csv(spark, _csv(rows, "scoring")), ("has_tcp", "flow_rate_src_10s")).select("src_ip", "has_tcp", "flow_rate_src_10s", "dst_port")


@query("SELECT event_id AS seq, CAST(least(1, event_id % 3) AS DOUBLE) AS has_tcp, CAST(greatest(0, value - 10) AS DOUBLE) AS flow_rate_src_10s FROM events")
def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that were written and are read again, within their bounds."""
    path = new_folder(spark, "features")
    e = event_rows(spark, sf_dir)
    sinks.feature_cache(e.select("seq", (F.col("seq") % 3).cast("double").alias("has_tcp"), (F.col("value") - 10).alias("flow_rate_src_10s")), path)
    return sinks.cached_features(spark, path, ("has_tcp", "flow_rate_src_10s"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'attack' ELSE 'benign' END AS part FROM customer")
def split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack and benign rows in folders of their own, read again."""
    path = new_folder(spark, "split")
    sinks.split_tables(table(spark, sf_dir, "customer"), path, F.col("c_acctbal") < 0)
    return spark.read.option("header", True).csv(path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "part")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def table_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV, read, written as Parquet in parts, and read again."""
    c = eve.read_csv(spark, _csv(table(spark, sf_dir, "customer"), "csv")).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    path = new_folder(spark, "parquet")
    sinks.table(c.repartition(5), path)
    return spark.read.parquet(path)


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS n_unique FROM (SELECT c_custkey FROM customer LIMIT 250)")
def capped_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "capped")
    sinks.capped_table(table(spark, sf_dir, "customer"), path, 250)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("n_unique"))


@query(f"""
WITH {FLOW_SQL}, {_SCORED}
SELECT {_ISO} AS timestamp, src_ip, CAST(dst_port AS BIGINT) AS dst_port, decision <> 'LOW' AS is_attack,
       round(probability, 6) AS confidence, round(probability, 6) AS risk_score, round(anomaly, 6) AS anomaly_score_if, CASE decision WHEN 'HIGH' THEN 'BLOCK' WHEN 'MEDIUM' THEN 'ALERT' ELSE 'ALLOW' END AS action FROM d
""")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of decisions, appended as JSON lines in two parts and read again."""
    path, rows = new_folder(spark, "decisions"), pipelines.decided(scored_rows(spark, sf_dir))
    for part in (0, 1):
        sinks.append_json(sinks.decision_rows(rows.where(F.col("seq") % 2 == part)), path)
    kinds = "timestamp string, src_ip string, dst_port long, is_attack boolean, confidence double, risk_score double, anomaly_score_if double, action string"
    return spark.read.schema(kinds).json(path)


@query("SELECT 'f' || event_id AS flow_id FROM events WHERE user_id % 5 = 0")
def chosen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of some sources as they came, written in the order of time and parsed again."""
    path = new_folder(spark, "lines")
    rows = eve.parsed(event_lines(spark, sf_dir)).where(F.substring("event.src_ip", 2, 9).cast("long") % 5 == 0)
    sinks.original_lines(rows, path, [F.col("event.timestamp"), F.col("seq")])
    return eve.read_events(spark, path).select("event.flow_id")


@query("""
SELECT 'k' || c_custkey AS flow_key, CASE WHEN c_acctbal < 0 THEN '0.000' WHEN c_acctbal < 2000 THEN '0.400' WHEN c_acctbal < 5000 THEN '0.700' ELSE '1.000' END AS sample_weight,
       'mawi_' || CASE WHEN c_acctbal < 0 THEN 'high' WHEN c_acctbal < 2000 THEN 'medium' WHEN c_acctbal < 5000 THEN 'low' ELSE 'normal' END AS risk, c_mktsegment AS rule FROM customer
""")
def weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training weights of weakly labelled rows."""
    b = F.col("c_acctbal")
    tier = F.when(b < 0, "high").when(b < 2000, "medium").when(b < 5000, "low").otherwise("normal")
    return sinks.weights(table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("flow_key"), tier.alias("tier"), F.col("c_mktsegment").alias("rule")))


@query(f"""
WITH {FLOW_SQL}
SELECT '14-02-2018' AS dataset_day, src_ip, dst_ip, CAST(dst_port AS VARCHAR) AS dst_port, CASE WHEN seq % 2 = 0 THEN 'f' || seq ELSE '' END AS flow_id, CASE WHEN seq % 2 = 0 THEN '14-02-2018-f' || seq ELSE src_ip || ':40000-' || dst_ip || ':' || dst_port || '-TCP-' || CAST(ts_us // 1000000 AS VARCHAR) END AS flow_key, '' AS http_url FROM f
""")
def truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in the columns of a label table."""
    flows = flow_rows(spark, sf_dir).withColumn("flow_id", F.when(F.col("seq") % 2 == 0, F.col("flow_id"))).withColumn("dst_port", F.col("dst_port").cast("string"))
    out = pipelines.ground_truth(flows, F.lit("14-02-2018"))
    return out.select("dataset_day", "src_ip", "dst_ip", "dst_port", "flow_id", "flow_key", "http_url")


# --- projections and filters --------------------------------------------------------------------------------------------------------


@query(f"""
WITH {FLOW_SQL}
SELECT seq, CASE WHEN seq % 4 = 0 OR duration <= 0 THEN 0.001 ELSE CAST(duration AS DOUBLE) END AS duration, fwd AS fwd_bytes, CAST(1 AS BIGINT) AS syn, CAST(1 AS BIGINT) AS ack, 'UDP' AS proto FROM f
""")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records turned into events and parsed as such."""
    flows = flow_rows(spark, sf_dir)
    lasts = F.when(F.col("seq") % 4 == 0, 0.0).otherwise(F.col("duration"))
    flat = flows.select("seq", times.iso_text(F.col("ts_us")).alias("timestamp"), "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", F.lit("udp").alias("proto"), lasts.alias("duration"), F.col("fwd_bytes").alias("bytes_toserver"))
    # The id is read from the event again, as lines have no other number.
    out = eve.to_flows(eve.parsed(eve.from_flat(flat).withColumn("seq", F.lit(0).cast("long"))))
    return out.select(F.substring("flow_id", 2, 20).cast("long").alias("seq"), "duration", "fwd_bytes", "syn", "ack", "proto")


@query(f"WITH {FLOW_SQL} SELECT seq FROM f WHERE seq % 3 <> 0 AND seq % 5 <> 0")
def benign_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that raised no alert and have a flow object: every third raised one, every fifth lacks one."""
    lines = event_lines(spark, sf_dir)
    alerted = F.when(F.col("seq") % 3 == 0, F.regexp_replace("value", '"flow":\\{', '"flow":{"alerted":true,')).otherwise(F.col("value"))
    bare = F.when(F.col("seq") % 5 == 0, F.regexp_replace(alerted, '"flow":\\{', '"other":{')).otherwise(alerted)
    return eve.to_flows(eve.parsed(lines.select("seq", bare.alias("value")), ("flow",)), benign_only=True).select("seq")


@query(f"""
WITH {FLOW_SQL}
SELECT seq, CASE seq % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE '' END AS http_method, CASE seq % 2 WHEN 0 THEN 'h' || seq ELSE 'g' || seq END AS http_host, CASE WHEN seq % 5 = 0 THEN '' ELSE '/' || seq END AS http_url, '200' AS http_status FROM f
""")
def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under either of their field names."""
    s = F.col("seq")
    body = F.struct(
        F.when(s % 3 == 0, "GET").alias("http_method"), F.when(s % 3 == 1, "POST").alias("method"), F.when(s % 2 == 0, F.concat(F.lit(" h"), s.cast("string"))).alias("hostname"),
        F.concat(F.lit("g"), s.cast("string")).alias("http_host"), F.when(s % 5 != 0, F.concat(F.lit("/"), s.cast("string"))).alias("url"), F.lit(200).alias("status"),
    )
    lines = event_rows(spark, sf_dir).select("seq", F.to_json(F.struct(F.lit(" HTTP ").alias("event_type"), body.alias("http"))).alias("value"))
    return eve.http_rows(eve.parsed(lines)).select("seq", "http_method", "http_host", "http_url", "http_status")


@query("""
SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'dec0de00' || lpad(lower(to_hex(row_number() OVER (PARTITION BY event_id % 4 = 0 ORDER BY event_id) - 1)), 8, '0') ELSE 'x' || event_id END AS flow_id FROM events
""")
def given_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows without an id get one by their place."""
    e = event_rows(spark, sf_dir).select("seq", F.lit("flow").alias("event_type"), F.when(F.col("seq") % 4 == 0, F.when(F.col("seq") % 8 == 0, "nan")).otherwise(F.concat(F.lit("x"), F.col("seq").cast("string"))).alias("flow_id"))
    return eve.with_ids(e, [F.col("seq")]).select("seq", "flow_id")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 WHEN c_acctbal > 1 THEN 1.0 WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS has_tcp,
       CASE WHEN c_custkey % 3 = 0 THEN 0.0 WHEN c_acctbal > 1 THEN 1.0 WHEN c_acctbal < -1 THEN -1.0 ELSE c_acctbal END AS iat_autocorr_srcdst_300s FROM customer
""")
def sane_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are missing, not finite or out of bounds."""
    from weirflow.operators.features import sane_all

    c = table(spark, sf_dir, "customer")
    bad = F.when(F.col("c_custkey") % 9 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 9 == 3, F.lit(float("inf"))).when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    return sane_all(c.select("c_custkey", bad.alias("has_tcp"), bad.alias("iat_autocorr_srcdst_300s")))


@query("SELECT c_custkey, c_acctbal AS balance, CAST(0 AS DOUBLE) AS has_tcp FROM customer")
def by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a model wants, 0 for those that a table lacks."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "balance")
    return eve.by_name(c.withColumn("c_custkey", F.col("c_custkey").cast("double")), ("c_custkey", "balance", "has_tcp")).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT o_orderkey, o_orderpriority AS kind FROM orders WHERE o_orderkey % 7 NOT IN (0, 1, 2)")
def attack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name an attack."""
    k = F.col("o_orderkey") % 7
    kind = F.when(k == 0, " Benign").when(k == 1, "nan").when(k == 2, F.lit(None)).otherwise(F.col("o_orderpriority"))
    return sets.attack_rows(table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind")), "kind")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 1")
def valid_benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have both a label and an id."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 4 == 0, F.when(key % 8 == 0, " NaN ")).otherwise("BENIGN").alias("label"), F.when(key % 6 == 1, "").otherwise(key.cast("string")).alias("flow_id"))
    return sets.valid_benign(rows, "label", "flow_id").select("o_orderkey")


@query("SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS custkey, CAST(NULL AS VARCHAR) AS other FROM customer")
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of one kind put together: repeated headers and empty rows go, columns come in one order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name "), F.col("c_custkey").cast("string").alias("custkey"))
    dirty = c.unionByName(spark.createDataFrame([("name", "custkey"), (None, None)], "`name ` string, custkey string"))
    return sets.aligned(sets.without_headers(dirty), ("name", "custkey", "other"))


@query(f"WITH {FLOW_SQL} SELECT seq, least(CAST(duration AS DOUBLE) * 1e6, 1e6) AS duration, least(fwd * 1e8, 1e9) AS size FROM f")
def clipped_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flow_rows(spark, sf_dir)
    a, b = network.clipped_extremes(F.col("duration") * 1e6, F.col("fwd_bytes") * 1e8)
    return flows.select("seq", a.alias("duration"), b.alias("size"))


# --- samples -----------------------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT *, least(n, 100) AS base, n - least(n, 100) AS spare, 30 + row_number() OVER (ORDER BY source) AS k FROM s)
SELECT CAST(sum(least(n, 100)) AS BIGINT) AS wanted, count(*) AS sources, CAST((SELECT sum(n) FROM s) AS BIGINT) AS available FROM q
""")
def quota_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas clipped to what is there and filled up from what others can spare: the total that was asked for."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("available")).withColumn("quota", F.lit(100).cast("long"))
    total = sizes.agg(F.sum(F.least("available", F.lit(100)))).first()[0]
    made = sampling.capped_quotas(sizes, total, ["source"])
    return made.agg(F.sum("quota").alias("wanted"), F.count_if(F.col("quota") <= F.col("available")).alias("sources"), F.sum("available").alias("available"))


@query("""
WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), o AS (SELECT source, sum(n) AS w FROM s GROUP BY 1),
a AS (SELECT *, 300.0 * w / sum(w) OVER () AS raw FROM o), b AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, source) AS r FROM a),
q AS (SELECT source, CAST(base + CASE WHEN r <= 300 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b),
i AS (SELECT s.*, q.quota AS share, CAST(q.quota AS DOUBLE) * s.n / sum(s.n) OVER (PARTITION BY source) AS raw FROM s JOIN q USING (source)),
j AS (SELECT *, floor(raw) AS base, row_number() OVER (PARTITION BY source ORDER BY raw - floor(raw) DESC, lang) AS r FROM i)
SELECT source, lang, least(n, CAST(base + CASE WHEN r <= share - sum(base) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS BIGINT)) AS n, true AS all_different FROM j
""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by nested quotas: how many each stratum got, and that none came twice."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sizes = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    quotas = sampling.nested_quotas(sizes, 300, "source", "lang")
    drawn = sampling.quota_sample(d, quotas, ["source", "lang"], 42, "doc_id").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("doc_id").alias("u"))
    out = quotas.join(drawn, ["source", "lang"], "left")
    return out.select("source", "lang", F.coalesce("k", F.lit(0)).cast("long").alias("n"), (F.coalesce("k", F.lit(0)) == F.coalesce("u", F.lit(0))).alias("all_different"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_unique, true AS same_again FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 200)")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed sample of 200 events, the same when it is drawn from other partitions."""
    e = event_rows(spark, sf_dir).select("seq")
    one, two = sampling.sample(e, 200, 42, "seq"), sampling.sample(e.repartition(7), 200, 42, "seq")
    both = one.withColumn("a", F.lit(1)).join(two.withColumn("b", F.lit(1)), "seq", "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("n_unique"), (F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same_again"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 120")
def trimmed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.trimmed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 120, "o_totalprice", "o_orderkey")


@query("SELECT count(DISTINCT event_id) AS n, CAST(5 AS BIGINT) AS folds, true AS whole_users FROM events")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of whole users that hold every event."""
    rows = sampling.folds(table(spark, sf_dir, "events").withColumn("label", F.col("event_type") == "error"), "user_id", 5, "label")
    users = rows.groupBy("user_id").agg(F.countDistinct("fold").alias("k"), F.first("fold").alias("fold"), F.countDistinct("event_id").alias("n"))
    return users.agg(F.sum("n").alias("n"), F.countDistinct("fold").alias("folds"), (F.max("k") == 1).alias("whole_users"))


@query(f"WITH {E_SQL} SELECT CAST(4 AS BIGINT) AS ranges, true AS balanced, true AS apart")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of time of about equal size, one after the other."""
    rows = sampling.ranges(event_rows(spark, sf_dir), 4, "ts_us", "seq").groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    both = rows.alias("x").join(rows.alias("y"), F.col("y.range") == F.col("x.range") + 1, "left")
    return both.agg(F.count(F.lit(1)).alias("ranges"), (F.max("x.n") < 1.2 * F.min("x.n")).alias("balanced"), (F.count_if(F.col("x.z") >= F.col("y.a")) == 0).alias("apart"))


# --- scalars -------------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {FLOW_SQL}
SELECT seq, CASE WHEN seq % 3 = 0 THEN '' ELSE 'Ab' END AS text, CASE WHEN k BETWEEN 0 AND 65 THEN k * 1000 END AS port, CASE WHEN k % 2 = 0 THEN '2018-02-1' || (k % 9) END AS path_day,
       CASE WHEN k % 2 = 1 THEN 'Friday' END AS weekday, epoch_us(TIMESTAMP '2018-02-14 10:32:00') + 18000000000 AS eastern, CASE WHEN k % 2 = 0 THEN 'benign' ELSE 'dos' END AS label,
       CAST(CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'view' THEN 0.4 WHEN event_type = 'click' THEN 0.7 ELSE 1.0 END AS DOUBLE) AS weight,
       {_ISO} AS iso,
       sha1(CAST(k AS VARCHAR)) AS sha1, sha256(CAST(k AS VARCHAR)) AS sha256,
       lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(CAST(k AS VARCHAR), ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0') AS fnv
FROM e
""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, ports, dates in paths, wall clocks, labels, weights and hashes."""
    e = event_rows(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    path = F.when(k % 2 == 0, F.concat(F.lit("/data/1"), (k % 9).cast("string"), F.lit("-02-2018/eve.json"))).otherwise("/data/FRIDAY/x.json")
    level = F.when(kind == "error", "high").when(kind == "view", "medium").when(kind == "click", "low").otherwise("normal")
    text = F.when(F.col("seq") % 6 == 0, " NaN ").when(F.col("seq") % 6 == 3, "<NA>").otherwise(" Ab")
    return e.select(
        "seq", coerce.table_text(text).alias("text"), coerce.port((k * 1000).cast("string")).alias("port"), times.path_date(path).cast("string").alias("path_day"), times.path_weekday(path).alias("weekday"),
        times.wall_us(F.lit("2018-02-14 10:32:00"), "America/New_York").alias("eastern"), coerce.plain_label(F.when(k % 4 == 0, "Normal").when(k % 4 == 2, " BACKGROUND").otherwise("DoS")).alias("label"),
        decisions.sample_weight(level).alias("weight"), times.iso_text(F.col("ts_us")).alias("iso"), F.sha1(k.cast("string")).alias("sha1"), F.sha2(k.cast("string"), 256).alias("sha256"), network.fnv1a(k.cast("string")).alias("fnv"),
    )


_RATES = "CASE WHEN duration > 0 THEN {} / duration ELSE 0 END"


@query(f"""
WITH {FLOW_SQL}, p AS (SELECT *, fwd_pkts + rev_pkts AS pk, fwd + rev AS total FROM f)
SELECT seq, CASE WHEN fwd_pkts <= 0 THEN 0 WHEN duration > 0 AND duration < 1.5 AND rev < 300 OR fwd_pkts > 3 AND rev_pkts <= 1 THEN 1 ELSE 0 END AS failed,
       CASE WHEN syn = 1 AND ack = 0 OR seq % 3 = 0 OR fwd_pkts > 0 AND rev_pkts = 0 THEN 1 ELSE 0 END AS failed_by_state,
       CAST(CASE WHEN seq % 4 = 0 THEN syn * 2 + ack * 16 + rst * 4 WHEN seq % 4 = 1 THEN 27 ELSE 2 END AS BIGINT) AS mask,
       CAST(CASE WHEN syn = 1 AND ack = 0 THEN 0.9 WHEN rst = 1 THEN 0.5 WHEN syn = 1 AND ack = 1 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS flag_score, seq % 4 IN (1, 2) AS safe, seq % 2 = 0 AS same_net,
       CASE WHEN pk > 0 THEN round(total / pk, 6) ELSE 0 END AS avg_pkt_size, round({_RATES.format('pk')}, 5) AS pkt_rate, round({_RATES.format('total')}, 4) AS byte_rate,
       round(CASE WHEN pk > 1 AND duration > 0 THEN duration / (pk - 1) ELSE 0 END, 6) AS iat_avg, round(fwd_pkts / pk, 6) AS src_pkts_ratio, CAST(seq % 2 AS DOUBLE) AS tls_sni_count,
       CASE WHEN seq % 3 = 0 THEN 0.0 ELSE round(((seq % 5) / 2.0) ** 2, 6) END AS ttl_variance, CAST(CAST(seq % 5 = 0 AS INT) AS DOUBLE) AS is_tls, CASE WHEN seq % 5 = 0 THEN 1.0 + (seq % 4) / 10.0 ELSE 0 END AS tls_version FROM p
""")
def flow_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed connections, flag masks and scores, address checks, and the plain measures of a flow."""
    f, s = flow_rows(spark, sf_dir), F.col("seq")
    fwd_p, rev_p, fwd, rev, lasts = (F.col(c) for c in ("fwd_pkts", "rev_pkts", "fwd_bytes", "rev_bytes", "duration"))
    on = {n: (F.col(n) > 0) & (s % 4 == 0) for n in ("syn", "ack", "rst", "fin")}
    # Without booleans the masks of both directions are united; the generic one counts where they say nothing.
    both, odd = (s % 4).isin(0, 1), F.when(s % 4 == 0, 0).when(s % 4 == 1, 27).otherwise(2)
    own = F.col("syn") * 2 + F.col("ack") * 16 + F.col("rst") * 4
    mask = network.flag_mask(on, F.when(s % 4 == 1, "0x1A"), F.when(both, F.when(s % 4 == 1, "03")), F.when(s % 4 == 0, "").otherwise("02"))
    state, reason = F.when(s % 6 == 0, "SYN_SENT"), F.when(s % 6 == 3, "Rejected by x")
    ip = F.when(s % 4 == 0, "10.1.2.3").when(s % 4 == 1, "8.8.8.8").when(s % 4 == 2, "2a00:1450::1").otherwise("224.0.0.5")
    version = F.concat(F.lit("TLS 1."), (s % 4).cast("string"))
    basics = network.basics(lasts, fwd, rev, fwd_p, rev_p)
    pace = network.rhythms(lasts, fwd, rev, fwd_p, rev_p, own, F.lit(0))
    more = network.advanced(fwd_p, rev_p, F.when(s % 2 == 1, "example.org"))
    ttl = network.evasion(F.when(s % 3 == 0, F.array(F.lit(64.0), F.lit(None).cast("double"))).otherwise(F.array(F.lit(64.0), 64.0 + s % 5)), F.lit("8"), F.lit(None).cast("string"))
    tls = network.tls_flags(F.lit("flow"), F.when(s % 5 == 0, " TLS "), version)
    digits = lambda c, n, name: F.round(c.cast("double"), n).alias(name)
    out = f.select(
        "seq", network.failed_connection(lasts, rev, fwd_p, rev_p).alias("failed"), network.failed_by_state(F.col("syn"), F.col("ack"), state, reason, fwd_p, rev_p).alias("failed_by_state"), mask.alias("mask"),
        network.flag_score(*[F.col(n) > 0 for n in ("syn", "ack", "fin", "rst")]).alias("flag_score"), network.safe_to_block(ip).alias("safe"),
        network.same_prefix(F.lit("10.0.0.7"), F.when(s % 2 == 0, "10.0.0.200").otherwise("10.0.1.7")).alias("same_net"), digits(basics["avg_pkt_size"], 6, "avg_pkt_size"), digits(pace["pkt_rate"], 5, "pkt_rate"),
        digits(pace["byte_rate"], 4, "byte_rate"), digits(pace["iat_avg"], 6, "iat_avg"), digits(more["src_pkts_ratio"], 6, "src_pkts_ratio"), more["tls_sni_count"].alias("tls_sni_count"),
        digits(ttl["ttl_variance"], 6, "ttl_variance"), tls["is_tls"].alias("is_tls"), tls["tls_version"].alias("tls_version"), odd.alias("odd"), own.alias("own"),
    )
    # A flow whose booleans are all false takes its mask from the texts.
    return out.withColumn("mask", F.when((s % 4 == 0) & (F.col("own") == 0), F.lit(0).cast("long")).otherwise(F.col("mask"))).drop("odd", "own")


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, m AS (SELECT event_type, min(anomaly) AS lo, max(anomaly) AS hi FROM d JOIN e USING (seq) GROUP BY 1)
SELECT d.seq, round(1 / (1 + exp(anomaly)), 6) AS sigmoid, round((hi - anomaly) / (hi - lo), 6) AS spread,
       CASE WHEN decision IN ('HIGH', 'LOW') THEN decision WHEN d.seq % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS assisted, CASE WHEN decision = 'HIGH' AND probability < 0.7 THEN 'MEDIUM' ELSE decision END AS capped,
       CASE WHEN probability > 0.9 THEN 'ATTACK' WHEN -anomaly < -0.12 THEN 'ANOMALY' ELSE 'BENIGN' END AS hybrid FROM d JOIN e USING (seq) JOIN m USING (event_type)
""")
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly scores of a batch, help from context, caps and the hybrid label."""
    # Both sides have a row for each event: they are shuffled at any size.
    d = pipelines.decided(scored_rows(spark, sf_dir)).join(event_rows(spark, sf_dir).select("seq", "event_type").hint("merge"), "seq")
    helper = F.when(F.col("seq") % 2 == 0, "HIGH").otherwise("LOW")
    out = d.select(
        "seq", decisions.anomaly_sigmoid(F.col("anomaly")).alias("sigmoid"), decisions.anomaly_spread(F.col("anomaly"), "event_type").alias("spread"), decisions.assisted(F.col("decision"), helper).alias("assisted"),
        decisions.capped(F.col("decision"), F.col("probability")).alias("capped"), decisions.hybrid_label(F.col("probability"), -F.col("anomaly")).alias("hybrid"),
    )
    return rounded(out, "sigmoid", "spread")


@query("SELECT event_id AS seq, 'x' || event_id || '\"' AS flow_id, 17 + length(CAST(event_id AS VARCHAR)) AS size FROM events")
def json_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with a quote in them: written as JSON, and read without parsing the whole line."""
    line = F.to_json(F.struct(F.concat(F.lit("x"), F.col("seq").cast("string"), F.lit('"')).alias("flow_id")))
    rows = event_rows(spark, sf_dir).select("seq", line.alias("value"))
    return rows.select("seq", F.get_json_object("value", "$.flow_id").alias("flow_id"), F.length("value").cast("long").alias("size"))


# --- context -------------------------------------------------------------------------------------------------------------------------

_ALL_EVENTS = """
x AS (SELECT 'distributed_attack' AS event_type, dst_ip AS key, ts_us, seq, dst_flows AS observed FROM g WHERE t1
  UNION ALL SELECT 'destination_port_fanout', dst_ip, ts_us, seq, dst_ports FROM g WHERE t2 UNION ALL SELECT 'source_flow_burst', src_ip, ts_us, seq, src_flows FROM g WHERE t3
  UNION ALL SELECT 'source_port_scan', src_ip, ts_us, seq, src_ports FROM g WHERE t4 UNION ALL SELECT 'source_dst_fanout', src_ip, ts_us, seq, src_hosts FROM g WHERE t5
  UNION ALL SELECT 'source_slow_scan', src_ip, ts_us, seq, (SELECT count(DISTINCT b.dst_port) FROM d b WHERE b.src_ip = g.src_ip AND b.ts_us >= g.ts_us - 400000000 AND b.seq <= g.seq) FROM g WHERE t6),
y AS (SELECT *, row_number() OVER (PARTITION BY event_type, key ORDER BY ts_us, seq) AS r FROM x)
"""


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, {_CONTEXT}, {_ALL_EVENTS}
SELECT event_type, key, ts_us, seq, CAST(observed AS BIGINT) AS observed FROM y WHERE r = 1
UNION ALL SELECT 'escalation', src_ip || '|' || dst_ip || '|' || dst_port, ts_us, seq, CAST(suspicious AS BIGINT) FROM g WHERE suspicious >= 2 AND decision IN ('LOW', 'MEDIUM')
""")
def context_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalations of pairs, and the first crossing of each threshold by each key."""
    return context.events(pipelines.decided(scored_rows(spark, sf_dir)), RULES)


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, {_CONTEXT},
r AS (SELECT seq, probability, CASE WHEN decision IN ('HIGH', 'LOW') THEN decision WHEN up THEN 'HIGH' ELSE 'MEDIUM' END AS merged FROM h),
last AS (SELECT seq, probability, CASE WHEN merged = 'HIGH' AND probability < 0.7 - 1e-9 THEN 'MEDIUM' ELSE merged END AS decision FROM r)
SELECT seq, round(probability, 6) AS risk, decision, CASE decision WHEN 'HIGH' THEN 'BLOCK' WHEN 'MEDIUM' THEN 'ALERT' ELSE 'ALLOW' END AS action FROM last
""")
def scored_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the model that context may raise and its own probability caps."""
    out = pipelines.decided(scored_rows(spark, sf_dir), pipelines.ScoreOptions(rules=RULES))
    return rounded(out.select("seq", "risk", "decision", "action"), "risk")


@query(f"""
WITH {FLOW_SQL}, {_SCORED}, c AS (SELECT DISTINCT ON (src_ip, ts_us // 1000000) src_ip, ts_us FROM d WHERE decision = 'HIGH' ORDER BY src_ip, ts_us // 1000000, ts_us),
n AS (SELECT src_ip, min(ts_us) AS first_us, count(*) AS asked FROM c GROUP BY 1)
SELECT src_ip, first_us AS blocked_us FROM n
""")
def first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each source was blocked first, under limits that no other source can take up."""
    blocks = context.block_list(pipelines.decided(scored_rows(spark, sf_dir)), context.BlockLimits(ttl=0, most=0, per_minute=0))
    return context.in_force(blocks, 1 << 62).select("src_ip", "blocked_us")
