"""Readers of event logs (a JSON object on each line) and of the tables around them, and typed projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from weirflow.functions import coerce, identity, network, times


#: The field that holds a line that is no JSON object, and how lines are parsed: a line with one is left out.
_BAD = "_not_json"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "allowSingleQuotes": "false"}


def _struct(*names: str) -> StructType:
    # Strings take any JSON value as its text, so that nothing is lost to a type that a producer changes.
    return StructType([StructField(n, StringType()) for n in names])


FLOW = _struct("start", "end", "age", "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "state", "reason", "ttl", "alerted")
TCP = _struct("syn", "ack", "fin", "rst", "psh", "urg", "tcp_flags", "tcp_flags_ts", "tcp_flags_tc", "window")
HTTP = _struct("http_method", "method", "hostname", "http_host", "url", "http_user_agent", "user_agent", "status", "status_code")
EVENT = StructType(
    [StructField(n, StringType()) for n in ("timestamp", "event_type", "flow_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto")]
    + [StructField("flow", FLOW), StructField("http", HTTP), StructField("tls", _struct("version", "sni")), StructField("ip", _struct("ttl", "fragments")), StructField("inner", _struct("ttl", "fragments")), StructField("tcp", StringType()), StructField("netflow", StringType())]
)

_READ = StructType([*EVENT.fields, StructField(_BAD, StringType())])


#: Bytes that a file may have for its lines to be numbered, and files of a read, as powers of two.
_FILE_BITS, _FILES_BITS = 43, 20


def line_number(rows: DataFrame) -> Column:
    """A number for each row of files that are read by line, in the order of file names and of lines in a file.

    It is the place of the file among their names, then the first byte of the row's split, then the row's place in its task: a task
    reads a split in order and never more rows than a split has bytes, so that rows of later splits have larger numbers, however splits are
    packed into tasks. Nothing is counted or sorted. rows must come from the reader without an exchange.
    """
    # The two ways to a local file's name differ in its slashes.
    files = sorted(re.sub("^file:/+", "file:/", f) for f in rows.inputFiles())
    if len(files) >= 1 << _FILES_BITS:
        raise ValueError("too many files for one read: read folders apart and unite them")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    inside = F.col("_metadata.file_block_start") + place
    if len(files) <= 1:
        return inside
    # A search in the sorted names: as many steps as the number of files has bits.
    rank = F.lit(0)
    names = F.split(F.lit("\n".join(files)), "\n")  # one literal
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    for step in [1 << k for k in reversed(range(len(files).bit_length()))]:
        rank = rank + F.when(F.coalesce(F.get(names, rank + (step - 1)) < path, F.lit(False)), step).otherwise(0)
    return F.shiftleft(rank.cast("long"), _FILE_BITS) + inside


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """value, path, seq: the lines of log files; seq orders lines by the name of their file and the place in it (see line_number)."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("path"), line_number(rows).alias("seq"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is evaluated once, whatever reads it later: it comes from a generator of one row.

    The array is a column before it is exploded. Spark takes the size of what a generator gives for that of its input, so that rows cut from a wide
    value would else be estimated at a thousandth of their size, and be broadcast.
    """
    held = fresh(df, f"{name}_held")
    return df.withColumn(held, F.array(value)).withColumn(name, F.explode(held)).drop(held)


def parsed(lines: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """lines with the event as a struct; lines that are no JSON object are left out.

    With types, a line is only parsed if its text can hold one of them.
    """
    if types:
        lines = lines.where(F.col("value").rlike(r'"event_type"\s*:\s*"\s*(?i:%s)\s*"' % "|".join(types)))
    # What is filtered or taken from the event later does not parse the line again.
    out = once(lines.where(F.trim("value").startswith("{")), "event", F.from_json("value", _READ, _OPTIONS)).where(F.col(f"event.{_BAD}").isNull())
    return out.where(F.lower(F.trim(F.col("event.event_type"))).isin(*types)) if types else out


def read_events(spark: SparkSession, path: str | list[str], types: tuple[str, ...] | None = None, most: int | None = None, recursive: bool = False) -> DataFrame:
    """Events of line-wise files; most keeps the first ones in the order of files and lines."""
    out = parsed(read_lines(spark, path, recursive), types)
    return out.orderBy("seq").limit(most) if most is not None else out


def is_line_wise(spark: SparkSession, path: str, lines: int = 50) -> bool:
    """Whether one of a file's first lines with text is a whole JSON value of its own."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect()]
    text = [x.strip() for x in head if x.strip()]
    return any(x.startswith("{") and x.endswith("}") for x in text) or not text


def read_any(spark: SparkSession, path: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Events of files, line-wise or pretty-printed: there an object ends with a brace at the start of a line, so that such files can be split too."""
    if is_line_wise(spark, path):
        return read_events(spark, path, types)
    rows = spark.read.text(path, lineSep="\n}")
    whole = F.concat(F.ltrim(F.regexp_replace("value", r"^[\s,\[]+", "")), F.lit("\n}"))
    rows = rows.select(whole.alias("value"), F.col("_metadata.file_path").alias("path"), line_number(rows).alias("seq"))
    return parsed(rows, types)


def flag(tcp: Column, field: str) -> Column:
    """Whether a field of a JSON object, given as a variant, is true; as JSON text strings keep their quotes, so that truth can be told from spelling."""
    return coerce.truthy(F.to_json(F.try_variant_get(tcp, f"$.{field}", "variant")))


def to_flows(events: DataFrame, dedupe: bool = False, benign_only: bool = False, need_flow: bool = True, bucket: float = 5.0) -> DataFrame:
    """Typed flow rows of events: keys, times, sizes and flags.

    benign_only leaves out flows that raised an alert and need_flow events without a flow object, both before any window sees them;
    dedupe keeps the first event of each flow id.
    """
    e = lambda name: F.col(f"event.{name}")
    rows = events.where(F.coalesce(F.lower(F.trim(e("event_type"))), F.lit("")) != "tcp")
    if need_flow:
        rows = rows.where(e("flow").isNotNull())
    if benign_only:
        rows = rows.where(F.coalesce(F.lower(e("flow.alerted")), F.lit("false")) != "true")
    is_object = F.coalesce(F.trim(e("tcp")).startswith("{"), F.lit(False))
    # As in parsed(): all flags come from one parse.
    tcp = fresh(rows, "tcp_object")
    rows = once(rows, tcp, F.try_parse_json(F.when(is_object, e("tcp"))))
    mark = lambda name: F.when(is_object & flag(F.col(tcp), name), 1).otherwise(0).cast("long")
    out = rows.select(
        "seq",
        times.event_us(e("flow.start"), e("flow.end"), e("timestamp")).alias("ts_us"),
        times.parsed_us(e("timestamp")).alias("event_us"),
        coerce.event_id(e("flow_id")).alias("flow_id"),
        coerce.address(e("src_ip")).alias("src_ip"),
        coerce.address(e("dest_ip")).alias("dst_ip"),
        coerce.safe_int(e("src_port")).alias("src_port"),
        coerce.safe_int(e("dest_port")).alias("dst_port"),
        coerce.protocol(e("proto")).alias("proto"),
        F.lower(F.trim(e("app_proto"))).alias("app_proto"),
        F.greatest(F.lit(0.0), coerce.safe_float(e("flow.age"))).alias("duration"),
        coerce.safe_int(e("flow.pkts_toserver")).alias("fwd_pkts"),
        coerce.safe_int(e("flow.pkts_toclient")).alias("rev_pkts"),
        coerce.safe_int(e("flow.bytes_toserver")).alias("fwd_bytes"),
        coerce.safe_int(e("flow.bytes_toclient")).alias("rev_bytes"),
        *[mark(n).alias(n) for n in ("syn", "ack", "rst", "fin", "psh", "urg")],
        is_object.cast("int").alias("has_tcp"),
    )
    out = out.withColumn("total_bytes", F.col("fwd_bytes") + F.col("rev_bytes"))
    flags = F.col("syn") + F.col("ack") + F.col("rst") + F.col("fin")
    out = out.withColumn("tcp_pkts", F.when(F.col("has_tcp") == 0, 0).otherwise(F.greatest(flags, F.lit(1))).cast("long"))
    key = identity.flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"), F.col("proto"), F.col("ts_us") / 1e6, bucket)
    out = out.withColumn("flow_key", key).withColumn("identity_key", identity.identity_key(F.col("flow_id"), key))
    return first_by(out, "flow_id", "seq") if dedupe else out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order; rows without a key all stay."""
    unique, n = fresh(df, "key"), fresh(df, "n")
    rows = df.withColumn(unique, F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col(order).cast("string"))))
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(unique).orderBy(order))).where(F.col(n) == 1).drop(unique, n)


def http_rows(events: DataFrame) -> DataFrame:
    """Requests with the method, host, URL, agent and status under either of their names."""
    e = lambda name: F.nullif(F.trim(F.col(f"event.{name}")), F.lit(""))
    return events.where(F.lower(F.trim(F.col("event.event_type"))) == "http").select(
        "seq",
        e("timestamp").alias("timestamp"),
        e("src_ip").alias("src_ip"),
        e("dest_ip").alias("dst_ip"),
        F.coalesce(e("http.http_method"), e("http.method"), F.lit("")).alias("http_method"),
        F.coalesce(e("http.hostname"), e("http.http_host"), F.lit("")).alias("http_host"),
        F.coalesce(e("http.url"), F.lit("")).alias("http_url"),
        F.coalesce(e("http.http_user_agent"), e("http.user_agent"), F.lit("")).alias("http_user_agent"),
        F.coalesce(e("http.status"), e("http.status_code"), F.lit("")).alias("http_status"),
    )


def mask(events: DataFrame) -> Column:
    """The TCP flag bits of each event."""
    tcp = F.col("event.tcp")
    text = lambda name: F.get_json_object(tcp, f"$.{name}")
    return network.flag_mask({n: flag(F.try_parse_json(tcp), n) for n in network.FLAG_BITS}, text("tcp_flags_ts"), text("tcp_flags_tc"), text("tcp_flags"))


def read_csv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """A table of strings: headers trimmed, lines that begin with # left out; seq, unless the table has such a column, orders its rows."""
    rows = spark.read.options(header=True, inferSchema=False, comment="#", mode="PERMISSIVE", **options).csv(path)
    names = [c.strip() for c in rows.columns]
    if "seq" in {n.lower() for n in names}:
        return rows.toDF(*names)
    return rows.select("*", line_number(rows).alias("seq")).toDF(*names, "seq")


def first_of(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first of several columns that df has (in any case), by row the first that is not null."""
    by_name = {c.strip().lower(): c for c in df.columns}
    there = [F.col(f"`{by_name[n.lower()]}`") for n in names if n.lower() in by_name]
    return F.coalesce(*there, *([default] if default is not None else [F.lit(None).cast("string")]))


def read_labels(df: DataFrame) -> DataFrame:
    """Labels by identity key from a label table under its various headers; seq keeps the order of rows (see last_wins).

    The order is the table's column seq, as read_csv() gives it; a table without one, which has no order of rows, gets the hash of the label.
    """
    have = {c.strip().lower() for c in df.columns}
    if not have & {"binary_label", "label"}:
        raise ValueError("a label table needs a column binary_label or label")
    flow_id = coerce.label_id(first_of(df, "flow_id"))
    seconds = times.label_us(first_of(df, "timestamp", "ts")) / 1e6
    made = identity.flow_key(first_of(df, "src_ip"), first_of(df, "src_port"), first_of(df, "dst_ip", "dest_ip"), first_of(df, "dst_port", "dest_port"), first_of(df, "protocol", "proto"), seconds)
    key = F.coalesce(F.nullif(F.trim(first_of(df, "flow_key")), F.lit("")), made)
    out = df.select(
        identity.identity_key(flow_id, key).alias("identity_key"),
        coerce.binary_label(first_of(df, "binary_label", "label")).alias("binary_label"),
        coerce.table_text(first_of(df, "attack_subclass", "attack_type")).alias("attack_subclass"),
        *([first_of(df, "seq").cast("long").alias("seq")] if "seq" in have else []),
    )
    return out if "seq" in have else out.withColumn("seq", F.xxhash64("binary_label", "attack_subclass"))


#: The headers under which a scoring table may have its addresses and ports.
ALIASES = {
    "src_ip": ("src_ip", "Source IP", "Src IP", "srcip"),
    "dst_ip": ("dst_ip", "dest_ip", "Destination IP", "Dst IP", "dstip"),
    "src_port": ("src_port", "Source Port", "Src Port"),
    "dst_port": ("dst_port", "dest_port", "Destination Port", "Dst Port"),
    "timestamp": ("timestamp", "Timestamp", "timestamp_epoch"),
}


def scoring_rows(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A table's rows with the features asked for (0 where it has none) and addresses, ports and time under their usual names."""
    return df.select(*[coerce.safe_float(first_of(df, n)).alias(n) for n in names], *[first_of(df, *a).alias(k) for k, a in ALIASES.items()])


def by_name(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The columns that a model wants, in its order; those that df lacks are 0, others are left out."""
    return df.select(*[(F.col(n).cast("double") if n in df.columns else F.lit(0.0)).alias(n) for n in names])


def from_flat(df: DataFrame) -> DataFrame:
    """Events, as JSON lines, of flat flow records: a duration of 0 or less becomes a millisecond, and flags are set as for an established flow."""
    lasts = F.when(coerce.safe_float(F.col("duration")) <= 0, 0.001).otherwise(coerce.safe_float(F.col("duration")))
    whole = lambda n: coerce.safe_int(F.col(n)) if n in df.columns else F.lit(0).cast("long")
    event = F.struct(
        F.col("timestamp").cast("string").alias("timestamp"), F.lit("flow").alias("event_type"), F.col("flow_id").cast("string").alias("flow_id"), "src_ip", whole("src_port").alias("src_port"), F.col("dst_ip").alias("dest_ip"), whole("dst_port").alias("dest_port"), coerce.protocol(F.col("proto")).alias("proto"),
        F.struct(F.col("timestamp").cast("string").alias("start"), lasts.alias("age"), whole("pkts_toserver").alias("pkts_toserver"), whole("pkts_toclient").alias("pkts_toclient"), whole("bytes_toserver").alias("bytes_toserver"), whole("bytes_toclient").alias("bytes_toclient")).alias("flow"),
        F.struct(F.lit(True).alias("syn"), F.lit(True).alias("ack")).alias("tcp"),
    )
    return df.select(F.to_json(event).alias("value"))


#: The first of the ids that are given to flows without one.
FIRST_ID = 0xDEC0DE0000000000


def with_ids(df: DataFrame, order: list[Column], force: bool = False) -> DataFrame:
    """df (with flow_id and event_type) where flows without an id get one by their place in the order."""
    lacks = (F.col("event_type") == "flow") & (F.lit(True) if force else coerce.event_id(F.col("flow_id")).isNull())
    place = F.sum(lacks.cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    made = F.concat(F.lit(f"{FIRST_ID >> 32:X}"), F.lpad(F.hex(place), 8, "0"))
    return df.withColumn("flow_id", F.when(lacks, F.lower(made)).otherwise(F.col("flow_id")))


def synthetic_scan(spark: SparkSession, rows: int, seed: int = 42, scanners: int = 2, targets: int = 50) -> DataFrame:
    """Seeded flow events, as JSON lines, of a few sources that try ports of many targets."""
    pick = lambda k, n: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(n)).cast("int")
    at = F.date_format(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 250_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    event = F.struct(
        at.alias("timestamp"), F.lit("flow").alias("event_type"), (F.lit(10_000) + F.col("id")).cast("string").alias("flow_id"),
        F.concat(F.lit("10.9.0."), (pick(1, scanners) + 1).cast("string")).alias("src_ip"), (pick(2, 20_000) + 40_000).alias("src_port"),
        F.concat(F.lit("192.168.1."), (pick(3, targets) + 1).cast("string")).alias("dest_ip"), (pick(4, 1024) + 1).alias("dest_port"), F.lit("TCP").alias("proto"),
        F.struct(at.alias("start"), (pick(5, 100) / 100).alias("age"), (pick(6, 3) + 1).alias("pkts_toserver"), pick(7, 2).alias("pkts_toclient"), (pick(6, 3) * 60 + 60).alias("bytes_toserver"), (pick(7, 2) * 54).alias("bytes_toclient")).alias("flow"),
        F.struct(F.lit(True).alias("syn"), (pick(7, 2) == 1).alias("rst")).alias("tcp"),
    )
    return spark.range(rows).select(F.to_json(event).alias("value"))


#: The names under which netflow records have each measure.
NETFLOW_NAMES = {
    "pkt_rate": ("pkt_rate", "packet_rate", "pktrate", "pkt_per_sec"),
    "byte_rate": ("byte_rate", "bytes_rate", "byterate", "byte_per_sec"),
    "iat_min": ("iat_min", "iatmin", "inter_arrival_min"),
    "iat_max": ("iat_max", "iatmax", "inter_arrival_max"),
    "iat_avg": ("iat_avg", "iatmean", "iat_mean", "inter_arrival_avg"),
}


def netflow_metrics(events: DataFrame, bucket: float = 5.0) -> DataFrame:
    """seq, ts_us, flow_key and rates and gaps of netflow records: each measure under the first of its names that holds a finite number, null without one.

    Records without any measure are left out.
    """
    e = lambda name: F.col(f"event.{name}")
    rows = events.where(F.lower(F.trim(e("event_type"))) == "netflow")

    def finite(name: str) -> Column:
        number = F.get_json_object(e("netflow"), f"$.{name}").try_cast("double")
        return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)

    at = times.event_us(e("flow.start"), e("flow.end"), e("timestamp"))
    out = rows.select(
        "seq", at.alias("ts_us"),
        identity.flow_key(e("src_ip"), e("src_port"), e("dest_ip"), e("dest_port"), e("proto"), at / 1e6, bucket).alias("flow_key"),
        *[F.coalesce(*[finite(n) for n in names]).alias(measure) for measure, names in NETFLOW_NAMES.items()],
    )
    return out.where(F.coalesce(*NETFLOW_NAMES).isNotNull())
