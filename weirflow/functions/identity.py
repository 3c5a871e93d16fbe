"""Keys by which flows and labels meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.coerce import address, protocol, safe_int


def flow_key(src: Column, sport: Column, dst: Column, dport: Column, proto: Column, seconds: Column, bucket: float = 5.0) -> Column:
    """src:sport-dst:dport-PROTO_bucket, where a time that is missing, not a number or negative counts as 0."""
    valid = F.when(seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0), seconds).otherwise(0.0)
    return F.concat(address(src), F.lit(":"), safe_int(sport).cast("string"), F.lit("-"), address(dst), F.lit(":"), safe_int(dport).cast("string"), F.lit("-"), protocol(proto), F.lit("_"), F.floor(valid / bucket).cast("string"))


def identity_key(flow_id: Column, key: Column) -> Column:
    """The flow id where there is one, else the flow key."""
    return F.coalesce(flow_id, key)
