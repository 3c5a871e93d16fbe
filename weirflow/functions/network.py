"""Scalar facts of a flow: services, flags, buckets, address ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.functions.stats import let, variance_of

HTTP_PORTS = (80, 443, 8080, 8000, 8443)
#: Bits of the TCP flags.
FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}


def service(dport: Column, proto: Column) -> Column:
    """dns, ssh, http or other, by port (and protocol, for http)."""
    return F.when(dport == 53, "dns").when(dport == 22, "ssh").when((F.upper(F.trim(F.coalesce(proto, F.lit("")))) == "TCP") & dport.isin(*HTTP_PORTS), "http").otherwise("other")


def failed_connection(duration: Column, rev_bytes: Column, fwd_pkts: Column, rev_pkts: Column) -> Column:
    """1 for a short flow with little answer, or many packets sent and at most one back; 0 if nothing was sent."""
    short = (duration > 0) & (duration < 1.5) & (rev_bytes < 300)
    return F.when(fwd_pkts <= 0, 0).when(short | ((fwd_pkts > 3) & (rev_pkts <= 1)), 1).otherwise(0)


def failed_by_state(syn: Column, ack: Column, state: Column, reason: Column, fwd_pkts: Column, rev_pkts: Column) -> Column:
    """1 for a flow that looks failed by its flags, state or asymmetry: the other rule of that name."""
    unanswered = (syn == 1) & (ack == 0)
    closed = F.lower(F.coalesce(state, F.lit(""))).isin("new", "syn_sent", "rejected") | F.lower(F.coalesce(reason, F.lit(""))).contains("reject")
    return (unanswered | closed | ((fwd_pkts > 0) & (rev_pkts == 0))).cast("int")


def hex_mask(value: Column) -> Column:
    """An integer from hexadecimal text with or without 0x, 0 if it is none."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), "^0x", "")
    return F.when(text.rlike("^[0-9a-f]+$"), F.conv(text, 16, 10).try_cast("long")).otherwise(F.lit(0).cast("long"))


def flag_mask(flags: dict[str, Column], to_server: Column, to_client: Column, generic: Column) -> Column:
    """The bits of all flags: from booleans if any is set, else from both directions' masks, else from the generic one."""
    own = F.lit(0).cast("long")
    for name, value in flags.items():
        own = own.bitwiseOR(F.when(value, F.lit(FLAG_BITS[name])).otherwise(0).cast("long"))
    both = hex_mask(to_server).bitwiseOR(hex_mask(to_client))
    return F.when(own != 0, own).when(both != 0, both).otherwise(hex_mask(generic))


def flag_score(syn: Column, ack: Column, fin: Column, rst: Column) -> Column:
    """How much a flow's flags look like scanning, 0 to 1."""
    return F.when(syn & ~ack & ~fin, 0.9).when(rst, 0.5).when(syn & ack, 0.2).otherwise(0.1)


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4_number(value: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    text = F.trim(value)
    parts = F.split(text, r"\.")
    number = F.lit(0).cast("long")
    for k in range(4):
        number = number * 256 + F.get(parts, F.lit(k)).try_cast("long")
    return F.when(text.rlike(_DOTTED), number)


def _in(number: Column, *ranges: tuple[str, int]) -> Column:
    out = F.lit(False)
    for base, bits in ranges:
        start = 0
        for part in base.split("."):
            start = start * 256 + int(part)
        out = out | number.between(start, start + (1 << (32 - bits)) - 1)
    return F.coalesce(out, F.lit(False))


#: IPv4 ranges that are not for the public network.
PRIVATE = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))


def private_address(value: Column) -> Column:
    v6 = F.lower(F.trim(value)).rlike(r"^(::1|::|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return _in(ipv4_number(value), *PRIVATE) | F.coalesce(v6, F.lit(False))


def safe_to_block(value: Column) -> Column:
    """Whether an address is a public unicast one."""
    number = ipv4_number(value)
    v6 = F.lower(F.trim(value)).rlike("^[23][0-9a-f]{3}:")
    return (number.isNotNull() & ~private_address(value) & ~_in(number, ("224.0.0.0", 4))) | F.coalesce(v6, F.lit(False))


def same_prefix(a: Column, b: Column, bits: int = 24) -> Column:
    width = 1 << (32 - bits)
    return F.coalesce(F.floor(ipv4_number(a) / width) == F.floor(ipv4_number(b) / width), F.lit(False))


def port_bucket(value: Column) -> Column:
    number = F.coalesce(value.try_cast("double"), F.lit(-1.0))
    return F.when(number < 0, "unknown").when(number <= 1023, "well_known").when(number <= 49151, "registered").otherwise("dynamic")


def duration_bucket(value: Column) -> Column:
    number = value.try_cast("double")
    unknown = number.isNull() | F.isnan(number)
    return F.when(unknown, "d_unknown").when(number <= 0.05, "d_micro").when(number <= 0.5, "d_short").when(number <= 2, "d_medium").when(number <= 10, "d_long").otherwise("d_very_long")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def basics(duration: Column, fwd_bytes: Column, rev_bytes: Column, fwd_pkts: Column, rev_pkts: Column) -> dict[str, Column]:
    """Six plain measures of a flow."""
    return {
        "duration": F.greatest(duration, F.lit(0.0)),
        "src_bytes": fwd_bytes.cast("double"),
        "dst_bytes": rev_bytes.cast("double"),
        "src_pkts": fwd_pkts.cast("double"),
        "dst_pkts": rev_pkts.cast("double"),
        "avg_pkt_size": ratio(fwd_bytes + rev_bytes, fwd_pkts + rev_pkts),
    }


def rhythms(duration: Column, fwd_bytes: Column, rev_bytes: Column, fwd_pkts: Column, rev_pkts: Column, flags: Column, urgent: Column) -> dict[str, Column]:
    """Seven measures of a flow's pace; its mean gap stands for least, greatest and mean gap."""
    packets, lasts = fwd_pkts + rev_pkts, F.greatest(duration, F.lit(0.0))
    gap = F.when((packets > 1) & (lasts > 0), lasts / (packets - 1)).otherwise(0.0)
    return {
        "pkt_rate": ratio(packets, lasts),
        "byte_rate": ratio(fwd_bytes + rev_bytes, lasts),
        "iat_min": gap,
        "iat_max": gap,
        "iat_avg": gap,
        "tcp_flag_count": flags.cast("double"),
        "urg_flag_count": urgent.cast("double"),
    }


def advanced(fwd_pkts: Column, rev_pkts: Column, sni: Column) -> dict[str, Column]:
    return {
        "src_pkts_ratio": F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(fwd_pkts, fwd_pkts + rev_pkts))),
        "dst_port_entropy": F.lit(0.0),
        "tls_sni_count": F.when(F.coalesce(sni, F.lit("")) != "", 1.0).otherwise(0.0),
    }


def evasion(ttls: Column, window: Column, fragments: Column) -> dict[str, Column]:
    """ttls is an array of what a flow's parts say, nulls for those that say nothing."""
    known = F.filter(ttls, lambda x: x.isNotNull() & ~F.isnan(x))
    return {"ttl_variance": let(known, variance_of), "tcp_window_size_avg": F.coalesce(window.try_cast("double"), F.lit(0.0)), "ip_fragment_count": F.coalesce(fragments.try_cast("double"), F.lit(0.0))}


def tls_flags(event_type: Column, app_proto: Column, version: Column) -> dict[str, Column]:
    is_tls = (F.lower(F.trim(F.coalesce(event_type, F.lit("")))) == "tls") | (F.lower(F.trim(F.coalesce(app_proto, F.lit("")))) == "tls")
    text, number = F.trim(F.coalesce(version, F.lit(""))), F.lit(0.0)
    for v in (1.3, 1.2, 1.1, 1.0):
        number = F.when(text.endswith(str(v)), F.lit(v)).otherwise(number)
    return {"is_tls": is_tls.cast("double"), "tls_version": F.when(is_tls, number).otherwise(0.0)}


def clipped_extremes(duration: Column, size: Column) -> tuple[Column, Column]:
    """Duration up to 1e6 seconds, bytes up to 1e9."""
    return F.least(duration, F.lit(1e6)), F.least(size, F.lit(1e9))


def fnv1a(value: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as hexadecimal text; digests of other kinds are xxhash64, sha1 and sha2."""
    data = F.hex(F.encode(value, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(2)), F.lit(2)), lambda i: F.conv(F.substring(data, i, 2), 16, 10).try_cast("long"))
    # The product by the prime modulo 2 ** 64, from halves of 32 bits so that nothing overflows.
    prime_low, prime_high = 0x1B3, 0x100

    def step(state, octet):
        low = state["low"].bitwiseXOR(octet)
        product = low * prime_low
        high = (state["high"] * prime_low + low * prime_high + F.shiftright(product, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(product.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), high.alias("high"))

    start = F.struct(F.lit(0x84222325).cast("long").alias("low"), F.lit(0xCBF29CE4).cast("long").alias("high"))
    out = F.aggregate(F.when(F.length(data) > 0, octets).otherwise(F.array().cast("array<long>")), start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0"))))
    return out
