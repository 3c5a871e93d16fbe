"""The 45 features by plain lists: each row looks at all rows before it."""

import math
from collections import Counter

EPS = 1e-6


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n + EPS) for c in counts if c > 0) if n else 0.0


def deviation(x):
    m = sum(x) / len(x)
    return math.sqrt(sum((v - m) ** 2 for v in x) / len(x))


def gaps(times):
    times = sorted(times)
    return [(b - a) / 1e6 for a, b in zip(times, times[1:])]


def variation(x):
    return deviation(x) / (sum(x) / len(x) + EPS) if x else 0.0


def autocorrelation(v):
    if len(v) < 3:
        return 0.0
    x, y = v[:-1], v[1:]
    sx, sy = deviation(x), deviation(y)
    if sx <= EPS or sy <= EPS:
        return 0.0
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / len(x) / sx / sy


def simulate(rows):
    """rows: dicts of a flow in processing order; returns dicts of features."""
    out = []
    for i, r in enumerate(rows):
        def win(seconds, **same):
            return [p for p in rows[:i] if p["ts_us"] >= r["ts_us"] - seconds * 10**6 and all(p[k] == r[k] for k in same)]

        src = {"src_ip": 1}
        dst = {"dst_ip": 1}
        s10, s60, s300, s24 = win(10, **src), win(60, **src), win(300, **src), win(86400, **src)
        d10, d60 = win(10, **dst), win(60, **dst)
        p300, p24 = win(300, src_ip=1, dst_ip=1), win(86400, src_ip=1, dst_ip=1)
        alive = lambda w: sum(1 for p in w if r["ts_us"] <= p["ts_us"] + p["duration"] * 10**6)
        n60, n300 = len(s60), len(s300)
        tot = lambda w, k: sum(p[k] for p in w)
        several = lambda v: v if n300 > 1 else 0.0
        enough = lambda v: v if n60 >= 5 else 0.0
        cv = variation(gaps([p["ts_us"] for p in s60]))
        sizes = [p["total_bytes"] // 128 for p in s300]
        mode = max(dict.fromkeys(sizes), key=sizes.count) if sizes else 0
        dports = Counter(p["dst_port"] for p in s300)
        f = {
            "flow_rate_src_10s": len(s10) / 10, "flow_rate_src_60s": n60 / 60, "flow_rate_dst_10s": len(d10) / 10,
            "rate_ratio_src_10s_60s": len(s10) / 10 / (n60 / 60 + EPS), "rate_ratio_src_60s_300s": n60 / 60 / (n300 / 300 + EPS),
            "concurrent_flows_src_10s": alive(s10), "concurrent_flows_dst_10s": alive(d10), "concurrent_flows_per_dst_port_10s": alive([p for p in d10 if p["dst_port"] == r["dst_port"]]),
            "unique_src_ips_by_dst_60s": len({p["src_ip"] for p in d60}), "dst_ip_unique_src_ips_10s": len({p["src_ip"] for p in d10}),
            "new_dst_ip_ratio_src_300s": several(len({p["dst_ip"] for p in s300}) / max(1, n300)), "new_dst_port_ratio_src_300s": several(len(dports) / max(1, n300)),
            "new_dst_ips_per_sec": several(len({p["dst_ip"] for p in s300}) / 300), "new_dst_ports_per_sec": several(len(dports) / 300),
            "dst_ip_entropy_src_300s": entropy(Counter(p["dst_ip"] for p in s300).values()), "dst_port_entropy_src_300s": entropy(dports.values()),
            "iat_cv_src_60s": cv, "iat_cv_srcdst_300s": variation(gaps([p["ts_us"] for p in p300])), "iat_autocorr_srcdst_300s": autocorrelation(gaps([p["ts_us"] for p in p300])),
            "bytes_ratio_fwd_rev": r["fwd_bytes"] / (r["rev_bytes"] + 1),
            "short_flow_ratio_src_300s": sum(p["duration"] < 1 for p in s300) / (n300 + EPS), "avg_bytes_per_flow_src_300s": tot(s300, "total_bytes") / (n300 + EPS),
            "bytes_per_flow_srcdst": tot(p24, "total_bytes") / (len(p24) + EPS), "connection_reuse_ratio_srcdst": len(p24) / (len(s24) + EPS), "flow_size_mode_src_300s": mode,
            "retry_rate_same_dstport_300s": sum(c - 1 for c in Counter((p["dst_ip"], p["dst_port"]) for p in s300).values()) / (n300 + EPS),
            "retry_rate_same_dstip_300s": sum(c - 1 for c in Counter(p["dst_ip"] for p in s300).values()) / (n300 + EPS),
            "dst_port_reuse_ratio_src_300s": max(dports.values(), default=0) / (n300 + EPS),
            "syn_heavy_ratio_src_60s": tot(s60, "syn") / (tot(s60, "tcp_pkts") + EPS), "syn_to_established_ratio": tot(s60, "syn") / (tot(s60, "ack") + EPS),
            "rst_ratio_src_60s": tot(s60, "rst") / (n60 + EPS), "rst_to_syn_ratio_src_60s": tot(s60, "rst") / (tot(s60, "syn") + EPS),
            "tcp_flag_entropy_src_60s": entropy([tot(s60, k) for k in ("syn", "ack", "rst", "fin")]), "ack_presence_ratio": sum(p["ack"] > 0 for p in s300) / (n300 + EPS),
            "small_response_ratio_src_60s": sum(p["rev_bytes"] < 128 and p["fwd_bytes"] > 256 for p in s60) / n60 if n60 else 0.0,
            "incomplete_flow_duration_ratio_src_300s": sum(p["duration"] < 1 for p in s300) / (n300 + EPS),
            "low_data_rate_long_flow_ratio_src_300s": sum(p["duration"] > 120 and p["total_bytes"] / (p["duration"] + EPS) < 64 for p in s300) / (n300 + EPS),
            "src_contribution_to_dst_ratio_60s": sum(p["src_ip"] == r["src_ip"] for p in d60) / (len(d60) + EPS),
            "rst_micro_flow_ratio_src_60s": enough(sum(p["rst"] > 0 and p["duration"] <= 0.5 and p["total_bytes"] <= 150 and p["fwd_bytes"] <= 120 and p["rev_bytes"] <= 120 for p in s60) / (n60 + EPS)),
            "single_dst_port_focus_src_60s": enough(max(Counter(p["dst_port"] for p in s60).values(), default=0) / (n60 + EPS)),
            "rst_after_ack_ratio_src_60s": enough(sum(p["ack"] > 0 and p["rst"] > 0 for p in s60) / (n60 + EPS)) if r["has_tcp"] else 0.0,
            "dst_src_ip_entropy_60s": entropy(Counter(p["src_ip"] for p in d60).values()), "avg_flow_per_src_to_dst_10s": len(d10) / (len({p["src_ip"] for p in d10}) + EPS),
            "iat_regularity_src_60s": enough(1 / (cv + EPS) if cv > 0 else 0.0), "has_tcp": float(r["has_tcp"]),
        }
        out.append(f)
    return out


ONE = {"new_dst_ip_ratio_src_300s", "new_dst_port_ratio_src_300s", "short_flow_ratio_src_300s", "connection_reuse_ratio_srcdst"}


def bounded(name, value, bounds):
    low = -1.0 if "autocorr" in name else 0.0
    high = bounds[name]
    value = max(low, value)
    return min(high, value) if high is not None else value
