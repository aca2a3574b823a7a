"""One record, a predicate, and whether it must match."""

from __future__ import annotations

import ipaddress
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0, at, make_flows
from flowtide.functions.addresses import parse_address, split_v6
from flowtide.operators import joins, predicates as P


def v4(name, text):
    col = {"src": "src_addr", "dst": "dst_addr"}.get(name, name)
    return {col: parse_address(text)[0]}


def v6(name, text):
    hi, lo = parse_address(text)
    return {f"{name}_hi": hi, f"{name}_lo": lo}


V4 = {
    **v4("src", "172.32.7.16"), **v4("dst", "10.10.10.11"), **v4("next_hop", "172.1.1.1"),
    **v4("bgp_next_hop", "172.1.1.2"), **v4("router", "127.0.0.1"),
    "ident": "channel1", "src_port": 63, "dst_port": 255, "prot": 6, "tcp_flags": 18, "tos": 5, "dst_tos": 9,
    "packets": 1000, "bytes": 20000, "out_packets": 7, "out_bytes": 70, "aggr_flows": 3,
    "first_ts": T0, "last_ts": at(10), "input_if": 5, "output_if": 6, "src_as": 123, "dst_as": 456,
    "src_mask": 11, "dst_mask": 13, "src_vlan": 45, "dst_vlan": 46, "dir": 1, "fwd_status": 16,
    "in_src_mac": 0x0A1B2C3D4E5F, "out_dst_mac": 0xA1, "in_dst_mac": 0xA2, "out_src_mac": 0xA3,
    "mpls": [(1010 << 4) | (3 << 1), (2020 << 4) | (5 << 1) | 1, (3030 << 4) | 1] + [0] * 7,
    "engine_type": 3, "engine_id": 4,
}
V6 = {
    "is_v6": True, **v6("src", "fe80::2110:abcd:1234:5678"), **v6("dst", "fe80::1104:fedc:4321:8765"),
    **v6("router", "fe80::1"), "prot": 58, "src_port": 0, "dst_port": (3 << 8) + 250, "packets": 10, "bytes": 100,
    "first_ts": T0, "last_ts": T0, "tcp_flags": 0,
}
n = P.not_

CASES = [
    # (predicate, v4 record, v6 record)
    ("any", lambda: P.any_(), 1, 1),
    ("not any", lambda: n(P.any_()), 0, 0),
    ("ident", lambda: P.ident("channel1"), 1, 0),
    ("not ident", lambda: n(P.ident("channel1")), 0, 1),
    ("ipv4", lambda: P.ipv4(), 1, 0),
    ("ipv6", lambda: P.ipv6(), 0, 1),
    ("proto tcp", lambda: P.proto("tcp"), 1, 0),
    ("proto icmp6", lambda: P.proto("icmp6"), 0, 1),
    ("proto 58", lambda: P.proto(58), 0, 1),
    ("packets = 1k", lambda: P.packets("=", "1k"), 1, 0),
    ("packets > 999", lambda: P.packets(">", 999), 1, 0),
    ("out packets", lambda: P.packets("<", 8, "out"), 1, 0),
    ("bytes > 19k", lambda: P.bytes_(">", "19k"), 1, 0),
    ("out bytes", lambda: P.bytes_("=", 70, "out"), 1, 0),
    ("flows", lambda: P.flows("=", 3), 1, 0),
    ("pps", lambda: P.pps("=", 100), 1, 0),
    ("pps zero duration", lambda: P.pps("=", 0), 0, 1),
    ("not pps", lambda: n(P.pps("=", 100)), 0, 1),
    ("bps", lambda: P.bps("=", 16000), 1, 0),
    ("bpp", lambda: P.bpp("=", 20), 1, 0),
    ("duration", lambda: P.duration("=", 10000), 1, 0),
    ("duration <", lambda: P.duration("<", 1), 0, 1),
    ("tos", lambda: P.tos("=", 5), 1, 0),
    ("dst tos", lambda: P.tos(">", 8, "dst"), 1, 0),
    ("src or dst tos", lambda: P.tos("=", 9, "either"), 1, 0),
    ("src and dst tos", lambda: P.tos(">", 5, "both"), 0, 0),
    ("flags S", lambda: P.flags("S"), 1, 0),
    ("flags SA", lambda: P.flags("AS"), 1, 0),
    ("flags SF", lambda: P.flags("SF"), 0, 0),
    ("flags X", lambda: P.flags("X"), 0, 0),
    ("flags = 18", lambda: P.flags(18), 1, 0),
    ("flags > 7", lambda: P.flags(7, ">"), 1, 0),
    ("not flags RF: none set", lambda: P.flags("RF", negate=True), 1, 1),
    ("not flags AR: A is set", lambda: P.flags("AR", negate=True), 0, 1),
    ("S and not R", lambda: P.flags("S") & P.flags("R", negate=True), 1, 0),
    ("src ip", lambda: P.ip("172.32.7.16", "src"), 1, 0),
    ("dst ip", lambda: P.ip("172.32.7.16", "dst"), 0, 0),
    ("ip", lambda: P.host("10.10.10.11"), 1, 0),
    ("src and dst ip", lambda: P.ip("10.10.10.11", "both"), 0, 0),
    ("not ip", lambda: n(P.ip("172.32.7.16")), 0, 1),
    ("v6 ip", lambda: P.ip("fe80::2110:abcd:1234:5678"), 0, 1),
    ("v6 other ip", lambda: P.ip("fe80::2110:abcd:1234:5679"), 0, 0),
    ("not v6 ip", lambda: n(P.ip("fe80::2110:abcd:1234:5678")), 1, 0),
    ("ip in", lambda: P.ip_in(["172.32.7.17", "172.32.7.16", "10.10.10.11"], "src"), 1, 0),
    ("ip in net", lambda: P.ip_in(["172.32.0.0/16"], "src"), 1, 0),
    ("ip in none", lambda: P.ip_in(["172.33.0.0/16", "10.10.10.12"]), 0, 0),
    ("v6 ip in", lambda: P.ip_in(["fe80::2110:abcd:1234:0/112"], "src"), 0, 1),
    ("v6 ip in /32", lambda: P.ip_in(["fe80::/32"], "both"), 0, 1),
    ("next hop", lambda: P.next_hop("172.1.1.1"), 1, 0),
    ("bgp next hop", lambda: P.bgp_next_hop("172.1.1.1"), 0, 0),
    ("router", lambda: P.router("127.0.0.1"), 1, 0),
    ("v6 router", lambda: P.router("fe80::1"), 0, 1),
    ("port", lambda: P.port("=", 63), 1, 0),
    ("dst port >", lambda: P.port(">", 254, "dst"), 1, 1),
    ("both ports <", lambda: P.port("<", 256, "both"), 1, 0),
    ("port in", lambda: P.port_in([62, 63, 64]), 1, 0),
    ("not port in", lambda: n(P.port_in([62, 64, 254, 256])), 1, 1),
    ("icmp type", lambda: P.icmp_type(3), 0, 1),
    ("icmp code", lambda: P.icmp_code(250), 0, 1),
    ("icmp code of tcp", lambda: P.icmp_code(255), 0, 0),
    ("engine type", lambda: P.engine_type("=", 3), 1, 0),
    ("engine id", lambda: P.engine_id("<", 5), 1, 0),
    ("as", lambda: P.as_("=", 456), 1, 0),
    ("src as >", lambda: P.as_(">", 122, "src"), 1, 0),
    ("as in", lambda: P.as_in([122, 456]), 1, 0),
    ("not as in", lambda: n(P.as_in([122, 124, 455, 457])), 1, 1),
    ("mask", lambda: P.mask(13), 1, 0),
    ("src mask", lambda: P.mask(13, "src"), 0, 0),
    ("net bits", lambda: P.net("172.32.0.0/16"), 1, 0),
    ("net mask", lambda: P.net("10.10.0.0", "255.255.0.0", "dst"), 1, 0),
    ("net miss", lambda: P.net("172.32.0.0/24", direction="src"), 0, 0),
    ("v6 net 112", lambda: P.net("fe80::2110:abcd:1234:0/112", direction="src"), 0, 1),
    ("v6 net 16", lambda: P.net("fe80::/16", direction="dst"), 0, 1),
    ("not v6 net 16", lambda: n(P.net("fe81::/16", direction="dst")), 1, 1),
    ("if", lambda: P.interface(6), 1, 0),
    ("in if", lambda: P.interface(6, "in"), 0, 0),
    ("vlan", lambda: P.vlan(46), 1, 0),
    ("src vlan", lambda: P.vlan(46, "src"), 0, 0),
    ("mac", lambda: P.mac("0a:1b:2c:3d:4e:5f"), 1, 0),
    ("in src mac", lambda: P.mac("0a:1b:2c:3d:4e:5f", "in_src"), 1, 0),
    ("out mac", lambda: P.mac("0a:1b:2c:3d:4e:5f", "out"), 0, 0),
    ("dst mac", lambda: P.mac("00:00:00:00:00:a2", "dst"), 1, 0),
    ("mpls label1", lambda: P.mpls_label(1, "=", 1010), 1, 0),
    ("mpls label2 >", lambda: P.mpls_label(2, ">", 2020), 0, 0),
    ("mpls exp2", lambda: P.mpls_exp(2, "=", 5), 1, 0),
    ("mpls eos", lambda: P.mpls_eos("=", 2020), 1, 0),
    ("mpls any", lambda: P.mpls_any(3030), 1, 0),
    ("mpls any miss", lambda: P.mpls_any(4040), 0, 0),
    ("fwd status", lambda: P.fwd_status("Drop"), 1, 0),
    ("fwd status number", lambda: P.fwd_status(16), 1, 0),
    ("egress", lambda: P.flow_dir("egress"), 1, 0),
    ("ingress", lambda: P.flow_dir("ingress"), 0, 0),
    ("window holds both ends", lambda: P.time_window(T0, at(10)), 1, 1),
    ("window cuts the end", lambda: P.time_window(T0, at(9)), 0, 1),
    ("window cuts the start", lambda: P.time_window(at(1)), 0, 0),
]


def test_predicates(spark):
    df = make_flows(spark, [V4, V6])
    # a filter treats an unknown result as no match
    matched = [F.coalesce(p(), F.lit(False)).alias(name) for name, p, _, _ in CASES]
    four, six = df.select("is_v6", *matched).orderBy("is_v6").collect()
    wrong = [name for name, _, w4, w6 in CASES if (four[name], six[name]) != (bool(w4), bool(w6))]
    assert wrong == []
    assert df.filter(P.flags("SA")).count() == 1


def test_numbers_and_ranges():
    assert P.scaled("10k") == 10_000 and P.scaled("2M") == 2_000_000 and P.scaled("3g") == 3 * 10**9
    assert P.scaled("1T") == 10**12
    for bad in (
        lambda: P.port("=", 70000), lambda: P.flags(64), lambda: P.tos("=", 256), lambda: P.flags("Q"),
        lambda: P.proto("nonsense"), lambda: P.packets("~", 1), lambda: P.fwd_status("gone"),
        lambda: P.ip("10.0.0.1", "sideways"), lambda: P.proto(300),
    ):
        with pytest.raises((ValueError, KeyError)):
            bad()


def test_time_frames():
    first, last = datetime(2024, 1, 1), datetime(2024, 1, 2)
    assert P.time_frame("+60", first, last) == (first, first + timedelta(seconds=60))
    assert P.time_frame("-60", first, last) == (last - timedelta(seconds=60), last)
    assert P.time_frame("2024/01/01.10:30:00-2024/01/01.11", first, last) == (
        datetime(2024, 1, 1, 10, 30), datetime(2024, 1, 1, 11))
    assert P.time_frame("2024/01/01", first, last) == (first, None)


@pytest.mark.parametrize(
    "side,want", [("src", [0, 2]), ("dst", [1, 2]), ("either", [0, 1, 2]), ("both", [2])]
)
def test_network_lists(spark, side, want):
    rows = [
        {**v4("src", "10.1.2.3"), **v4("dst", "8.8.8.8")},
        {**v4("src", "8.8.8.8"), **v4("dst", "10.1.2.4")},
        {"is_v6": True, **v6("src", "2001:db8:1::1"), **v6("dst", "2001:db8:2::1")},
        {**v4("src", "9.9.9.9"), **v4("dst", "9.9.9.9")},
        {},
    ]
    nets = joins.network_table(spark, ["10.1.0.0/16", "10.0.0.0/8", "10.1.2.4", "2001:db8::/32", "::/128"])
    out = joins.in_networks(make_flows(spark, rows), nets, side)
    assert sorted(r.flow_id for r in out.collect()) == want
    assert "net" not in out.columns and len(out.columns) == len(set(out.columns))


def test_long_lists_of_nested_and_neighbouring_networks(spark, monkeypatch):
    """Random lists of both families, cut into many blocks, against Python's own membership."""
    monkeypatch.setattr(joins, "ADDRESS_BLOCK", 40)
    rng = random.Random(12)
    v4 = [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.choice([1, 6, 9, 17, 24, 31, 32])}" for _ in range(60)]
    v6 = [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.choice([3, 40, 64, 65, 90, 127, 128])}" for _ in range(60)]
    nets = [ipaddress.ip_network(n, strict=False) for n in [*v4[:59], *v6, "10.1.0.0/16", "10.1.2.0/24"]]
    addrs = [ipaddress.ip_address(a) for n in nets for a in (n.network_address, n.broadcast_address)]
    addrs += [type(a)(min(max(int(a) + d, 0), 2 ** a.max_prefixlen - 1)) for a in addrs[::3] for d in (-1, 1)]
    rows = []
    for i, a in enumerate(addrs):
        hi, lo = split_v6(int(a)) if a.version == 6 else (None, None)
        rows.append((int(a) if a.version == 4 else None, hi, lo, i))
    df = spark.createDataFrame(rows, "v4 bigint, hi bigint, lo bigint, i int")
    found = joins.addresses_in_networks(df.select("v4", "hi", "lo").distinct(), joins.network_table(spark, [str(n) for n in nets]))
    got = {(r.v4, r.hi, r.lo) for r in found.collect()}
    assert got == {r[:3] for r, a in zip(rows, addrs) if any(a in n for n in nets)} and len(got) < len({r[:3] for r in rows})
