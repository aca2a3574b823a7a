from __future__ import annotations

import ipaddress

import pytest
from pyspark.sql import functions as F

from conftest import at, make_flows
from flowtide.functions import addresses as A, names as N, rates as R, text as X
from flowtide.functions.addresses import split_v6

V6_TEXTS = ["::", "::1", "2001:db8::1", "fe80::2110:abcd:1234:5678", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::8000:0:0:0"]


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def got(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_address_texts(spark):
    v4 = [0, 1, 0x7F000001, 0xAC200710, 0xFFFFFFFF]
    df = column(spark, v4, "bigint")
    assert [r[0] for r in got(df, A.ip4_string(F.col("v")))] == [str(ipaddress.IPv4Address(v)) for v in v4]
    rows = [split_v6(int(ipaddress.IPv6Address(t))) for t in V6_TEXTS]
    df6 = spark.createDataFrame(rows, "hi bigint, lo bigint")
    text = A.ip6_string(F.col("hi"), F.col("lo"))
    assert [r[0] for r in got(df6, text)] == [ipaddress.IPv6Address(t).exploded for t in V6_TEXTS]
    short = got(column(spark, ["2001:620:1000:cafe:20e:35ff:fec0:fed5", "1234567890123456"], "string"), A.condense_v6(F.col("v")))
    assert [s[0] for s in short] == ["2001:62..c0:fed5", "1234567890123456"]


@pytest.mark.parametrize("bits", [0, 1, 8, 24, 31, 32])
def test_v4_networks(spark, bits):
    addrs = [0, 0x0A0B0C0D, 0xFFFFFFFF]
    df = column(spark, addrs, "bigint")
    want = [int(ipaddress.ip_network((a, bits), strict=False).network_address) for a in addrs]
    assert [r[0] for r in got(df, A.network_v4(F.col("v"), F.lit(bits)))] == want


@pytest.mark.parametrize("bits", [0, 1, 16, 63, 64, 65, 112, 127, 128])
def test_v6_networks(spark, bits):
    rows = [split_v6(int(ipaddress.IPv6Address(t))) for t in V6_TEXTS]
    df = spark.createDataFrame(rows, "hi bigint, lo bigint")
    hi, lo = A.network_v6(F.col("hi"), F.col("lo"), F.lit(bits))
    want = [split_v6(int(ipaddress.ip_network(f"{t}/{bits}", strict=False).network_address)) for t in V6_TEXTS]
    assert got(df, hi, lo) == want


def test_macs_labels_flags(spark):
    assert got(column(spark, [0x0A1B2C3D4E5F, 0], "bigint"), A.mac_string(F.col("v"))) == [("0a:1b:2c:3d:4e:5f",), ("00:00:00:00:00:00",)]
    df = make_flows(spark, [{"mpls": [(7 << 4) | (5 << 1), (9 << 4) | 1]}, {"mpls": [16]}, {}])
    assert got(df, A.mpls_string(1), A.mpls_string(2), A.mpls_bottom_label()) == [("7-5-0", "9-0-1", 9), ("1-0-0", "", None), ("", "", None)]
    flags = got(column(spark, [0, 2, 18, 63, 64, 255], "int"), X.flags_string(F.col("v")))
    assert [f[0] for f in flags] == ["......", "....S.", ".A..S.", "UAPRSF", "  0x40", "  0xff"]


def test_names(spark):
    df = column(spark, [0, 1, 6, 17, 58, 99, 137, 138, 255], "int")
    names = [r[0] for r in got(df, N.proto_name(F.col("v")))]
    assert names == ["0", "ICMP", "TCP", "UDP", "ICMP6", "99", "MPLS", "138", "255"]
    assert len(N.PROTOCOL_NAMES) == 138
    assert [N.proto_number(p) for p in ("tcp", "GRE", "41", 7)] == [6, 47, 41, 7]
    df = column(spark, [0, 1, 16, 131, 99], "int")
    assert [r[0] for r in got(df, N.fwd_status_name(F.col("v")))] == ["Ukwn", "Forw", "Drop", "Tforus", None]
    ports = spark.createDataFrame([(22, 6), (22, 17), (53, 17), (53, 6), (53, 1), (666, 17), (666, 6), (992, 6), (1, 6)], "port int, prot int")
    want = ["SSH", None, "DNS", "DNS", None, "Doom", None, "telnet-over SSL", None]
    assert [r[0] for r in got(ports, N.service_name(F.col("port"), F.col("prot")))] == want


def test_scaled_numbers(spark):
    df = column(spark, [0, 999_999, 1_000_000, 1_260_000, 999_940_000, 2_500_000_000, 3_100_000_000_000], "bigint")
    plain = [r[0] for r in got(df, X.scaled_number(F.col("v")))]
    assert plain == ["0", "999999", "1.0 M", "1.3 M", "999.9 M", "2.5 G", "3.1 T"]
    fixed = [r[0] for r in got(df, X.scaled_number(F.col("v"), True))]
    assert fixed[:3] == ["   0", "999999", "  1.0 M"]


def test_rates_and_zero_divisors(spark):
    df = make_flows(spark, [
        {"packets": 7, "bytes": 1000, "last_ts": at(2)}, {"packets": 0, "bytes": 5}, {"packets": 3, "bytes": 10, "last_ts": at(0.0005)},
    ])
    assert got(df, R.duration_ms(), R.pps(), R.bps(), R.bpp()) == [(2000, 3, 4000, 142), (0, 0, 0, 0), (0, 0, 0, 3)]


def test_formats(spark):
    hi, lo = split_v6(int(ipaddress.IPv6Address("2001:db8::5")))
    df = make_flows(spark, [
        {"src_addr": 0x0A000001, "dst_addr": 0x0A000002, "src_port": 1, "dst_port": 2050, "prot": 1, "packets": 5, "bytes": 2_000_000, "aggr_flows": 1, "last_ts": at(1.5)},
        {"is_v6": True, "src_hi": hi, "src_lo": lo, "dst_hi": hi, "dst_lo": lo, "src_port": 5, "dst_port": 6, "prot": 17, "tcp_flags": 70, "aggr_flows": 2},
    ])
    a, b = [r.line for r in X.format_flows(df, "long").orderBy("line").collect()][::-1]
    lines = {a, b}
    assert "2024-03-01 00:00:00.000     1.500 ICMP          10.0.0.1:1     ->         10.0.0.2:8.2   ......   0        5    2.0 M     1" in lines
    assert "2024-03-01 00:00:00.000     0.000 UDP   2001:0d..00:0005.5     -> 2001:0d..00:0005.6       0x46   0        1      100     2" in lines
    assert X.format_header("%sp %dp") == "Src Pt Dst Pt"
    with pytest.raises(ValueError):
        X.format_line("%nonsense")
    documented = """ts te td pr sa da sn dn nh nhb ra sap dap sp dp sas das in out pkt ipkt opkt byt ibyt obyt fl flg tos
        stos dtos dir smk dmk fwd svln dvln ismc odmc idmc osmc mpls1 mpls2 mpls3 mpls4 mpls5 mpls6 mpls7 mpls8 mpls9
        mpls10 mpls bps pps bpp eng""".split()
    assert set(documented) == set(X.TOKENS)
    every = X.format_flows(df, " ".join(f"%{t}" for t in documented))
    assert every.filter("line IS NULL").count() == 0


def test_rates_do_not_overflow(spark):
    rows = [(2**62, 86_400_000), (2**62, 1), (7, 0), (None, 5), (1_234_567, 89)]
    df = spark.createDataFrame(rows, "b long, ms long")
    got = df.select(R.bps(F.col("b"), F.col("ms")).alias("bps"), R.pps(F.col("b"), F.col("ms")).alias("pps")).collect()
    most = 2**63 - 1
    for (b, ms), r in zip(rows, got):
        want = [None if b is None else 0 if ms == 0 else min(b * k // ms, most) for k in (8000, 1000)]
        assert [r.bps, r.pps] == want
