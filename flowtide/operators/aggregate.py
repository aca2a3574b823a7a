"""Flow aggregation: by any key, by subnet, and with both directions merged."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions import addresses as A
from flowtide.functions.rates import flow_weight
from flowtide.schema import ADDRESS_COLUMNS, TCP, UDP

COUNTERS = ("packets", "bytes", "out_packets", "out_bytes")

DEFAULT_KEYS = ("srcip", "dstip", "srcport", "dstport", "proto")


def _address_key(name: str) -> list[Column]:
    return [F.col(c) for c in ADDRESS_COLUMNS[name]]


def _net_key(side: str) -> list[Column]:
    v4, hi, lo = A.network(side)
    return [v4.alias(f"{side}_net"), hi.alias(f"{side}_net_hi"), lo.alias(f"{side}_net_lo")]


def _one(col: str):
    return lambda: [F.col(col)]


# Key name -> columns it groups by.
KEYS = {
    "srcip": lambda: _address_key("src"),
    "dstip": lambda: _address_key("dst"),
    "srcnet": lambda: _net_key("src"),
    "dstnet": lambda: _net_key("dst"),
    "next": lambda: _address_key("next_hop"),
    "bgpnext": lambda: _address_key("bgp_next_hop"),
    "router": lambda: _address_key("router"),
    "insrcmac": _one("in_src_mac"),
    "outdstmac": _one("out_dst_mac"),
    "indstmac": _one("in_dst_mac"),
    "outsrcmac": _one("out_src_mac"),
    "srcas": _one("src_as"),
    "dstas": _one("dst_as"),
    "inif": _one("input_if"),
    "outif": _one("output_if"),
    **{
        f"mpls{i}": (lambda i=i: [A.label_of(A.mpls_entry(i)).alias(f"mpls{i}_label")])
        for i in range(1, 11)
    },
    "srcport": _one("src_port"),
    "dstport": _one("dst_port"),
    "srcvlan": _one("src_vlan"),
    "dstvlan": _one("dst_vlan"),
    "srcmask": _one("src_mask"),
    "dstmask": _one("dst_mask"),
    "proto": _one("prot"),
    "tos": _one("tos"),
    "srctos": _one("tos"),
    "dsttos": _one("dst_tos"),
}

_SUBNET = re.compile(r"^(src|dst)ip([46])/(\d+)$")


def _subnet_key(side: str, family: int, bits: int) -> list[Column]:
    top = 32 if family == 4 else 128
    if not 1 <= bits <= top:
        raise ValueError(f"prefix length out of range 1-{top}: {bits}")
    v4, hi, lo = (F.col(c) for c in ADDRESS_COLUMNS[side])
    if family == 4:
        return [A.network_v4(v4, F.lit(bits)).alias(f"{side}_net{bits}")]
    h, l = A.network_v6(hi, lo, F.lit(bits))
    return [h.alias(f"{side}_net{bits}_hi"), l.alias(f"{side}_net{bits}_lo")]


def key_columns(keys) -> list[Column]:
    out = []
    for k in keys:
        subnet = _SUBNET.match(k)
        if subnet:
            out += _subnet_key(subnet[1], int(subnet[2]), int(subnet[3]))
        elif k in KEYS:
            out += KEYS[k]()
        else:
            raise ValueError(f"unknown aggregation key: {k}")
    return out


def _merged() -> list[Column]:
    return [
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.bit_or("tcp_flags").alias("tcp_flags"),
        F.sum(flow_weight()).alias("aggr_flows"),
    ]


def aggregate_flows(flows: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Merge flows with equal keys: sum counters, first and last time, OR of TCP flags.

    `keys` are names of KEYS, or subnets such as "srcip4/24" and "dstip6/64". The result
    has the key columns, the counters and `aggr_flows`, the number of flows merged.
    """
    return flows.groupBy(*key_columns(keys)).agg(*_merged())


#: fields a merged flow takes from its first record
_FIRST_RECORD = ("src_as", "dst_as", "input_if", "output_if")


def address_end(side: str) -> list[Column]:
    """(high, low) of an address of either family, for comparing two of the same family."""
    v4, hi, lo = (F.col(c) for c in ADDRESS_COLUMNS[side])
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(hi, zero), F.coalesce(lo, v4, zero)]


def not_after(a: list[Column], b: list[Column]) -> Column:
    """a <= b, column by column."""
    out = a[-1] <= b[-1]
    for x, y in zip(a[-2::-1], b[-2::-1]):
        out = (x < y) | ((x == y) & out)
    return out


def _arrival_order() -> Column:
    """Start in microseconds, then arrival, as one number.

    A decimal has a fixed width, so aggregations ordered by it stay hash aggregations; a
    struct would make Spark sort every flow first.
    """
    micros = F.unix_micros(F.col("first_ts").cast("timestamp")).cast("decimal(18,0)")
    return micros * F.expr("CAST('1e19' AS DECIMAL(20,0))") + F.col("flow_id").cast("decimal(19,0)")


def aggregate_bidir(flows: DataFrame) -> DataFrame:
    """Merge each TCP or UDP flow with its reverse; other protocols as `aggregate_flows`.

    The first flow of a pair (by time, then arrival) gives the direction; counters of the
    other direction go to `out_packets` and `out_bytes`. Both directions meet under one
    canonical key, so this is a single aggregation and not a join.
    """
    src, dst = address_end("src"), address_end("dst")
    src, dst = [*src, F.col("src_port")], [*dst, F.col("dst_port")]
    as_is = ~F.col("prot").isin(TCP, UDP) | not_after(src, dst)
    names = ("hi", "lo", "port")
    keyed = flows.withColumn("_as_is", as_is).select(
        "is_v6", "prot", "tcp_flags", "first_ts", "last_ts", "_as_is", *COUNTERS, *_FIRST_RECORD,
        flow_weight().alias("_weight"),
        _arrival_order().alias("_order"),
        *[F.when(F.col("_as_is"), s).otherwise(d).alias(f"_a_{n}") for n, s, d in zip(names, src, dst)],
        *[F.when(F.col("_as_is"), d).otherwise(s).alias(f"_b_{n}") for n, s, d in zip(names, src, dst)],
    )

    def directed(counter: str, flag: Column) -> Column:
        return F.sum(F.when(flag, F.coalesce(F.col(counter), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")))

    fwd = F.col("_as_is")
    ends = [f"_{e}_{n}" for e in "ab" for n in names]
    merged = keyed.groupBy("is_v6", "prot", *ends).agg(
        *[directed(c, fwd).alias(f"_f_{c}") for c in COUNTERS],
        *[directed(c, ~fwd).alias(f"_r_{c}") for c in COUNTERS],
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.bit_or("tcp_flags").alias("tcp_flags"),
        F.sum("_weight").alias("aggr_flows"),
        *[F.min_by(c, "_order").alias(c) for c in ("_as_is", *_FIRST_RECORD)],
    )
    keep = F.col("_as_is")

    def oriented(a: Column, b: Column) -> Column:
        return F.when(keep, a).otherwise(b)

    def address(side: str) -> list[Column]:
        one, two = "ab" if side == "src" else "ba"
        hi, lo, port = (oriented(F.col(f"_{one}_{n}"), F.col(f"_{two}_{n}")) for n in names)
        v6 = F.col("is_v6")
        return [
            F.when(~v6, lo).alias(f"{side}_addr"),
            F.when(v6, hi).alias(f"{side}_hi"),
            F.when(v6, lo).alias(f"{side}_lo"),
            port.alias(f"{side}_port"),
        ]

    def both_ways(same: str, other: str) -> Column:
        return oriented(
            F.col(f"_f_{same}") + F.col(f"_r_{other}"), F.col(f"_r_{same}") + F.col(f"_f_{other}")
        ).alias(same)

    return merged.select(
        "is_v6",
        *address("src"),
        *address("dst"),
        "prot",
        both_ways("packets", "out_packets"),
        both_ways("bytes", "out_bytes"),
        both_ways("out_packets", "packets"),
        both_ways("out_bytes", "bytes"),
        "first_ts",
        "last_ts",
        "tcp_flags",
        "aggr_flows",
        *_FIRST_RECORD,
    )


_SWAPPED = (
    ("src_addr", "dst_addr"),
    ("src_hi", "dst_hi"),
    ("src_lo", "dst_lo"),
    ("src_port", "dst_port"),
    ("src_as", "dst_as"),
    ("input_if", "output_if"),
    ("packets", "out_packets"),
    ("bytes", "out_bytes"),
)


def guess_direction(merged: DataFrame) -> DataFrame:
    """Turn flows round that start at a port below 1024 and end above it."""
    turn = (F.col("src_port") < 1024) & (F.col("dst_port") > 1024)
    other = {a: b for pair in _SWAPPED for a, b in (pair, pair[::-1])}
    return merged.select(
        *[
            F.when(turn, F.col(other[c])).otherwise(F.col(c)).alias(c)
            if c in other and other[c] in merged.columns
            else F.col(c)
            for c in merged.columns
        ]
    )
