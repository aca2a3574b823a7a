"""Element statistics, summaries and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions import addresses as A, rates as R
from flowtide.schema import ADDRESS_COLUMNS, ICMP, ICMP6, TCP, UDP

MAX_BPP = 9000


def _addr(name: str) -> Column:
    v4, hi, lo = (F.col(c) for c in ADDRESS_COLUMNS[name])
    return F.struct(v4.alias("addr"), hi.alias("hi"), lo.alias("lo"))


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# Statistic -> (kind of value, fields that hold it).
STATISTICS = {
    "srcip": ("address", ["src"]),
    "dstip": ("address", ["dst"]),
    "ip": ("address", ["src", "dst"]),
    "nhip": ("address", ["next_hop"]),
    "nhbip": ("address", ["bgp_next_hop"]),
    "router": ("address", ["router"]),
    "srcport": ("number", ["src_port"]),
    "dstport": ("number", ["dst_port"]),
    "port": ("number", ["src_port", "dst_port"]),
    "proto": ("number", ["prot"]),
    "tos": ("number", ["tos"]),
    "srctos": ("number", ["tos"]),
    "dsttos": ("number", ["dst_tos"]),
    "dir": ("number", ["dir"]),
    "srcas": ("number", ["src_as"]),
    "dstas": ("number", ["dst_as"]),
    "as": ("number", ["src_as", "dst_as"]),
    "inif": ("number", ["input_if"]),
    "outif": ("number", ["output_if"]),
    "if": ("number", ["input_if", "output_if"]),
    "srcmask": ("number", ["src_mask"]),
    "dstmask": ("number", ["dst_mask"]),
    "mask": ("number", ["src_mask", "dst_mask"]),
    "srcvlan": ("number", ["src_vlan"]),
    "dstvlan": ("number", ["dst_vlan"]),
    "vlan": ("number", ["src_vlan", "dst_vlan"]),
    "insrcmac": ("mac", ["in_src_mac"]),
    "outdstmac": ("mac", ["out_dst_mac"]),
    "indstmac": ("mac", ["in_dst_mac"]),
    "outsrcmac": ("mac", ["out_src_mac"]),
    "srcmac": ("mac", ["in_src_mac", "out_src_mac"]),
    "dstmac": ("mac", ["out_dst_mac", "in_dst_mac"]),
    "inmac": ("mac", ["in_src_mac"]),
    "outmac": ("mac", ["out_dst_mac", "out_src_mac"]),
    **{f"mpls{i}": ("mpls", [i]) for i in range(1, 11)},
}


def _value(kind: str, field) -> Column:
    if kind == "address":
        return _addr(field)
    if kind == "mpls":
        return _long(A.label_of(A.mpls_entry(field)))
    return _long(field)


def _per_value() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("flows"),
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    ]


def element_stats(flows: DataFrame, stat: str, per_protocol: bool = False) -> DataFrame:
    """Flows, packets, bytes, first and last time per value of one statistic.

    A statistic over two fields counts a flow for both its values, once if they are equal or
    both absent. Absent is a value of its own, NULL.
    Address statistics come with `value`, `value_hi`, `value_lo`, others with `value`.
    """
    kind, fields = STATISTICS[stat]
    cols = ["prot", "packets", "bytes", "first_ts", "last_ts"]
    values = [_value(kind, f) for f in fields]
    if len(values) == 1:
        keyed = flows.select(*cols, values[0].alias("v"))
    else:
        a, b = values
        keyed = flows.select(
            *cols, F.explode(F.when(a.eqNullSafe(b), F.array(a)).otherwise(F.array(a, b))).alias("v")
        )
    if kind == "address":
        key = [F.col("v.addr").alias("value"), F.col("v.hi").alias("value_hi"), F.col("v.lo").alias("value_lo")]
    else:
        key = [F.col("v").alias("value")]
    if stat == "proto":
        return keyed.groupBy(*key).agg(*_per_value())
    return keyed.groupBy(*(["prot"] if per_protocol else []), *key).agg(*_per_value())


def with_rates(stats: DataFrame) -> DataFrame:
    """pps, bps and bpp of each aggregated row, from its own first and last time."""
    ms = R.duration_ms()
    return stats.withColumns({"pps": R.pps(ms=ms), "bps": R.bps(ms=ms), "bpp": R.bpp()})


def with_shares(stats: DataFrame, flows: DataFrame) -> DataFrame:
    """Percent of all flows, packets and bytes, plus rates.

    The totals are three scalar subqueries over one row, so nothing is joined.
    """
    totals = flows.agg(
        F.struct(
            F.count(F.lit(1)).alias("flows"),
            F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"),
        ).alias("t")
    ).scalar()
    shares = {
        f"{c}_share": F.try_divide(F.col(c) * F.lit(100.0), totals.getField(c))
        for c in ("flows", "packets", "bytes")
    }
    return with_rates(stats).withColumns(shares)


# Protocol class -> protocol numbers; anything else is "other".
PROTOCOL_CLASSES = {"tcp": [TCP], "udp": [UDP], "icmp": [ICMP, ICMP6]}


def class_counters() -> list[Column]:
    """Flow, packet and byte counts, overall and by protocol class (19 columns less times)."""
    known = [n for ns in PROTOCOL_CLASSES.values() for n in ns]
    classes = {None: None, **{c: F.col("prot").isin(*ns) for c, ns in PROTOCOL_CLASSES.items()}}
    classes["other"] = ~F.col("prot").isin(*known)
    out = []
    for name, cond in classes.items():
        suffix = f"_{name}" if name else ""
        for counter, value in (("flows", F.lit(1)), ("packets", F.col("packets")), ("bytes", F.col("bytes"))):
            v = value.cast("bigint")
            picked = v if cond is None else F.when(cond, v).otherwise(F.lit(0).cast("bigint"))
            out.append(F.coalesce(F.sum(picked), F.lit(0).cast("bigint")).alias(f"{counter}{suffix}"))
    return out


def summary(flows: DataFrame) -> DataFrame:
    """One row: counts by protocol class, first and last seen, average rates."""
    total = flows.agg(
        *class_counters(),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
    )
    ms = F.coalesce(R.duration_ms("first_seen", "last_seen"), F.lit(0).cast("bigint"))
    return total.withColumns(
        {
            "avg_bps": R.bps(ms=ms),
            "avg_pps": R.pps(ms=ms),
            "avg_bpp": F.when(ms > 0, R.bpp()).otherwise(F.lit(0).cast("bigint")),
        }
    )


def port_histogram(flows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Flow count per protocol (TCP, UDP), side and port, within further columns `by`."""
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.col(f"{s}_port").alias("port"))
            for s in ("src", "dst")
        ]
    )
    return (
        flows.filter(F.col("prot").isin(TCP, UDP))
        .select(*by, "prot", F.explode(sides).alias("p"))
        .groupBy(*by, "prot", F.col("p.side").alias("side"), F.col("p.port").alias("port"))
        .agg(F.count(F.lit(1)).alias("flows"))
    )


def bpp_histogram(flows: DataFrame, cap: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Flow count per protocol (TCP, UDP) and bytes per packet, within further columns `by`.

    With a `cap` (MAX_BPP in the classic report) values above it share its row.
    """
    value = R.bpp() if cap is None else F.least(R.bpp(), F.lit(cap))
    return (
        flows.filter(F.col("prot").isin(TCP, UDP))
        .groupBy(*by, "prot", value.alias("bpp"))
        .agg(F.count(F.lit(1)).alias("flows"))
    )
