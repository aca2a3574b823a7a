"""Queries over flows of both address families in which exporters left fields out.

Every third flow is IPv6 (its addresses are the IPv4 ones within 2001:db8::/32), and VLANs, AS
numbers, outgoing counters and MAC addresses are missing from some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtide.catalog.base import FLOWS_CTE, query
from flowtide.functions import text as X
from flowtide.operators import aggregate as AG, joins, predicates as P, statistics as ST

#: high half of 2001:db8::
_HIGH = 0x20010DB8 << 32

# Fixed conditions: field -> flows that lack it.
_ABSENT = {
    "src_vlan": "flow_id % 5 = 0", "dst_vlan": "flow_id % 5 < 2", "src_as": "flow_id % 7 = 0", "dst_as": "flow_id % 7 < 2",
    "out_packets": "flow_id % 4 = 0", "out_bytes": "flow_id % 4 = 0", "in_src_mac": "flow_id % 11 = 0", "out_src_mac": "flow_id % 11 < 3",
}


def mixed(flows: DataFrame) -> DataFrame:
    v6 = F.col("flow_id") % 3 == 0
    out = {c: F.expr(f"CASE WHEN {when} THEN NULL ELSE {c} END") for c, when in _ABSENT.items()}
    for side in ("src", "dst"):
        out[f"{side}_hi"] = F.when(v6, F.lit(_HIGH))
        out[f"{side}_lo"] = F.when(v6, F.col(f"{side}_addr"))
        out[f"{side}_addr"] = F.when(~v6, F.col(f"{side}_addr"))
    return flows.withColumns({**out, "is_v6": v6})


_REPLACED = ", ".join(f"CASE WHEN {when} THEN NULL ELSE {c} END AS {c}" for c, when in _ABSENT.items())
_SIDES = ", ".join(
    f"CASE WHEN flow_id % 3 = 0 THEN {_HIGH} END AS {s}_hi, CASE WHEN flow_id % 3 = 0 THEN {s}_addr END AS {s}_lo" for s in ("src", "dst")
)
_MIXED_CTE = (
    f"WITH {FLOWS_CTE}, mixed AS (SELECT * REPLACE ({_REPLACED}, flow_id % 3 = 0 AS is_v6, "
    "CASE WHEN flow_id % 3 <> 0 THEN src_addr END AS src_addr, CASE WHEN flow_id % 3 <> 0 THEN dst_addr END AS dst_addr), "
    f"{_SIDES} FROM flows) "
)


def _query(name: str, sql: str):
    def register(fn):
        from flowtide.catalog.base import ORACLES

        query(name)(lambda flows: fn(mixed(flows)))
        ORACLES[name] = _MIXED_CTE + sql
        return fn

    return register


@_query("mixed_filter_ipv6", "SELECT flow_id, src_hi, src_lo FROM mixed WHERE is_v6")
def _(flows):
    return flows.filter(P.ipv6()).select("flow_id", "src_hi", "src_lo")


@_query("mixed_filter_net_v6", "SELECT flow_id FROM mixed WHERE src_lo BETWEEN 167772164 AND 167772167")
def _(flows):
    return flows.filter(P.net("2001:db8::a00:4/126", direction="src")).select("flow_id")


@_query("mixed_filter_host_v6", "SELECT flow_id FROM mixed WHERE is_v6 AND (src_lo = 167772161 OR dst_lo = 167772161)")
def _(flows):
    return flows.filter(P.ip("2001:db8::a00:1")).select("flow_id")


@_query(
    "mixed_in_network_list",
    """SELECT flow_id FROM mixed WHERE src_lo BETWEEN 167772164 AND 167772167 OR src_addr = 167772161
       OR dst_lo BETWEEN 167772164 AND 167772167 OR dst_addr = 167772161""",
)
def _(flows):
    nets = joins.network_table(flows.sparkSession, ["2001:db8::a00:4/126", "10.0.0.1"])
    return joins.in_networks(flows, nets, "either").select("flow_id")


def _both(a: str, b: str) -> str:
    per = "count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes"
    return f"""SELECT value, {per} FROM (SELECT CAST({a} AS BIGINT) AS value, packets, bytes FROM mixed
        UNION ALL SELECT {b}, packets, bytes FROM mixed WHERE {a} IS DISTINCT FROM {b}) u GROUP BY value"""


for _stat, _fields in {"vlan": ("src_vlan", "dst_vlan"), "as": ("src_as", "dst_as"), "srcmac": ("in_src_mac", "out_src_mac")}.items():

    @_query(f"mixed_stat_{_stat}", _both(*_fields))
    def _(flows, stat=_stat):
        return ST.element_stats(flows, stat).select("value", "flows", "packets", "bytes")


@_query(
    "mixed_stat_srcip",
    """SELECT src_addr AS value, src_hi AS value_hi, src_lo AS value_lo, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes
       FROM mixed GROUP BY 1, 2, 3""",
)
def _(flows):
    return ST.element_stats(flows, "srcip").select("value", "value_hi", "value_lo", "flows", "bytes")


@_query(
    "mixed_five_tuple",
    """SELECT src_addr, src_hi, src_lo, dst_addr, dst_hi, dst_lo, src_port, dst_port, prot, CAST(sum(packets) AS BIGINT) AS packets,
              CAST(sum(bytes) AS BIGINT) AS bytes FROM mixed GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""",
)
def _(flows):
    keys = ["src_addr", "src_hi", "src_lo", "dst_addr", "dst_hi", "dst_lo", "src_port", "dst_port", "prot"]
    return AG.aggregate_flows(flows).select(*keys, "packets", "bytes")


@_query(
    "mixed_bidirectional_totals",
    """SELECT is_v6, prot, count(DISTINCT CASE WHEN prot NOT IN (6, 17) THEN [sh, sl, sp, dh, dl, dp] WHEN (sh, sl, sp) <= (dh, dl, dp)
              THEN [sh, sl, sp, dh, dl, dp] ELSE [dh, dl, dp, sh, sl, sp] END) AS merged,
              CAST(sum(packets + coalesce(out_packets, 0)) AS BIGINT) AS all_packets, CAST(sum(bytes + coalesce(out_bytes, 0)) AS BIGINT) AS all_bytes,
              true AS none_absent
       FROM (SELECT *, coalesce(src_hi, 0)::BIGINT AS sh, coalesce(src_lo, src_addr)::BIGINT AS sl, src_port::BIGINT AS sp,
                    coalesce(dst_hi, 0)::BIGINT AS dh, coalesce(dst_lo, dst_addr)::BIGINT AS dl, dst_port::BIGINT AS dp FROM mixed) m GROUP BY 1, 2""",
)
def _(flows):
    merged = AG.aggregate_bidir(flows)
    return merged.groupBy("is_v6", "prot").agg(
        F.count(F.lit(1)).alias("merged"),
        F.sum(F.col("packets") + F.col("out_packets")).alias("all_packets"),
        F.sum(F.col("bytes") + F.col("out_bytes")).alias("all_bytes"),
        F.bool_and(F.col("out_packets").isNotNull() & F.col("out_bytes").isNotNull()).alias("none_absent"),
    )


@_query(
    "lines_long6",
    """SELECT flow_id, lpad(CASE WHEN is_v6 THEN '2001:0db8:0000:0000:0000:0000:0a00:' || lpad(lower(to_hex(src_lo % 65536)), 4, '0')
              ELSE '10.0.0.' || (src_addr % 256) END, 39, ' ') AS line FROM mixed""",
)
def _(flows):
    return flows.select("flow_id", X.format_line("%sa", long_v6=True).alias("line"))


@_query(
    "lines_plain_numbers",
    """SELECT flow_id, rpad(CAST(prot AS VARCHAR), 5, ' ') || ' ' || lpad(CAST(packets AS VARCHAR), CAST(greatest(8, length(CAST(packets AS VARCHAR))) AS INT), ' ')
              || ' ' || lpad(CAST(bytes * 1000000 AS VARCHAR), CAST(greatest(8, length(CAST(bytes * 1000000 AS VARCHAR))) AS INT), ' ') AS line FROM mixed""",
)
def _(flows):
    large = flows.withColumn("bytes", F.col("bytes") * 1_000_000)
    return large.select("flow_id", X.format_line("%pr %pkt %byt", plain=True).alias("line"))
