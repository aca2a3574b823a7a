"""The one record type of the library: the flow.

Every table the operators take is a `flows` DataFrame with (a subset of) these
columns. Fields an exporter did not send are NULL. IPv4 addresses are BIGINT because
an unsigned 32-bit value does not fit INT; an IPv6 address is the pair `<name>_hi`,
`<name>_lo` (two's complement BIGINT) and its IPv4 column is NULL, and the other way
round. `flow_id` is the arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

_LONG, _INT = T.LongType(), T.IntegerType()

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("flow_id", _LONG),
        T.StructField("ident", T.StringType()),
        T.StructField("first_ts", T.TimestampNTZType()),
        T.StructField("last_ts", T.TimestampNTZType()),
        T.StructField("is_v6", T.BooleanType()),
        T.StructField("src_addr", _LONG),
        T.StructField("src_hi", _LONG),
        T.StructField("src_lo", _LONG),
        T.StructField("dst_addr", _LONG),
        T.StructField("dst_hi", _LONG),
        T.StructField("dst_lo", _LONG),
        T.StructField("src_port", _INT),
        T.StructField("dst_port", _INT),
        T.StructField("prot", _INT),
        T.StructField("tcp_flags", _INT),
        T.StructField("tos", _INT),
        T.StructField("dst_tos", _INT),
        T.StructField("packets", _LONG),
        T.StructField("bytes", _LONG),
        T.StructField("out_packets", _LONG),
        T.StructField("out_bytes", _LONG),
        T.StructField("aggr_flows", _LONG),
        T.StructField("input_if", _LONG),
        T.StructField("output_if", _LONG),
        T.StructField("src_as", _LONG),
        T.StructField("dst_as", _LONG),
        T.StructField("src_mask", _INT),
        T.StructField("dst_mask", _INT),
        T.StructField("src_vlan", _INT),
        T.StructField("dst_vlan", _INT),
        T.StructField("dir", _INT),
        T.StructField("fwd_status", _INT),
        T.StructField("next_hop", _LONG),
        T.StructField("next_hop_hi", _LONG),
        T.StructField("next_hop_lo", _LONG),
        T.StructField("bgp_next_hop", _LONG),
        T.StructField("bgp_next_hop_hi", _LONG),
        T.StructField("bgp_next_hop_lo", _LONG),
        T.StructField("router", _LONG),
        T.StructField("router_hi", _LONG),
        T.StructField("router_lo", _LONG),
        T.StructField("in_src_mac", _LONG),
        T.StructField("out_dst_mac", _LONG),
        T.StructField("in_dst_mac", _LONG),
        T.StructField("out_src_mac", _LONG),
        T.StructField("mpls", T.ArrayType(_INT)),
        T.StructField("engine_type", _INT),
        T.StructField("engine_id", _INT),
        T.StructField("sampled", T.BooleanType()),
    ]
)

#: name of an address -> its (v4, v6 high, v6 low) columns
ADDRESS_COLUMNS = {
    "src": ("src_addr", "src_hi", "src_lo"),
    "dst": ("dst_addr", "dst_hi", "dst_lo"),
    "next_hop": ("next_hop", "next_hop_hi", "next_hop_lo"),
    "bgp_next_hop": ("bgp_next_hop", "bgp_next_hop_hi", "bgp_next_hop_lo"),
    "router": ("router", "router_hi", "router_lo"),
}

TCP, UDP, ICMP, ICMP6 = 6, 17, 1, 58


def conform(df: DataFrame) -> DataFrame:
    """Cast to the flow schema; columns that are missing become NULL, others are dropped."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"CAST({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in FLOW_SCHEMA.fields
        ]
    )
