"""One registered query per predicate: the flows it keeps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from flowtide.catalog.base import query
from flowtide.operators import aggregate, joins, predicates as P

_BPS = "CASE WHEN dur_ms = 0 THEN 0 ELSE (8000 * bytes) // dur_ms END"
_PPS = "CASE WHEN dur_ms = 0 THEN 0 ELSE (1000 * packets) // dur_ms END"
_BPP = "CASE WHEN packets = 0 THEN 0 ELSE bytes // packets END"
_MPLS = [f"mpls_{i}" for i in (1, 2, 3)]
_BOTTOM = "CASE " + " ".join(f"WHEN {m} % 2 = 1 THEN {m} // 16" for m in _MPLS) + " END"

# name -> (predicate, the same in SQL)
FILTERS = {
    "any": (lambda: P.any_(), "true"),
    "ident": (lambda: P.ident("r1"), "ident = 'r1'"),
    "ipv4": (lambda: P.ipv4(), "NOT is_v6"),
    "ipv6": (lambda: P.ipv6(), "is_v6"),
    "proto_name": (lambda: P.proto("udp"), "prot = 17"),
    "proto_number": (lambda: P.proto(1), "prot = 1"),
    "packets": (lambda: P.packets(">", 25), "packets > 25"),
    "out_packets": (lambda: P.packets("=", 3, "out"), "out_packets = 3"),
    "bytes_suffix": (lambda: P.bytes_(">", "5k"), "bytes > 5000"),
    "out_bytes": (lambda: P.bytes_("<", 200, "out"), "out_bytes < 200"),
    "flow_count": (lambda: P.flows(">", 1), "aggr_flows > 1"),
    "pps": (lambda: P.pps(">", 10), f"{_PPS} > 10"),
    "bps": (lambda: P.bps(">", "10k"), f"{_BPS} > 10000"),
    "bpp": (lambda: P.bpp("<", 100), f"{_BPP} < 100"),
    "duration": (lambda: P.duration("<", 2000), "dur_ms < 2000"),
    "tos_src": (lambda: P.tos("=", 2), "tos = 2"),
    "tos_either": (lambda: P.tos(">", 2, "either"), "tos > 2 OR dst_tos > 2"),
    "tos_both": (lambda: P.tos("=", 1, "both"), "tos = 1 AND dst_tos = 1"),
    "flags_number": (lambda: P.flags(18), "tcp_flags = 18"),
    "flags_all_set": (lambda: P.flags("SA"), "(tcp_flags & 18) = 18"),
    "flags_none_set": (lambda: P.flags("SA", negate=True), "(tcp_flags & 18) = 0"),
    "host": (lambda: P.ip("10.0.0.5"), "src_addr = 167772165 OR dst_addr = 167772165"),
    "host_both": (lambda: P.ip("10.0.0.5", "both"), "src_addr = 167772165 AND dst_addr = 167772165"),
    "ip_list": (
        lambda: P.ip_in(["10.0.0.1", "10.0.0.8/30"], "src"),
        "src_addr = 167772161 OR src_addr BETWEEN 167772168 AND 167772171",
    ),
    "next_hop": (lambda: P.next_hop("172.16.0.1"), "next_hop = 2886729729"),
    "bgp_next_hop": (lambda: P.bgp_next_hop("172.16.1.2"), "bgp_next_hop = 2886729986"),
    "router": (lambda: P.router("127.0.0.1"), "router = 2130706433"),
    "port": (lambda: P.port("=", 443), "src_port = 443 OR dst_port = 443"),
    "port_dst_range": (
        lambda: P.port(">", 1024, "dst") & P.port("<", 2000, "dst"),
        "dst_port > 1024 AND dst_port < 2000",
    ),
    "port_list": (lambda: P.port_in([22, 53], "dst"), "dst_port IN (22, 53)"),
    "icmp_type": (lambda: P.icmp_type(17), "prot IN (1, 58) AND dst_port >> 8 = 17"),
    "icmp_code": (lambda: P.icmp_code(80), "prot IN (1, 58) AND (dst_port & 255) = 80"),
    "engine_type": (lambda: P.engine_type("=", 1), "engine_type = 1"),
    "engine_id": (lambda: P.engine_id("<", 1), "engine_id < 1"),
    "as_number": (lambda: P.as_("=", 64514), "src_as = 64514 OR dst_as = 64514"),
    "as_list": (lambda: P.as_in([64512, 64516], "src"), "src_as IN (64512, 64516)"),
    "mask": (lambda: P.mask(16, "src"), "src_mask = 16"),
    "net_bits": (lambda: P.net("10.0.0.0/30"), "src_addr // 4 = 41943040 OR dst_addr // 4 = 41943040"),
    "net_mask": (
        lambda: P.net("10.0.0.8", "255.255.255.248", "dst"),
        "dst_addr BETWEEN 167772168 AND 167772175",
    ),
    "interface": (lambda: P.interface(2), "input_if = 2 OR output_if = 2"),
    "interface_in": (lambda: P.interface(1, "in"), "input_if = 1"),
    "vlan": (lambda: P.vlan(103), "src_vlan = 103 OR dst_vlan = 103"),
    "mac_in_src": (lambda: P.mac("02:41:f4:9c:17:0d", "in_src"), "in_src_mac = 2482300000013"),
    "mac_any": (
        lambda: P.mac("02:41:f4:9c:17:0d"),
        "2482300000013 IN (in_src_mac, out_dst_mac, in_dst_mac, out_src_mac)",
    ),
    "mpls_label": (lambda: P.mpls_label(1, "<", 1050), "mpls_1 // 16 < 1050"),
    "mpls_exp": (lambda: P.mpls_exp(2, "=", 5), "(mpls_2 // 2) % 8 = 5"),
    "mpls_bottom": (lambda: P.mpls_eos(">", 3050), f"{_BOTTOM} > 3050"),
    "mpls_any": (lambda: P.mpls_any(2010), "2010 IN (mpls_1 // 16, mpls_2 // 16, mpls_3 // 16)"),
    "fwd_status": (lambda: P.fwd_status("drop"), "fwd_status = 16"),
    "flow_direction": (lambda: P.flow_dir("egress"), "dir = 1"),
    "combined": (
        lambda: (P.proto("tcp") & (P.port("=", 80) | P.port("=", 443))) & P.not_(P.ident("r0")),
        "prot = 6 AND (80 IN (src_port, dst_port) OR 443 IN (src_port, dst_port)) AND NOT ident = 'r0'",
    ),
    "time_window": (
        lambda: P.time_window(datetime(2024, 1, 5), datetime(2024, 1, 9, 12)),
        "first_ts >= TIMESTAMP '2024-01-05' AND last_ts <= TIMESTAMP '2024-01-09 12:00:00'",
    ),
}

for _name, (_predicate, _sql) in FILTERS.items():
    query(f"filter_{_name}", f"SELECT flow_id, packets, bytes FROM flows WHERE {_sql}")(
        lambda flows, p=_predicate: flows.filter(p()).select("flow_id", "packets", "bytes")
    )


@query(
    "filter_relative_time_frame",
    """SELECT flow_id, packets, bytes FROM flows
       WHERE first_ts >= (SELECT max(last_ts) - INTERVAL 259200 SECOND FROM flows)
         AND last_ts <= (SELECT max(last_ts) FROM flows)""",
)
def _(flows):
    span = flows.agg(F.min("first_ts"), F.max("last_ts")).first()
    return flows.filter(P.time_window(*P.time_frame("-259200", *span))).select("flow_id", "packets", "bytes")


@query(
    "group_limits",
    """SELECT src_addr, dst_addr, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes
       FROM flows GROUP BY 1, 2
       HAVING sum(packets) > 900 AND sum(bytes) < 260000""",
)
def _(flows):
    merged = aggregate.aggregate_flows(flows, ["srcip", "dstip"])
    keep = P.group_limit("packets", "+900") & P.group_limit("bytes", "-260k")
    return merged.filter(keep).select("src_addr", "dst_addr", "packets", "bytes")


@query(
    "in_network_list",
    """SELECT flow_id, src_addr, dst_addr FROM flows
       WHERE src_addr BETWEEN 167772164 AND 167772167 OR src_addr = 167772161
          OR dst_addr BETWEEN 167772164 AND 167772167 OR dst_addr = 167772161""",
)
def _(flows):
    nets = joins.network_table(flows.sparkSession, ["10.0.0.4/30", "10.0.0.1", "192.168.0.0/16"])
    return joins.in_networks(flows, nets, "either").select("flow_id", "src_addr", "dst_addr")


@query(
    "in_long_network_list",
    """SELECT flow_id, src_addr FROM flows
       WHERE src_addr IN (SELECT dst_addr FROM flows WHERE prot = 1 AND src_as = 64513 AND in_src_mac % 7 = 3)""",
)
def _(flows):
    # the list comes from the data: targets of some ICMP senders
    nets = (
        flows.filter(P.proto("icmp") & P.as_("=", 64513, "src") & (F.col("in_src_mac") % 7 == 3))
        .select(F.lit(32).alias("bits"), F.col("dst_addr").alias("net"))
        .distinct()
        .selectExpr("bits", "net", "CAST(NULL AS BIGINT) AS net_hi", "CAST(NULL AS BIGINT) AS net_lo")
    )
    return joins.in_networks(flows, nets, "src").select("flow_id", "src_addr")


@query(
    "in_nested_network_list",
    """WITH n AS (SELECT CASE WHEN flow_id % 997 = 3 THEN 31 ELSE 28 + flow_id % 5 END AS bits,
                       CASE WHEN flow_id % 997 = 3 THEN 167772160 + flow_id % 16 ELSE 167772176 + (flow_id * 7919) % 65536 END AS a FROM flows),
            r AS (SELECT a - a % CAST(pow(2, 32 - bits) AS BIGINT) AS first, a - a % CAST(pow(2, 32 - bits) AS BIGINT) + CAST(pow(2, 32 - bits) AS BIGINT) - 1 AS last FROM n),
            m AS (SELECT DISTINCT a.dst_addr FROM (SELECT DISTINCT dst_addr FROM flows) a JOIN r ON a.dst_addr BETWEEN r.first AND r.last)
       SELECT flow_id, dst_addr FROM flows JOIN m USING (dst_addr)""",
)
def _(flows):
    # a network for each flow, of five lengths, many within others; few hold an address of the flows
    i = F.col("flow_id")
    bits = F.when(i % 997 == 3, F.lit(31)).otherwise(F.lit(28) + i % 5)
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(32) - bits).cast("int"))
    address = F.when(i % 997 == 3, F.lit(167772160) + i % 16).otherwise(F.lit(167772176) + (i * 7919) % 65536)
    nets = flows.select(
        bits.cast("int").alias("bits"), (address - address % size).alias("net"), F.lit(None).cast("bigint").alias("net_hi"), F.lit(None).cast("bigint").alias("net_lo")
    )
    return joins.in_networks(flows, nets, "dst").select("flow_id", "dst_addr")
