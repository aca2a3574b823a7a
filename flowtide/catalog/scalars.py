"""Scalar functions and text forms over every flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.catalog.base import query, ts
from flowtide.functions import addresses as A, names as N, rates as R, text as X
from flowtide.operators import joins


def _v4(e: str) -> str:
    return f"concat_ws('.', ({e} >> 24) & 255, ({e} >> 16) & 255, ({e} >> 8) & 255, {e} & 255)"


def _mac(e: str) -> str:
    return f"regexp_replace(printf('%012x', {e}), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"


def _letters(e: str) -> str:
    return "concat(" + ", ".join(
        f"CASE WHEN ({e} & {bit}) <> 0 THEN '{c}' ELSE '.' END"
        for bit, c in ((32, "U"), (16, "A"), (8, "P"), (4, "R"), (2, "S"), (1, "F"))
    ) + ")"


_NAMES = "CASE prot WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END"


@query(
    "flow_rates",
    """SELECT flow_id, dur_ms AS duration_ms,
              CASE WHEN dur_ms = 0 THEN 0 ELSE (1000 * packets) // dur_ms END AS pps,
              CASE WHEN dur_ms = 0 THEN 0 ELSE (8000 * bytes) // dur_ms END AS bps,
              CASE WHEN packets = 0 THEN 0 ELSE bytes // packets END AS bpp
       FROM flows""",
)
def _(flows):
    return flows.select(
        "flow_id", R.duration_ms().alias("duration_ms"), R.pps().alias("pps"),
        R.bps().alias("bps"), R.bpp().alias("bpp"),
    )


@query(
    "tcp_flags_text",
    f"""SELECT flow_id, {_letters('tcp_flags')} AS flags,
               CASE WHEN (tcp_flags + prot * 4) > 63 THEN concat('  0x', printf('%x', tcp_flags + prot * 4))
                    ELSE {_letters('(tcp_flags + prot * 4)')} END AS other
        FROM flows""",
)
def _(flows):
    return flows.select(
        "flow_id",
        X.flags_string(F.col("tcp_flags")).alias("flags"),
        X.flags_string(F.col("tcp_flags") + F.col("prot") * 4).alias("other"),
    )


@query("ipv4_text", f"SELECT flow_id, {_v4('src_addr')} AS src, {_v4('next_hop')} AS next_hop FROM flows")
def _(flows):
    return flows.select(
        "flow_id", A.ip4_string(F.col("src_addr")).alias("src"), A.ip_string("next_hop").alias("next_hop")
    )


# IPv6 addresses made from the flow: a documentation prefix, then the v4 address and the flow number
_HI, _LO = 2306139568115548160, 4294967296


@query(
    "ipv6_text",
    rf"""WITH a AS (SELECT flow_id, printf('%016x', {_HI} + src_addr) || printf('%016x', {_LO} * dst_port + flow_id) AS h FROM flows),
        b AS (SELECT flow_id, regexp_replace(h, '(....)(....)(....)(....)(....)(....)(....)(....)',
                                             '\1:\2:\3:\4:\5:\6:\7:\8') AS ip6 FROM a)
        SELECT flow_id, ip6, left(ip6, 7) || '..' || right(ip6, 7) AS short FROM b""",
)
def _(flows):
    ip6 = A.ip6_string(F.lit(_HI) + F.col("src_addr"), F.lit(_LO) * F.col("dst_port") + F.col("flow_id"))
    return flows.select("flow_id", ip6.alias("ip6"), A.condense_v6(ip6).alias("short"))


@query(
    "networks",
    """SELECT flow_id, CAST(src_addr // (1::BIGINT << (32 - src_mask)) * (1::BIGINT << (32 - src_mask)) AS BIGINT) AS src_net,
              CAST(dst_addr // (1::BIGINT << (32 - dst_mask)) * (1::BIGINT << (32 - dst_mask)) AS BIGINT) AS dst_net
       FROM flows""",
)
def _(flows):
    return flows.select("flow_id", A.src_network().alias("src_net"), A.dst_network().alias("dst_net"))


@query(
    "address_and_port_text",
    f"""SELECT flow_id, {_v4('src_addr')} || ':' || src_port AS src,
               {_v4('dst_addr')} || ':' || CASE WHEN prot IN (1, 58) THEN (dst_port >> 8) || '.' || (dst_port & 255)
                                                ELSE CAST(dst_port AS VARCHAR) END AS dst,
               CASE WHEN prot IN (1, 58) THEN dst_port >> 8 ELSE -1 END AS icmp_type,
               CASE WHEN prot IN (1, 58) THEN dst_port & 255 ELSE -1 END AS icmp_code
        FROM flows""",
)
def _(flows):
    return flows.select(
        "flow_id", A.addr_port_string("src").alias("src"), A.addr_port_string("dst").alias("dst"),
        F.coalesce(A.icmp_type(), F.lit(-1)).alias("icmp_type"),
        F.coalesce(A.icmp_code(), F.lit(-1)).alias("icmp_code"),
    )


@query("mac_text", f"SELECT flow_id, {_mac('in_src_mac')} AS in_src, {_mac('out_dst_mac')} AS out_dst FROM flows")
def _(flows):
    return flows.select(
        "flow_id", A.mac_string(F.col("in_src_mac")).alias("in_src"),
        A.mac_string(F.col("out_dst_mac")).alias("out_dst"),
    )


@query(
    "mpls_text",
    """SELECT flow_id, (mpls_1 // 16) || '-' || ((mpls_1 // 2) % 8) || '-' || (mpls_1 % 2) AS first,
              (mpls_2 // 16) || '-' || ((mpls_2 // 2) % 8) || '-' || (mpls_2 % 2) AS second, '0-0-0' AS last,
              mpls_3 // 16 AS bottom
       FROM flows""",
)
def _(flows):
    return flows.select(
        "flow_id", A.mpls_string(1).alias("first"), A.mpls_string(2).alias("second"),
        A.mpls_string(10).alias("last"), A.mpls_bottom_label().alias("bottom"),
    )


@query(
    "protocol_and_status_names",
    f"""SELECT flow_id, {_NAMES} AS protocol, CASE fwd_status WHEN 16 THEN 'Drop' WHEN 1 THEN 'Forw' END AS status
        FROM flows""",
)
def _(flows):
    return flows.select(
        "flow_id", N.proto_name(F.col("prot")).alias("protocol"),
        N.fwd_status_name(F.col("fwd_status")).alias("status"),
    )


def _scaled(e: str) -> str:
    return (
        f"CASE WHEN {e} >= 1000000000000 THEN printf('%.1f T', {e} / 1e12)"
        f" WHEN {e} >= 1000000000 THEN printf('%.1f G', {e} / 1e9)"
        f" WHEN {e} >= 1000000 THEN printf('%.1f M', {e} / 1e6) ELSE CAST({e} AS VARCHAR) END"
    )


@query(
    "scaled_numbers",
    f"""SELECT flow_id, {_scaled('bytes * 997')} AS mega, {_scaled('bytes * 997003')} AS giga,
               {_scaled('bytes * 997003001')} AS tera FROM flows""",
)
def _(flows):
    b = F.col("bytes")
    return flows.select(
        "flow_id", X.scaled_number(b * 997).alias("mega"), X.scaled_number(b * 997003).alias("giga"),
        X.scaled_number(b * 997003001).alias("tera"),
    )


@query(
    "time_text",
    "SELECT flow_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last FROM flows",
)
def _(flows):
    return flows.select(
        "flow_id", X.time_string(F.col("first_ts")).alias("first"), X.time_string(F.col("last_ts")).alias("last")
    )


_PORTS = {
    "sap": f"lpad({_v4('src_addr')}, 16, ' ') || ':' || rpad(CAST(src_port AS VARCHAR), 5, ' ')",
    "dap": f"lpad({_v4('dst_addr')}, 16, ' ') || ':' || rpad(CASE WHEN prot = 1 THEN (dst_port >> 8) || '.' || (dst_port & 255) ELSE CAST(dst_port AS VARCHAR) END, CAST(greatest(5, length(CASE WHEN prot = 1 THEN (dst_port >> 8) || '.' || (dst_port & 255) ELSE '' END)) AS INT), ' ')",
}
_HEAD = (
    f"{ts('first_ts')} || ' ' || printf('%9.3f', dur_ms / 1000.0) || ' ' || rpad({_NAMES}, 5, ' ') || ' ' || "
    f"{_PORTS['sap']}"
)


def _w(e: str, n: int) -> str:
    return f"lpad(CAST({e} AS VARCHAR), {n}, ' ')"


@query(
    "lines_default",
    f"""SELECT {_HEAD} || ' -> ' || {_PORTS['dap']} || ' ' || {_w('packets', 8)} || ' ' || {_w('bytes', 8)} || ' ' || {_w('aggr_flows', 5)} AS line
        FROM flows""",
)
def _(flows):
    return X.format_flows(flows, "line")


@query(
    "lines_extended",
    f"""SELECT {_HEAD} || ' -> ' || {_PORTS['dap']} || ' ' || {_letters('tcp_flags')} || ' ' || {_w('tos', 3)}
               || ' ' || {_w('packets', 8)} || ' ' || {_w('bytes', 8)}
               || ' ' || {_w('CASE WHEN dur_ms = 0 THEN 0 ELSE (1000 * packets) // dur_ms END', 8)}
               || ' ' || lpad({_scaled('(CASE WHEN dur_ms = 0 THEN 0 ELSE (8000 * bytes) // dur_ms END)')}, 8, ' ')
               || ' ' || {_w('bytes // packets', 6)} || ' ' || {_w('aggr_flows', 5)} AS line
        FROM flows""",
)
def _(flows):
    return X.format_flows(flows, "extended")


@query(
    "lines_bidirectional",
    f"""SELECT {_HEAD} || ' <-> ' || {_PORTS['dap']} || ' ' || {_letters('tcp_flags')} || ' ' || {_w('tos', 3)}
               || ' ' || {_w('out_packets', 8)} || ' ' || {_w('packets', 8)} || ' ' || {_w('out_bytes', 8)}
               || ' ' || {_w('bytes', 8)} || ' ' || {_w('aggr_flows', 5)} AS line FROM flows""",
)
def _(flows):
    return X.format_flows(flows, "bilong")


@query(
    "lines_custom_tokens",
    f"""SELECT {_w('src_as', 6)} || '|' || {_w('dst_as', 6)} || '|' || {_w('input_if', 6)} || '|' || {_w('output_if', 6)}
               || '|' || lpad({_v4('next_hop')}, 16, ' ') || '|' || lpad({_v4('router')}, 16, ' ')
               || '|' || {_w('src_mask', 5)} || '|' || {_w('dst_vlan', 5)} || '|  ' || CASE dir WHEN 0 THEN 'I' ELSE 'E' END
               || '|' || {_mac('in_dst_mac')} || '|' || {_mac('out_src_mac')}
               || '|' || {_w('engine_type', 3)} || '/' || rpad(CAST(engine_id AS VARCHAR), 3, ' ') AS line
        FROM flows""",
)
def _(flows):
    return X.format_flows(flows, "%sas|%das|%in|%out|%nh|%ra|%smk|%dvln|%dir|%idmc|%osmc|%eng")


_SERVICE = """CASE WHEN prot = 6 AND {p} = 22 THEN 'SSH' WHEN prot = 6 AND {p} = 443 THEN 'HTTPS'
                   WHEN prot = 6 AND {p} = 993 THEN 'IMAPS' WHEN prot IN (6, 17) AND {p} = 53 THEN 'DNS'
                   WHEN prot IN (6, 17) AND {p} = 80 THEN 'HTTP' END"""


@query(
    "service_names",
    f"SELECT flow_id, {_SERVICE.format(p='src_port')} AS src_service, {_SERVICE.format(p='dst_port')} AS dst_service FROM flows",
)
def _(flows):
    return flows.select(
        "flow_id",
        N.service_name(F.col("src_port"), F.col("prot")).alias("src_service"),
        N.service_name(F.col("dst_port"), F.col("prot")).alias("dst_service"),
    )


@query(
    "service_lookup_join",
    f"""SELECT {_SERVICE.format(p='dst_port')} AS service, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes
        FROM flows GROUP BY 1""",
)
def _(flows):
    return (
        joins.name_services(flows)
        .groupBy("service")
        .agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"))
    )
