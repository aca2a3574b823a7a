"""Flow aggregation, element statistics, summaries, histograms, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.session import shared_folder
from flowtide.catalog.base import DAY, query, r6, ts
from flowtide.metrics import frequency as FQ
from flowtide.metrics.handshake import connection_table
from flowtide.operators import aggregate as AG, predicates as P, profiles, ranking, statistics as ST

_WEIGHT = "CASE WHEN aggr_flows > 0 THEN aggr_flows ELSE 1 END"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("packets", "bytes", "out_packets", "out_bytes"))
_MERGED = (
    f"{_SUMS}, {ts('min(first_ts)')} AS first_ts, {ts('max(last_ts)')} AS last_ts, "
    f"CAST(bit_or(tcp_flags) AS INT) AS tcp_flags, CAST(sum({_WEIGHT}) AS BIGINT) AS aggr_flows"
)
_V6 = ("src_hi", "src_lo", "dst_hi", "dst_lo")


def _group(keys: str) -> str:
    names = ", ".join(str(i + 1) for i in range(len(keys.split(", "))))
    return f"SELECT {keys}, {_MERGED} FROM flows GROUP BY {names}"


@query("aggregate_five_tuple", _group("src_addr, dst_addr, src_port, dst_port, prot"))
def _(flows):
    return AG.aggregate_flows(flows).drop(*_V6)


def _masked(addr: str, bits: str) -> str:
    size = f"(1::BIGINT << (32 - {bits}))"
    return f"CAST({addr} // {size} * {size} AS BIGINT)"


@query("aggregate_by_subnet", _group(f"{_masked('src_addr', '30')} AS src_net30, dst_as, prot"))
def _(flows):
    return AG.aggregate_flows(flows, ["srcip4/30", "dstas", "proto"])


@query(
    "aggregate_by_netmask",
    _group(f"{_masked('src_addr', 'src_mask')} AS src_net, {_masked('dst_addr', 'dst_mask')} AS dst_net, src_mask"),
)
def _(flows):
    out = AG.aggregate_flows(flows, ["srcnet", "dstnet", "srcmask"])
    return out.drop("src_net_hi", "src_net_lo", "dst_net_hi", "dst_net_lo")


@query(
    "aggregate_by_path",
    _group("next_hop, bgp_next_hop, router, input_if, output_if, src_vlan, dst_vlan, tos, dst_tos"),
)
def _(flows):
    out = AG.aggregate_flows(
        flows, ["next", "bgpnext", "router", "inif", "outif", "srcvlan", "dstvlan", "srctos", "dsttos"]
    )
    return out.drop(*[c for c in out.columns if c.endswith(("_hi", "_lo"))])


@query("aggregate_by_mac", _group("in_src_mac, out_src_mac, src_as"))
def _(flows):
    return AG.aggregate_flows(flows, ["insrcmac", "outsrcmac", "srcas"])


@query("aggregate_by_mpls", _group("mpls_1 // 16 AS mpls1_label, mpls_3 // 16 AS mpls3_label, dst_mask"))
def _(flows):
    return AG.aggregate_flows(flows, ["mpls1", "mpls3", "dstmask"])


_BIDIR = f"""
WITH keyed AS (
  SELECT *, prot NOT IN (6, 17) OR (src_addr, src_port) <= (dst_addr, dst_port) AS as_is FROM flows),
ends AS (
  SELECT *, CASE WHEN as_is THEN src_addr ELSE dst_addr END AS a, CASE WHEN as_is THEN src_port ELSE dst_port END AS ap,
         CASE WHEN as_is THEN dst_addr ELSE src_addr END AS b, CASE WHEN as_is THEN dst_port ELSE src_port END AS bp FROM keyed),
lead AS (
  SELECT *, first_value(as_is) OVER (PARTITION BY prot, a, ap, b, bp ORDER BY first_ts, flow_id) AS keep FROM ends),
merged AS (
  SELECT prot, CASE WHEN keep THEN a ELSE b END AS src_addr, CASE WHEN keep THEN ap ELSE bp END AS src_port,
         CASE WHEN keep THEN b ELSE a END AS dst_addr, CASE WHEN keep THEN bp ELSE ap END AS dst_port,
         CAST(sum(CASE WHEN as_is = keep THEN packets ELSE out_packets END) AS BIGINT) AS packets,
         CAST(sum(CASE WHEN as_is = keep THEN bytes ELSE out_bytes END) AS BIGINT) AS bytes,
         CAST(sum(CASE WHEN as_is = keep THEN out_packets ELSE packets END) AS BIGINT) AS out_packets,
         CAST(sum(CASE WHEN as_is = keep THEN out_bytes ELSE bytes END) AS BIGINT) AS out_bytes,
         {ts('min(first_ts)')} AS first_ts, {ts('max(last_ts)')} AS last_ts,
         CAST(bit_or(tcp_flags) AS INT) AS tcp_flags, CAST(sum({_WEIGHT}) AS BIGINT) AS aggr_flows
  FROM lead GROUP BY 1, 2, 3, 4, 5)
"""
_BIDIR_COLUMNS = [
    "src_addr", "src_port", "dst_addr", "dst_port", "prot", "packets", "bytes", "out_packets", "out_bytes",
    "first_ts", "last_ts", "tcp_flags", "aggr_flows",
]


@query("aggregate_bidirectional", f"{_BIDIR} SELECT {', '.join(_BIDIR_COLUMNS)} FROM merged")
def _(flows):
    return AG.aggregate_bidir(flows).select(*_BIDIR_COLUMNS)


_SWAP = "src_port < 1024 AND dst_port > 1024"


def _turned(a: str, b: str) -> str:
    return f"CASE WHEN {_SWAP} THEN {b} ELSE {a} END AS {a}, CASE WHEN {_SWAP} THEN {a} ELSE {b} END AS {b}"


@query(
    "aggregate_guess_direction",
    f"""{_BIDIR} SELECT {_turned('src_addr', 'dst_addr')}, {_turned('src_port', 'dst_port')},
        {_turned('packets', 'out_packets')}, {_turned('bytes', 'out_bytes')}, prot, first_ts, last_ts, tcp_flags, aggr_flows
        FROM merged""",
)
def _(flows):
    return AG.guess_direction(AG.aggregate_bidir(flows)).select(*_BIDIR_COLUMNS)


# --- element statistics -------------------------------------------------------------

_PER_VALUE = (
    "count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, "
    "min(first_ts) AS first_ts, max(last_ts) AS last_ts"
)
_SHOWN = f"flows, packets, bytes, {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts"


def _one(col: str, extra: str = "") -> str:
    return f"SELECT {extra}CAST({col} AS BIGINT) AS value, {_PER_VALUE} FROM flows GROUP BY ALL"


def _two(a: str, b: str, extra: str = "") -> str:
    both = f"SELECT *, {a} AS value FROM flows UNION ALL SELECT *, {b} FROM flows WHERE {b} <> {a}"
    return f"SELECT {extra}CAST(value AS BIGINT) AS value, {_PER_VALUE} FROM ({both}) GROUP BY ALL"


def _values(df):
    return df.drop("value_hi", "value_lo")


for _stat, _col in {
    "srcip": "src_addr", "nhip": "next_hop", "router": "router", "dstport": "dst_port", "proto": "prot",
    "tos": "tos", "dir": "dir", "srcas": "src_as", "inif": "input_if", "srcmask": "src_mask",
    "dstvlan": "dst_vlan", "insrcmac": "in_src_mac", "inmac": "in_src_mac", "mpls1": "mpls_1 // 16",
}.items():
    query(f"stat_{_stat}", f"SELECT value, {_SHOWN} FROM ({_one(_col)})")(
        lambda flows, stat=_stat: _values(ST.element_stats(flows, stat))
    )

for _stat, (_a, _b) in {
    "ip": ("src_addr", "dst_addr"), "port": ("src_port", "dst_port"), "as": ("src_as", "dst_as"),
    "if": ("input_if", "output_if"), "mask": ("src_mask", "dst_mask"), "vlan": ("src_vlan", "dst_vlan"),
    "srcmac": ("in_src_mac", "out_src_mac"), "outmac": ("out_dst_mac", "out_src_mac"),
}.items():
    query(f"stat_{_stat}", f"SELECT value, {_SHOWN} FROM ({_two(_a, _b)})")(
        lambda flows, stat=_stat: _values(ST.element_stats(flows, stat))
    )


@query("stat_port_per_protocol", f"SELECT prot, value, {_SHOWN} FROM ({_two('src_port', 'dst_port', 'prot, ')})")
def _(flows):
    return ST.element_stats(flows, "port", per_protocol=True)


_MS = "(epoch_us(last_ts) // 1000 - epoch_us(first_ts) // 1000)"
_RATES = (
    f"CASE WHEN {_MS} = 0 THEN 0 ELSE (1000 * packets) // {_MS} END AS pps, "
    f"CASE WHEN {_MS} = 0 THEN 0 ELSE (8000 * bytes) // {_MS} END AS bps, "
    "CASE WHEN packets = 0 THEN 0 ELSE bytes // packets END AS bpp"
)


@query(
    "stat_ip_shares",
    f"""WITH s AS ({_two('src_addr', 'dst_addr')}),
        t AS (SELECT count(*) AS tf, sum(packets) AS tp, sum(bytes) AS tb FROM flows)
        SELECT value, {_SHOWN}, {_RATES}, {r6('flows * 100.0 / tf')} AS flows_share,
               {r6('packets * 100.0 / tp')} AS packets_share, {r6('bytes * 100.0 / tb')} AS bytes_share
        FROM s, t""",
)
def _(flows):
    return _values(ST.with_shares(ST.element_stats(flows, "ip"), flows))


_CLASS = {"": "true", "_tcp": "prot = 6", "_udp": "prot = 17", "_icmp": "prot IN (1, 58)", "_other": "prot NOT IN (1, 6, 17, 58)"}
_COUNTERS = ", ".join(
    f"CAST(coalesce(sum({v}) FILTER ({c}), 0) AS BIGINT) AS {n}{suffix}"
    for suffix, c in _CLASS.items()
    for n, v in (("flows", "1"), ("packets", "packets"), ("bytes", "bytes"))
)


@query(
    "summary",
    f"""WITH s AS (SELECT {_COUNTERS}, min(first_ts) AS f, max(last_ts) AS l, epoch_us(max(last_ts)) // 1000 - epoch_us(min(first_ts)) // 1000 AS ms FROM flows)
        SELECT * EXCLUDE (f, l, ms), {ts('f')} AS first_seen, {ts('l')} AS last_seen, (8000 * bytes) // ms AS avg_bps,
               (1000 * packets) // ms AS avg_pps, bytes // packets AS avg_bpp FROM s""",
)
def _(flows):
    return ST.summary(flows)


@query(
    "port_histogram",
    """SELECT prot, side, port, count(*) AS flows FROM (
         SELECT prot, 'src' AS side, src_port AS port FROM flows UNION ALL SELECT prot, 'dst', dst_port FROM flows)
       WHERE prot IN (6, 17) GROUP BY ALL""",
)
def _(flows):
    return ST.port_histogram(flows)


@query(
    "bpp_histogram",
    """SELECT prot, CASE WHEN packets = 0 THEN 0 ELSE bytes // packets END AS bpp, count(*) AS flows
       FROM flows WHERE prot IN (6, 17) GROUP BY ALL""",
)
def _(flows):
    return ST.bpp_histogram(flows)


@query(
    "bpp_histogram_capped",
    """SELECT prot, least(CASE WHEN packets = 0 THEN 0 ELSE bytes // packets END, 9000) AS bpp, count(*) AS flows
       FROM flows WHERE prot IN (6, 17) GROUP BY ALL""",
)
def _(flows):
    return ST.bpp_histogram(flows, ST.MAX_BPP)


# --- ranking ------------------------------------------------------------------------


def _ranked(source: str, flows_column: str, tie: str, n: int) -> str:
    value = {
        "flows": flows_column, "packets": "packets", "bytes": "bytes",
        "pps": f"(CASE WHEN {_MS} = 0 THEN 0 ELSE (1000 * packets) // {_MS} END)",
        "bps": f"(CASE WHEN {_MS} = 0 THEN 0 ELSE (8000 * bytes) // {_MS} END)",
        "bpp": "(CASE WHEN packets = 0 THEN 0 ELSE bytes // packets END)",
    }
    limit = f"LIMIT {n}" if n else ""
    return " UNION ALL ".join(
        f"(SELECT *, '{o}' AS ordered_by, CAST({v} AS BIGINT) AS rank_value FROM {source} WHERE {v} > 0 "
        f"ORDER BY {v} DESC, {tie} {limit})"
        for o, v in value.items()
    )


@query(
    "top_ports_six_orders",
    f"""WITH s AS ({_two('src_port', 'dst_port')}), r AS ({_ranked('s', 'flows', 'value', 10)})
        SELECT value, {_SHOWN}, ordered_by, rank_value FROM r""",
)
def _(flows):
    return ranking.top_elements(ST.element_stats(flows, "port"), ranking.ORDERS, 10)


@query(
    "rank_all_source_addresses",
    f"""WITH s AS ({_one('src_addr')}), r AS ({_ranked('s', 'flows', 'value', 0)})
        SELECT value, {_SHOWN}, ordered_by, rank_value FROM r""",
)
def _(flows):
    return _values(ranking.top_elements(ST.element_stats(flows, "srcip"), ranking.ORDERS, 0))


_FIVE = "src_addr, dst_addr, src_port, dst_port, prot"


@query(
    "top_flows_six_orders",
    f"""WITH s AS (SELECT {_FIVE}, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
                          min(first_ts) AS first_ts, max(last_ts) AS last_ts, CAST(sum({_WEIGHT}) AS BIGINT) AS aggr_flows
                   FROM flows GROUP BY ALL), r AS ({_ranked('s', 'aggr_flows', _FIVE, 10)})
        SELECT {_FIVE}, packets, bytes, {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts, aggr_flows, ordered_by, rank_value
        FROM r""",
)
def _(flows):
    merged = AG.aggregate_flows(flows)
    top = ranking.top_flows(merged, ranking.ORDERS, 10, tie=_FIVE.split(", "))
    return top.drop(*_V6, "out_packets", "out_bytes", "tcp_flags")


@query(
    "first_flows",
    "SELECT flow_id, src_addr, dst_addr, bytes FROM flows WHERE prot = 17 ORDER BY flow_id LIMIT 100",
)
def _(flows):
    return ranking.limit_flows(flows.filter(P.proto("udp")), 100).select("flow_id", "src_addr", "dst_addr", "bytes")


@query("date_sorted_flows", f"SELECT flow_id, {ts('first_ts')} AS first_ts FROM flows")
def _(flows):
    return ranking.sort_by_date(flows).select("flow_id", "first_ts")


# --- per-slot counts ----------------------------------------------------------------

for _key, _cols in FQ.FREQUENCY_KEYS.items():
    _shown = [c for c in _cols if not c.endswith(("_hi", "_lo"))]
    query(
        f"frequency_{_key}",
        f"SELECT {ts('slot')} AS slot, {', '.join(_shown)}, count(*) AS n FROM flows GROUP BY ALL",
    )(lambda flows, key=_key, cols=tuple(_shown): FQ.frequency(flows, key, DAY).select("slot", *cols, "n"))

_HOUR = "date_trunc('hour', first_ts)"

_KEYS_SQL = {
    "src": "src_addr", "dst": "dst_addr", "src_sport": "src_addr, src_port", "dst_dport": "dst_addr, dst_port",
    "pkts_bytes": "packets, bytes", "src_sport_dst_dport": "src_addr, src_port, dst_addr, dst_port",
}


@query(
    "unique_counts",
    f"""SELECT {ts('slot')} AS slot, """
    + ", ".join(f"count(DISTINCT ({c})) AS unique_{k}" for k, c in _KEYS_SQL.items())
    + " FROM flows GROUP BY ALL",
)
def _(flows):
    return FQ.unique_counts(flows, DAY)


@query(
    "unique_counts_from_stored_sketches",
    f"""SELECT {ts("date_trunc('week', first_ts)")} AS week, count(DISTINCT src_addr) AS src, count(DISTINCT (dst_addr, dst_port)) AS dst_dport,
               count(DISTINCT (src_addr, src_port, dst_addr, dst_port)) AS src_sport_dst_dport, true AS within
        FROM flows GROUP BY ALL""",
)
def _(flows):
    """Weeks united from sketches of days, and whether all are within three percent of the exact counts."""
    spark = flows.sparkSession
    keys = ("src", "dst_dport", "src_sport_dst_dport")
    path = shared_folder(spark, "sketches")
    FQ.unique_sketches(flows, DAY, keys).write.parquet(path)
    week = F.date_trunc("week", "slot").cast("timestamp_ntz").alias("week")
    united = FQ.united_counts(spark.read.parquet(path), week, keys=keys)
    exact = flows.groupBy(F.date_trunc("week", "first_ts").cast("timestamp_ntz").alias("week")).agg(
        *[F.count_distinct(F.struct(*FQ.FREQUENCY_KEYS[k])).alias(k) for k in keys]
    )
    near = [F.abs(F.col(f"unique_{k}") / F.col(k) - 1) <= 0.03 for k in keys]
    return exact.join(united, "week").select("week", *keys, (near[0] & near[1] & near[2]).alias("within"))


@query("unique_counts_approximate")
def _(flows):
    return FQ.unique_counts_approx(flows, DAY)


@query("bytes_per_slot", f"SELECT {ts('slot')} AS slot, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows GROUP BY ALL")
def _(flows):
    return FQ.bytes_per_slot(flows, DAY)


@query(
    "flows_per_hour",
    f"SELECT {ts(_HOUR)} AS slot, count(*) AS flows FROM flows GROUP BY ALL",
)
def _(flows):
    return FQ.flows_per_slot(flows, "1 hour")


@query(
    "packets_per_slot",
    f"""SELECT {ts('slot')} AS slot, CAST(sum(packets) AS BIGINT) AS packets, {r6('sum(packets) / 60.0')} AS packets_per_s
        FROM flows GROUP BY slot""",
)
def _(flows):
    return FQ.packets_per_slot(flows, DAY)


# --- channels -----------------------------------------------------------------------

CHANNELS = {
    "web": lambda: P.port_in([80, 443]),
    "dns": lambda: P.port("=", 53),
    "large": lambda: P.bytes_(">", 1000),
    "r1_udp": lambda: profiles.channel(P.proto("udp"), ["r1"]),
}
_CHANNEL_ROWS = """chan AS (
  SELECT 'web' AS channel, * FROM flows WHERE src_port IN (80, 443) OR dst_port IN (80, 443)
  UNION ALL SELECT 'dns', * FROM flows WHERE src_port = 53 OR dst_port = 53
  UNION ALL SELECT 'large', * FROM flows WHERE bytes > 1000
  UNION ALL SELECT 'r1_udp', * FROM flows WHERE ident = 'r1' AND prot = 17)"""


def channels():
    return {n: p() for n, p in CHANNELS.items()}


@query(
    "channel_summary",
    f"WITH {_CHANNEL_ROWS} SELECT channel, {_COUNTERS}, {ts('min(first_ts)')} AS first_seen, {ts('max(last_ts)')} AS last_seen FROM chan GROUP BY channel",
)
def _(flows):
    return profiles.channel_summary(flows, channels())


@query(
    "channel_split",
    f"WITH {_CHANNEL_ROWS} SELECT channel, flow_id FROM chan",
)
def _(flows):
    return profiles.split(flows, channels()).select("channel", "flow_id")


@query(
    "channel_timeseries",
    f"WITH {_CHANNEL_ROWS} SELECT channel, {ts('slot')} AS slot, {_COUNTERS} FROM chan GROUP BY channel, slot",
)
def _(flows):
    return profiles.channel_timeseries(flows, channels(), DAY)


@query(
    "channel_port_histogram",
    f"""WITH {_CHANNEL_ROWS} SELECT channel, prot, side, port, count(*) AS flows FROM (
          SELECT channel, prot, 'src' AS side, src_port AS port FROM chan UNION ALL SELECT channel, prot, 'dst', dst_port FROM chan)
        WHERE prot IN (6, 17) GROUP BY ALL""",
)
def _(flows):
    return profiles.channel_port_histogram(flows, channels())


@query(
    "channel_bpp_histogram",
    f"""WITH {_CHANNEL_ROWS} SELECT channel, prot, least(bytes // packets, 9000) AS bpp, count(*) AS flows
        FROM chan WHERE prot IN (6, 17) GROUP BY ALL""",
)
def _(flows):
    return profiles.channel_bpp_histogram(flows, channels())


@query("connection_table", f"""SELECT {ts('slot')} AS slot, src_addr, dst_addr, count(*) AS n,
       count(*) FILTER ((tcp_flags & 18) = 2) AS syn, count(*) FILTER ((tcp_flags & 18) = 18) AS synack,
       count(*) FILTER ((tcp_flags & 16) > 0) AS ack, count(*) FILTER ((tcp_flags & 4) > 0) AS rst,
       count(*) FILTER ((tcp_flags & 2) > 0) AS any_syn,
       epoch_us(min(first_ts)) // 1000000 AS first_s FROM flows GROUP BY slot, src_addr, dst_addr""")
def _(flows):
    return connection_table(flows, DAY).drop(*_V6)
