"""Timeslot metrics. The SQL states each definition directly, without the rewrites used here."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.catalog.aggregates import _KEYS_SQL as KEYS
from flowtide.catalog.base import DAY, query, r6, ts
from flowtide.metrics import centroid as CE, divergence as DV, entropy as EN, flooding as FL
from flowtide.metrics import frequency as FQ, handshake as HS, momentum as MO
from flowtide.plans.registry import METRICS, metric, metric_run
from flowtide.plans.slots import calendar, slot_width
from flowtide.streaming.slots import late_flows

SLOT = f"{ts('slot')} AS slot"


def _entropy_cte(name: str, cols: str) -> str:
    return (
        f"f_{name} AS (SELECT slot, {cols}, count(*) AS n FROM flows GROUP BY ALL), "
        f"p_{name} AS (SELECT slot, n / sum(n) OVER (PARTITION BY slot) AS p FROM f_{name}), "
        f"h_{name} AS (SELECT slot, sum(-p * log2(p)) AS h FROM p_{name} GROUP BY slot)"
    )


@query(
    "entropy_source",
    f"WITH {_entropy_cte('src', 'src_addr')} SELECT {SLOT}, {r6('h')} AS entropy, CAST(h <= 0.30 AS INT) AS alarm FROM h_src",
)
def _(flows):
    return EN.entropy(flows, "src", DAY)


_ALL_H = ", ".join(_entropy_cte(k, c) for k, c in KEYS.items())
_JOIN_H = "h_src " + " ".join(f"JOIN h_{k} USING (slot)" for k in KEYS if k != "src")


@query(
    "entropy_six_keys",
    f"""WITH {_ALL_H} SELECT {SLOT}, {', '.join(f"{r6(f'h_{k}.h')} AS entropy_{k}, CAST(h_{k}.h <= 0.30 AS INT) AS alarm_{k}" for k in KEYS)}
        FROM {_JOIN_H}""",
)
def _(flows):
    return EN.entropies(flows, DAY)


@query(
    "entropy_alarms_raised_threshold",
    f"""WITH {_entropy_cte('dst_dport', 'dst_addr, dst_port')} SELECT {SLOT}, {r6('h')} AS entropy,
        CAST(h <= 7.55 AS INT) AS alarm FROM h_dst_dport""",
)
def _(flows):
    return EN.entropy(flows, "dst_dport", DAY, threshold=7.55)


_CAL = "cal AS (SELECT slot, lag(slot) OVER (ORDER BY slot) AS prev FROM (SELECT DISTINCT slot FROM flows))"


def _divergence_cte(name: str, cols: str) -> str:
    same = " AND ".join(f"c.{x} = p.{x}" for x in cols.split(", "))
    return (
        f"g_{name} AS (SELECT slot, {cols}, count(*) AS n FROM flows GROUP BY ALL), "
        f"j_{name} AS (SELECT c.slot, c.n AS c, p.n AS p FROM g_{name} c JOIN cal ON cal.slot = c.slot "
        f"JOIN g_{name} p ON p.slot = cal.prev AND {same}), "
        f"n_{name} AS (SELECT slot, c / sum(c) OVER (PARTITION BY slot) AS pc, p / sum(p) OVER (PARTITION BY slot) AS pp FROM j_{name}), "
        f"s_{name} AS (SELECT slot, count(*) AS k, sum(pc * ln(pc / pp)) AS kl, ln(sum(pow(pc, 5) / pow(pp, 4))) / 4 AS renyi "
        f"FROM n_{name} GROUP BY slot), "
        f"d_{name} AS (SELECT cal.slot, prev IS NOT NULL AS has_prev, coalesce(k, 0) AS k, coalesce(kl, 0) AS kl, "
        f"coalesce(renyi, 0) AS renyi FROM cal LEFT JOIN s_{name} ON s_{name}.slot = cal.slot)"
    )


_ALL_D = _CAL + ", " + ", ".join(_divergence_cte(k, c) for k, c in KEYS.items())
_JOIN_D = "d_src " + " ".join(f"JOIN d_{k} USING (slot)" for k in KEYS if k != "src")


def _wide(metric_name: str, limit: float) -> str:
    cols = ", ".join(
        f"{r6(f'd_{k}.{metric_name}')} AS {metric_name}_{k}, "
        f"CAST(d_{k}.{metric_name} >= {limit} AND d_{k}.has_prev AS INT) AS alarm_{k}"
        for k in KEYS
    )
    return f"WITH {_ALL_D} SELECT {SLOT}, {cols} FROM {_JOIN_D}"


@query("kl_divergence_six_keys", _wide("kl", 1.80))
def _(flows):
    return DV.kl_divergence(flows, DAY)


@query("renyi_divergence_six_keys", _wide("renyi", 2.70))
def _(flows):
    return DV.renyi_divergence(flows, DAY)


@query("divergence_alarms_lower_thresholds", f"""WITH {_CAL}, {_divergence_cte('src_sport', 'src_addr, src_port')}
        SELECT {SLOT}, {r6('kl')} AS kl, {r6('renyi')} AS renyi, CAST(kl >= 0.2 AND has_prev AS INT) AS kl_alarm,
               CAST(renyi >= 1.0 AND has_prev AS INT) AS renyi_alarm FROM d_src_sport""")
def _(flows):
    out = DV.divergences(flows, DAY, ("src_sport",), kl_threshold=0.2, renyi_threshold=1.0)
    return out.select("slot", "kl", "renyi", "kl_alarm", "renyi_alarm")


@query(
    "common_keys_with_previous_slot",
    f"WITH {_ALL_D} " + " UNION ALL ".join(f"SELECT '{k}' AS key, {SLOT}, k AS common_keys FROM d_{k}" for k in KEYS),
)
def _(flows):
    return DV.divergences(flows, DAY).select("key", "slot", "common_keys")


@query("slot_calendar", f"""WITH c AS (SELECT slot, count(*) AS flows FROM flows GROUP BY slot)
        SELECT {SLOT}, flows, coalesce({ts('lag(slot) OVER (ORDER BY slot)')}, '-') AS prev_slot FROM c""")
def _(flows):
    cal = calendar(flows, DAY)
    return cal.withColumn("prev_slot", F.coalesce(F.date_format("prev_slot", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("-")))


@query("minute_slots", f"""SELECT {ts("date_trunc('minute', first_ts)")} AS slot, count(*) AS flows FROM flows GROUP BY ALL""")
def _(flows):
    return FQ.flows_per_slot(flows, slot_width(300))


_PRODUCT = f"""SELECT {ts('h_src.slot')} AS slot, {r6('h')} AS entropy_src, {r6('kl')} AS kl_src, {r6('h * kl')} AS product
               FROM h_src JOIN d_src USING (slot)"""
_PRODUCT_CTE = f"{_CAL}, {_entropy_cte('src', 'src_addr')}, {_divergence_cte('src', 'src_addr')}"


@query("kl_entropy_product", f"WITH {_PRODUCT_CTE} {_PRODUCT}")
def _(flows):
    return metric_run(flows, ["kl_entropy_product"], DAY)["kl_entropy_product"]


# --- handshakes ---------------------------------------------------------------------

_CONN = """conn AS (
  SELECT slot, src_addr, dst_addr, count(*) AS n, count(*) FILTER ((tcp_flags & 18) = 2) AS syn,
         count(*) FILTER ((tcp_flags & 18) = 18) AS synack, count(*) FILTER ((tcp_flags & 16) > 0) AS ack,
         count(*) FILTER ((tcp_flags & 4) > 0) AS rst, count(*) FILTER ((tcp_flags & 2) > 0) AS any_syn
  FROM flows GROUP BY ALL),
pairs AS (
  SELECT f.slot, f.src_addr, f.dst_addr, f.n, f.syn, f.synack, f.ack, f.rst,
         r.n AS rev_n, r.syn AS rev_syn, r.synack AS rev_synack, r.ack AS rev_ack, r.rst AS rev_rst
  FROM conn f JOIN conn r ON r.slot = f.slot AND r.src_addr = f.dst_addr AND r.dst_addr = f.src_addr)"""


@query(
    "reverse_connection_pairs",
    f"WITH {_CONN} SELECT {SLOT}, src_addr, dst_addr, n, syn, synack, ack, rst, rev_n, rev_syn, rev_synack, rev_ack, rev_rst FROM pairs",
)
def _(flows):
    out = HS.reverse_pairs(HS.pair_table(flows, DAY))
    return out.drop("src_hi", "src_lo", "dst_hi", "dst_lo", "first_s", "rev_first_s")


def _total(e: str, name: str) -> str:
    return f"CAST(coalesce(sum({e}), 0) AS BIGINT) AS {name}"


_COUNTS = f"""{_CONN},
per_slot AS (SELECT slot, CAST(sum(n) AS BIGINT) AS flows, CAST(sum(any_syn) AS BIGINT) AS syn_flows FROM conn GROUP BY slot),
u AS (SELECT per_slot.slot, flows, syn_flows,
        {_total('CASE WHEN rev_synack = 0 THEN syn END', 'syn_no_answer')},
        {_total('CASE WHEN rev_rst > 0 THEN syn END', 'syn_server_reset')},
        {_total('CASE WHEN rev_synack > 0 THEN syn END', 'syn_synack')},
        {_total('CASE WHEN rst > 0 THEN syn * rev_synack END', 'syn_synack_client_reset')},
        {_total('syn * (rev_n - rev_synack) + CASE WHEN ack = 0 THEN syn * rev_synack ELSE 0 END', 'incomplete')},
        {_total('CASE WHEN ack > 0 THEN syn * rev_synack END', 'complete')}
      FROM per_slot LEFT JOIN pairs USING (slot) GROUP BY per_slot.slot, flows, syn_flows)"""


@query(
    "handshake_counts",
    f"""WITH {_COUNTS} SELECT {SLOT}, flows, syn_flows, syn_no_answer, syn_server_reset, syn_synack,
        syn_synack_client_reset, incomplete, complete FROM u""",
)
def _(flows):
    return HS.handshake_counts(flows, DAY)


_FOUR = ["syn_no_answer", "syn_server_reset", "syn_synack", "syn_synack_client_reset"]
_FLOOD = f"""{_COUNTS},
t AS (SELECT slot, {', '.join(_FOUR)}, {' + '.join(_FOUR)} AS unusual_total FROM u),
h AS (SELECT *, CASE WHEN unusual_total = 0 THEN 0 ELSE {' + '.join(
    f'(CASE WHEN {c} = 0 THEN 0 ELSE -({c} / unusual_total) * log2({c} / unusual_total) END)' for c in _FOUR)} END AS entropy FROM t)"""


def _flood_sql(threshold: float) -> str:
    return f"""WITH {_FLOOD},
        v AS (SELECT *, sum(CASE WHEN entropy > {threshold} THEN 1 ELSE 0 END) OVER (ORDER BY slot) AS island FROM h),
        w AS (SELECT *, CASE WHEN entropy <= {threshold} THEN
                row_number() OVER (PARTITION BY island, entropy <= {threshold} ORDER BY slot) ELSE 0 END AS run FROM v)
        SELECT {SLOT}, {', '.join(_FOUR)}, unusual_total, {r6('entropy')} AS entropy, run,
               CAST(run > 0 AND run % 3 = 0 AS INT) AS alarm FROM w"""


@query("syn_flood", _flood_sql(0.3))
def _(flows):
    return HS.syn_flood(flows, DAY)


@query("syn_flood_alarm_streaks", _flood_sql(1.9))
def _(flows):
    return HS.syn_flood(flows, DAY, threshold=1.9)


def _ddos_sql(high: float, low: float) -> str:
    return f"""WITH {_COUNTS},
        d AS (SELECT slot, syn_flows / flows AS s, incomplete / flows AS i, complete / flows AS c FROM u)
        SELECT {SLOT}, {r6('s')} AS syn_rate, {r6('i')} AS incomplete_rate, {r6('c')} AS complete_rate,
               CAST(s >= {high} AS INT) AS alarm_high, CAST(s < {high} AND c - i >= {low} AS INT) AS alarm_low FROM d"""


@query("ddos_test", _ddos_sql(0.3, 0.035))
def _(flows):
    return HS.ddos_test(flows, DAY)


@query("ddos_test_low_rate", _ddos_sql(0.36, -0.23))
def _(flows):
    return HS.ddos_test(flows, DAY, high=0.36, low=-0.23)


# --- flooding -----------------------------------------------------------------------


def _flooding_sql(packets: int, dst: float, sport: float, pps: float) -> str:
    return f"""WITH {_entropy_cte('dst', 'dst_addr')}, {_entropy_cte('sport', 'src_port')},
        v AS (SELECT slot, CAST(sum(packets) AS BIGINT) AS packets FROM flows GROUP BY slot)
        SELECT {SLOT}, {r6('h_dst.h')} AS entropy_dst, {r6('h_sport.h')} AS entropy_src_port, packets,
               {r6('packets / 60.0')} AS packets_per_s,
               CASE WHEN packets < {packets} THEN 0 WHEN h_dst.h > {dst} THEN 1 WHEN h_sport.h > {sport} THEN 2
                    WHEN packets / 60.0 < {pps} THEN 3 ELSE 4 END AS level
        FROM h_dst JOIN h_sport USING (slot) JOIN v USING (slot)"""


@query("flooding_level", _flooding_sql(2_000_000, 8.85, 8.45, 38_000))
def _(flows):
    return FL.flooding_level(flows, DAY)


@query("flooding_level_low_limits", _flooding_sql(8_000, 3.97, 5.24, 140))
def _(flows):
    return FL.flooding_level(flows, DAY, 8_000, 3.97, 5.24, 140)


# --- momentum -----------------------------------------------------------------------

_SERIES = """b AS (SELECT slot, CAST(sum(packets) AS BIGINT) AS packets FROM flows GROUP BY slot),
s AS (SELECT slot, packets, lag(packets) OVER o AS p1, lag(packets, 2) OVER o AS p2, row_number() OVER o AS i FROM b WINDOW o AS (ORDER BY slot)),
g AS (SELECT *, CASE WHEN p2 IS NOT NULL AND packets >= p1 THEN packets - p1 END AS gain,
             CASE WHEN p2 IS NOT NULL AND packets < p1 THEN p1 - packets END AS loss FROM s),
q AS (SELECT *, sum(gain) OVER o AS gs, count(gain) OVER o AS gn, sum(loss) OVER o AS ls, count(loss) OVER o AS ln FROM g WINDOW o AS (ORDER BY slot)),
k AS (SELECT *, CASE WHEN gn = 0 OR ln = 0 THEN 0 ELSE 100 - 100 / (1 +
        ((gs / gn) * (i - 1) + greatest(packets - p1, 0)) / ((ls // ln) * (i - 1) + greatest(p1 - packets, 0))) END AS rsi,
      CASE WHEN coalesce(p1, 0) = 0 THEN 0 ELSE 100.0 * (packets - p1) / p1 END AS momentum FROM q)"""


def _stock_sql(momentum: float, roc: float, rsi: float) -> str:
    return f"""WITH {_SERIES},
        c AS (SELECT *, momentum >= {momentum} AND p2 IS NOT NULL AS counted FROM k),
        r AS (SELECT *, CASE WHEN counted THEN packets / p1 ELSE 0 END AS roc, CASE WHEN counted THEN p1 / p2 ELSE 0 END AS roc_prev FROM c),
        e AS (SELECT *, counted AND roc >= {roc} AND roc_prev >= {roc} AS hit FROM r),
        isl AS (SELECT *, sum(CASE WHEN counted AND NOT hit THEN 1 ELSE 0 END) OVER (ORDER BY slot) AS island FROM e),
        run AS (SELECT *, CAST(sum(CAST(hit AS INT)) OVER (PARTITION BY island ORDER BY slot) AS BIGINT) AS roc_run FROM isl),
        f AS (SELECT *, sum(CASE WHEN hit AND roc_run % 3 = 0 AND rsi < {rsi} THEN 1 ELSE 0 END)
                OVER (PARTITION BY island ORDER BY slot) AS failures FROM run)
        SELECT {SLOT}, packets, {r6('momentum')} AS momentum, {r6('roc')} AS roc, {r6('roc_prev')} AS roc_prev,
               {r6('rsi')} AS rsi, roc_run, CAST(hit AND roc_run % 3 = 0 AND failures = 0 AS INT) AS alarm FROM f"""


@query("stock_market", _stock_sql(40, 800, 70))
def _(flows):
    return MO.stock_market(flows, DAY)


@query("stock_market_sensitive_alarms", _stock_sql(-100, 0.9, 50))
def _(flows):
    return MO.stock_market(flows, DAY, momentum_threshold=-100.0, roc_threshold=0.9, rsi_threshold=50.0)


# --- centroids ----------------------------------------------------------------------

_PROFILE = """prof AS (SELECT slot, prot, src_port, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
              count(*) AS flows FROM flows GROUP BY slot, prot, src_port)"""


@query("protocol_port_profile", f"WITH {_PROFILE} SELECT {SLOT}, prot, src_port, packets, bytes, flows FROM prof")
def _(flows):
    return CE.proto_port_profile(flows, DAY)


@query(
    "profile_entry_counts",
    f"""WITH {_PROFILE} SELECT {SLOT}, count(*) FILTER (prot = 6) AS tcp_ports, count(*) FILTER (prot = 17) AS udp_ports,
        count(*) FILTER (prot = 1) AS icmp_ports FROM prof GROUP BY slot""",
)
def _(flows):
    return CE.profile_counts(CE.proto_port_profile(flows, DAY))


_DISTANCE = {6: (0.1, 3.5, 0.7), 17: (0.2, 4.0, 0.5), 1: (0.6, 3.1, 0.12)}


def _centroid_sql(prot: int, limit: float) -> str:
    a, b, c = _DISTANCE[prot]
    return f"""WITH {_PROFILE},
        m AS (SELECT slot, avg(ln(packets)) FILTER (prot = {prot}) AS x, avg(ln(bytes)) FILTER (prot = {prot}) AS y,
                     avg(ln(flows)) FILTER (prot = {prot}) AS z FROM prof GROUP BY slot)
        SELECT {SLOT}, {r6('x')} AS ln_packets, {r6('y')} AS ln_bytes, {r6('z')} AS ln_flows,
               {r6(f'abs({a} - x) + abs({b} - y) + abs({c} - z)')} AS distance,
               CAST(coalesce(abs({a} - x) + abs({b} - y) + abs({c} - z) > {limit}, false) AS INT) AS alarm FROM m"""


for _name, _prot, _limit in (("tcp", 6, 2.0), ("udp", 17, 9.0), ("icmp", 1, 9.0)):
    query(f"centroid_distance_{_name}", _centroid_sql(_prot, _limit))(
        lambda flows, p=_prot, limit=_limit: CE.centroid_distance(
            CE.traffic_centroid(CE.proto_port_profile(flows, DAY), p), p, limit=limit
        )
    )


@query(
    "learned_normal_centroid",
    f"""WITH {_PROFILE},
        m AS (SELECT slot, avg(ln(packets)) AS x, avg(ln(bytes)) AS y, avg(ln(flows)) AS z FROM prof WHERE prot = 6 GROUP BY slot)
        SELECT {r6('avg(x)')} AS ln_packets, {r6('avg(y)')} AS ln_bytes, {r6('avg(z)')} AS ln_flows FROM m""",
)
def _(flows):
    return CE.learn_normal_centroid(CE.proto_port_profile(flows, DAY))


# --- late flows ---------------------------------------------------------------------


@query(
    "late_flows",
    f"""WITH a AS (SELECT slot, first_ts, (flow_id % 10) * 1000000000000 + flow_id AS arrival FROM flows),
        m AS (SELECT slot, max(epoch_us(first_ts) // 1000000) OVER (ORDER BY arrival) AS seen FROM a)
        SELECT {SLOT}, count(*) AS late_flows FROM m WHERE seen - 900 >= epoch_us(slot) // 1000000 + 86400 GROUP BY slot""",
)
def _(flows):
    # ten sources that deliver one after the other
    arrival = (F.col("flow_id") % 10) * F.lit(10**12) + F.col("flow_id")
    return late_flows(flows.withColumn("arrival", arrival), DAY, 900, "arrival")


@query(
    "late_flows_outlying_arrivals",
    f"""WITH a AS (SELECT slot, first_ts, CASE WHEN flow_id % 4001 = 0 THEN 4000000000000000000 + flow_id WHEN flow_id % 4001 = 1 THEN flow_id - 4000000000000000000
                        ELSE (flow_id % 10) * 1000000 + flow_id // 10 END AS arrival FROM flows),
        m AS (SELECT slot, max(epoch_us(first_ts) // 1000000) OVER (ORDER BY arrival) AS seen FROM a)
        SELECT {SLOT}, count(*) AS late_flows FROM m WHERE seen - 900 >= epoch_us(slot) // 1000000 + 86400 GROUP BY slot""",
)
def _(flows):
    # a few arrivals at both ends of the number range, the rest close together
    i = F.col("flow_id")
    close = (i % 10) * 1_000_000 + F.floor(i / 10)
    arrival = F.when(i % 4001 == 0, F.lit(4 * 10**18) + i).when(i % 4001 == 1, i - F.lit(4 * 10**18)).otherwise(close)
    return late_flows(flows.withColumn("arrival", arrival), DAY, 900, "arrival")


@query(
    "late_flows_sparse_arrivals",
    f"""WITH a AS (SELECT slot, first_ts, (flow_id % 10) * 1000000000000 + flow_id AS arrival FROM flows),
        m AS (SELECT slot, max(epoch_us(first_ts) // 1000000) OVER (ORDER BY arrival) AS seen FROM a)
        SELECT {SLOT}, count(*) AS late_flows FROM m WHERE seen - 900 >= epoch_us(slot) // 1000000 + 86400 GROUP BY slot""",
)
def _(flows):
    # the same order, with gaps of a million between two arrivals
    arrival = ((F.col("flow_id") % 10) * F.lit(10**12) + F.col("flow_id")) * F.lit(1_000_003)
    return late_flows(flows.withColumn("arrival", arrival), DAY, 900, "arrival")


# --- metric runs --------------------------------------------------------------------


@query(
    "metric_run_with_dependencies",
    f"""WITH {_COUNTS}, {_PRODUCT_CTE}
        SELECT {ts('u.slot')} AS slot, {r6('h * kl')} AS product, {r6('syn_flows / flows')} AS syn_rate,
               CAST(syn_flows / flows >= 0.36 AS INT) AS alarm_high
        FROM u JOIN h_src USING (slot) JOIN d_src USING (slot)""",
)
def _(flows):
    run = metric_run(flows, ["kl_entropy_product", {"name": "ddos_test", "high": 0.36}, "syn_flood"], DAY)
    return EN.on_slot(
        run["kl_entropy_product"].select("slot", "product"), run["ddos_test"].select("slot", "syn_rate", "alarm_high")
    )


@query(
    "custom_metric",
    f"""SELECT {SLOT}, {r6('sum(bytes) / count(*)')} AS bytes_per_flow FROM flows GROUP BY slot""",
)
def _(flows):
    if "bytes_per_flow" not in METRICS:

        @metric("bytes_per_flow", deps=["bytes", "flows"])
        def bytes_per_flow(ctx):
            both = EN.on_slot(ctx.result("bytes"), ctx.result("flows"))
            return both.select("slot", (F.col("bytes") / F.col("flows")).alias("bytes_per_flow"))

    return metric_run(flows, ["bytes_per_flow"], DAY)["bytes_per_flow"]
