"""A `flows` table derived from an `events` table.

Used where no flow files exist: every field is computed from the event's own columns,
so the number of flows equals the number of events. The statement is plain SQL that
Spark and DuckDB both accept, so that results can be compared on the two engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from flowtide.schema import FLOW_SCHEMA

EVENTS_TO_FLOWS = """
SELECT event_id AS flow_id,
       'r' || CAST(user_id % 3 AS VARCHAR(4)) AS ident,
       ts AS first_ts, dur_ms,
       167772160 + user_id % 16 AS src_addr,
       167772160 + (event_id * 7 + k) % 16 AS dst_addr,
       CASE WHEN event_id % 2 = 0 THEN 1024 + k * 37 ELSE svc END AS src_port,
       CASE WHEN event_id % 2 = 0 THEN svc ELSE 1024 + k * 37 END AS dst_port,
       prot,
       CASE WHEN prot = 6 THEN k % 64 ELSE 0 END AS tcp_flags,
       user_id % 4 AS tos, k % 4 AS dst_tos,
       packets, packets * 40 + cents AS bytes,
       packets % 7 AS out_packets, (packets % 7) * 52 AS out_bytes,
       event_id % 3 AS aggr_flows,
       user_id % 3 AS input_if, k % 3 AS output_if,
       64512 + user_id % 5 AS src_as, 64512 + k % 5 AS dst_as,
       8 + k % 17 AS src_mask, 8 + user_id % 17 AS dst_mask,
       100 + user_id % 4 AS src_vlan, 100 + k % 4 AS dst_vlan,
       k % 2 AS dir, CASE WHEN k % 10 = 0 THEN 16 ELSE 1 END AS fwd_status,
       2886729728 + user_id % 3 AS next_hop,
       2886729984 + k % 3 AS bgp_next_hop,
       2130706433 + user_id % 2 AS router,
       2482300000000 + user_id AS in_src_mac,
       2482300000000 + k AS out_dst_mac,
       2482300001000 + k AS in_dst_mac,
       2482300001000 + user_id AS out_src_mac,
       (1000 + k) * 16 AS mpls_1,
       (2000 + k) * 16 + 2 * (k % 8) AS mpls_2,
       (3000 + k) * 16 + 1 AS mpls_3,
       user_id % 2 AS engine_type, k % 2 AS engine_id
FROM (
  SELECT *,
         CASE WHEN k < 70 THEN 6 WHEN k < 90 THEN 17 ELSE 1 END AS prot,
         1 + cents % 50 AS packets,
         cents % 60000 AS dur_ms,
         CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443
              WHEN 'purchase' THEN 993 WHEN 'signup' THEN 22 ELSE 53 END AS svc
  FROM (
    SELECT event_id, ts, user_id, event_type,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
           CAST(round(value * 100) AS BIGINT) AS cents
    FROM {events}))
"""


# what the statement above leaves out or names differently
_DERIVED = {
    "last_ts": "first_ts + make_dt_interval(0, 0, 0, dur_ms / 1000.0)",
    "mpls": "concat(array(mpls_1, mpls_2, mpls_3), array_repeat(0L, 7))",
    "is_v6": "false",
    "sampled": "false",
}


def _full_schema_sql() -> str:
    """The derived flows with every column of the flow schema, as one statement."""
    given = set(re.findall(r"AS (\w+)", EVENTS_TO_FLOWS)) | {"prot", "packets"}
    columns = [
        f"CAST({_DERIVED.get(f.name, f.name if f.name in given else 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in FLOW_SCHEMA.fields
    ]
    return f"SELECT {', '.join(columns)} FROM ({EVENTS_TO_FLOWS})"


def flows_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Flows with the full schema; works on a batch or a streaming `events` table."""
    return spark.sql(_full_schema_sql(), events=events)


def load_flows(spark: SparkSession, table_dir: str) -> DataFrame:
    return flows_from_events(spark, spark.read.parquet(f"{table_dir}/events.parquet"))
