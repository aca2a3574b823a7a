"""Readers, writers and streams: what was written and read back must equal the flows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.catalog.aggregates import _BIDIR, _BIDIR_COLUMNS, _CHANNEL_ROWS, _group, channels
from flowtide.catalog.base import DAY, query, r6, table_query, ts
from flowtide.catalog.scalars import _NAMES, _letters, _mac, _v4
from flowtide.catalog.timeslots import SLOT, _divergence_cte, _entropy_cte, _CAL, _flood_sql, _stock_sql
from flowtide.metrics import entropy as EN
from flowtide.operators import aggregate as AG, profiles
from flowtide.session import shared_folder
from flowtide.sources import files
from flowtide.sources.derived import flows_from_events, load_flows
from flowtide.streaming import series, slots as SS, stateful

_KEPT = ["flow_id", "ident", "first_ts", "last_ts", "src_addr", "dst_addr", "src_port", "dst_port", "prot", "packets", "bytes"]
_KEPT_SQL = (
    f"flow_id, ident, {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts, src_addr, dst_addr, "
    "src_port, dst_port, prot, packets, bytes"
)


@query("stored_flows_round_trip", f"SELECT {_KEPT_SQL} FROM flows")
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "flows")
    files.write_flows(flows, path)
    return files.read_flows(spark, path).select(*_KEPT)


@query("sources_as_one_table", f"SELECT {_KEPT_SQL} FROM flows")
def _(flows):
    spark = flows.sparkSession
    root = shared_folder(spark, "sources")
    names = ["r0", "r1", "r2"]
    for n in names:
        files.write_flows(flows.filter(F.col("ident") == n), f"{root}/{n}/flows")
    return files.read_sources(spark, root, names, "flows").select(*_KEPT)


@query(
    "stored_slot_range",
    f"SELECT {_KEPT_SQL} FROM flows WHERE strftime(first_ts, '%Y%m%d') BETWEEN '20240105' AND '20240111'",
)
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "slots")
    by_day = flows.withColumn(files.SLOT_NAME, F.date_format("first_ts", "yyyyMMdd"))
    files.write_flows(by_day, path, [files.SLOT_NAME])
    return files.read_range(spark, path, "20240105", "20240111").select(*_KEPT)


@query(
    "stored_time_window",
    f"""SELECT {_KEPT_SQL} FROM flows
        WHERE first_ts >= TIMESTAMP '2024-01-05 06:00:00' AND last_ts <= TIMESTAMP '2024-01-06 18:00:00'""",
)
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "days")
    files.write_flows(flows, path)
    return files.read_window(spark, path, datetime(2024, 1, 5, 6), datetime(2024, 1, 6, 18)).select(*_KEPT)


@query(
    "stored_window_across_midnight",
    f"""SELECT {_KEPT_SQL} FROM flows
        WHERE first_ts >= TIMESTAMP '2024-01-05 22:30:00' AND last_ts <= TIMESTAMP '2024-01-06 01:10:00'""",
)
def _(flows):
    # folders by the day a flow ended, files of a thousand flows or fewer
    spark = flows.sparkSession
    path = shared_folder(spark, "ranges")
    by_end = flows.withColumn("ended", F.to_date("last_ts")).repartitionByRange(40, "first_ts")
    by_end.write.partitionBy("ended").parquet(path)
    files.write_manifest(spark, path)
    return files.read_window_files(spark, path, datetime(2024, 1, 5, 22, 30), datetime(2024, 1, 6, 1, 10)).select(*_KEPT)


@query(
    "files_in_window",
    """WITH d AS (SELECT slot, min(first_ts) AS first, max(last_ts) AS last, count(*) AS n FROM flows GROUP BY slot)
       SELECT CAST(sum(n) AS BIGINT) AS flows, count(*) AS files, count(*) < (SELECT count(*) FROM d) AS fewer
       FROM d WHERE first <= TIMESTAMP '2024-01-06 01:10:00' AND last >= TIMESTAMP '2024-01-05 22:30:00'""",
)
def _(flows):
    """Of a file for each day of starts, those that meet the window, and their flows."""
    spark = flows.sparkSession
    path = shared_folder(spark, "ranges")
    flows.withColumn("day", F.to_date("first_ts")).repartition("day").write.partitionBy("day").parquet(path)
    files.write_manifest(spark, path)
    met = files.files_in_window(spark, path, datetime(2024, 1, 5, 22, 30), datetime(2024, 1, 6, 1, 10))
    every = spark.read.parquet(f"{path}/{files.MANIFEST}")
    return met.agg(F.sum("flows").alias("flows"), F.count("file").alias("files"), (F.count("file") < every.count()).alias("fewer"))


@query(
    "csv_round_trip",
    """SELECT strftime(date_trunc('second', first_ts), '%Y-%m-%d %H:%M:%S.%g') AS first_ts,
              strftime(date_trunc('second', first_ts) + to_milliseconds(dur_ms), '%Y-%m-%d %H:%M:%S.%g') AS last_ts,
              src_addr, dst_addr, src_port, dst_port, prot, tcp_flags, packets, bytes, out_packets, out_bytes, input_if,
              output_if, src_as, dst_as, src_mask, dst_mask, tos, dst_tos, dir, fwd_status, next_hop, bgp_next_hop, router,
              src_vlan, dst_vlan, in_src_mac, out_dst_mac, in_dst_mac, out_src_mac, mpls_1, mpls_2, mpls_3,
              engine_type, engine_id
       FROM flows""",
)
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "csv")
    files.write_flows_csv(flows, path)
    back = files.read_flows_csv(spark, path)
    mpls = {f"mpls_{i}": F.get("mpls", F.lit(i - 1)) for i in (1, 2, 3)}
    empty = {"flow_id", "ident", "is_v6", "aggr_flows", "sampled", "mpls"}
    kept = [c for c in back.columns if c not in empty and not c.endswith(("_hi", "_lo"))]
    return back.withColumns(mpls).select(*kept, *mpls)


_LABEL = "({m} // 16) || '-' || (({m} // 2) % 8) || '-' || ({m} % 2)"


@query(
    "flows_csv_form",
    f"""SELECT strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS te,
        printf('%.3f', dur_ms / 1000.0) AS td, {_v4('src_addr')} AS sa, {_v4('dst_addr')} AS da,
        {', '.join(f'CAST({c} AS VARCHAR) AS "{n}"' for n, c in files._CSV_NUMBERS.items())},
        {_NAMES} AS pr, {_letters('tcp_flags')} AS flg, {_v4('next_hop')} AS nh, {_v4('bgp_next_hop')} AS nhb,
        {', '.join(f'{_mac(c)} AS {n}' for n, c in files._CSV_MACS.items())},
        {', '.join(f"{_LABEL.format(m=f'mpls_{i}')} AS mpls{i}" for i in (1, 2, 3))},
        {', '.join(f"'0-0-0' AS mpls{i}" for i in range(4, 11))},
        {_v4('router')} AS ra, engine_type || '/' || engine_id AS eng FROM flows""",
)
def _(flows):
    return files.flows_csv(flows)


@query(
    "flows_pipe_form",
    """SELECT concat_ws('|', 2, epoch_us(first_ts) // 1000000, (epoch_us(first_ts) // 1000) % 1000, epoch_us(last_ts) // 1000000,
              (epoch_us(last_ts) // 1000) % 1000, prot, 0, 0, 0, src_addr, src_port, 0, 0, 0, dst_addr, dst_port, src_as, dst_as,
              input_if, output_if, tcp_flags, tos, packets, bytes) AS value FROM flows""",
)
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "pipe")
    files.write_flows_pipe(flows, path)
    return spark.read.text(path)


@query(
    "metric_result_csv",
    f"""WITH {_entropy_cte('src', 'src_addr')} SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot,
        printf('%.6f', h) AS entropy, CAST(CAST(h <= 0.30 AS INT) AS VARCHAR) AS alarm FROM h_src""",
)
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "metric")
    files.write_metric_csv(EN.entropy(flows, "src", DAY), path)
    return spark.read.option("header", True).csv(path)


@query("exported_aggregation", _group("src_addr, dst_as, prot"))
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "export")
    merged = AG.aggregate_flows(flows, ["srcip", "dstas", "proto"])
    files.export_aggregated(merged, path, by_date=True)
    return spark.read.parquet(path).drop("src_hi", "src_lo")


@query("exported_bidirectional_aggregation", f"{_BIDIR} SELECT {', '.join(_BIDIR_COLUMNS)} FROM merged")
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "export-bidir")
    files.export_aggregated(AG.aggregate_bidir(flows), path)
    return spark.read.parquet(path).select(*_BIDIR_COLUMNS)


@query(
    "folder_layouts",
    """SELECT flow_id, strftime(first_ts, '%Y/%m/%d') AS l1, strftime(first_ts, '%Y/%m/%d/%H') AS l2,
              strftime(first_ts, '%Y/%W/') || isodow(first_ts) AS l3,
              strftime(first_ts, '%Y/%W/') || isodow(first_ts) || strftime(first_ts, '/%H') AS l4,
              strftime(first_ts, '%Y/%j') AS l5, strftime(first_ts, '%Y/%j/%H') AS l6,
              strftime(first_ts, '%Y-%m-%d') AS l7, strftime(first_ts, '%Y-%m-%d/%H') AS l8
       FROM flows""",
)
def _(flows):
    return flows.select(
        "flow_id", *[F.concat_ws("/", *files.layout_columns(i).values()).alias(f"l{i}") for i in files.LAYOUTS]
    )


@query(
    "stored_in_folder_layout",
    "SELECT strftime(first_ts, '%Y') AS part_Y, strftime(first_ts, '%j') AS part_j, count(*) AS flows FROM flows GROUP BY ALL",
)
def _(flows):
    spark = flows.sparkSession
    path = shared_folder(spark, "layout")
    files.write_hierarchy(flows, path, "%Y/%j")
    stored = spark.read.parquet(path)
    return stored.groupBy(
        F.col("part_Y").cast("string").alias("part_Y"), F.lpad(F.col("part_j").cast("string"), 3, "0").alias("part_j")
    ).agg(F.count(F.lit(1)).alias("flows"))


# --- streams ------------------------------------------------------------------------


def stream_flows(spark: SparkSession, table_dir: str) -> DataFrame:
    """The events table read as a stream of files, as flows."""
    schema = spark.read.parquet(f"{table_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(table_dir)
    return flows_from_events(spark, events)


@table_query(
    "stream_slot_counters",
    f"""SELECT {SLOT}, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes
        FROM flows GROUP BY slot""",
    flows_sql=True,
)
def _(spark, table_dir):
    folder = shared_folder(spark, "stream-slots")
    return SS.run_slot_counters(stream_flows(spark, table_dir), load_flows(spark, table_dir), DAY, 900, folder)


@table_query(
    "stream_late_flows",
    f"""WITH m AS (SELECT slot, max(epoch_us(first_ts) // 1000000) OVER (ORDER BY (flow_id % 10) * 1000000000000 + flow_id) AS seen FROM flows)
        SELECT {SLOT}, count(*) AS late_flows FROM m WHERE seen - 900 >= epoch_us(slot) // 1000000 + 86400 GROUP BY slot""",
    flows_sql=True,
)
def _(spark, table_dir):
    folder = shared_folder(spark, "stream-late")
    arrival = (F.col("flow_id") % 10) * F.lit(10**12) + F.col("flow_id")
    SS.run_late_flows(stream_flows(spark, table_dir).withColumn("arrival", arrival), DAY, 900, folder, "arrival").awaitTermination()
    late = spark.read.schema("slot timestamp_ntz, late_flows bigint").parquet(f"{folder}/late")
    return late.groupBy("slot").agg(F.sum("late_flows").alias("late_flows"))


@table_query(
    "stream_divergence",
    f"""WITH {_CAL}, {_divergence_cte('src', 'src_addr')} SELECT {SLOT}, k AS common_keys, {r6('kl')} AS kl,
        {r6('renyi')} AS renyi FROM d_src""",
    flows_sql=True,
)
def _(spark, table_dir):
    folder = shared_folder(spark, "stream-divergence")
    stateful.run_divergences(stream_flows(spark, table_dir), "src", DAY, 900, folder).awaitTermination()
    stateful.flush_divergences(load_flows(spark, table_dir), "src", DAY, folder)
    return spark.read.parquet(f"{folder}/divergences").select("slot", "common_keys", "kl", "renyi")


for _name, _sql, _kw in (
    ("stream_stock_market", _stock_sql(40, 800, 70), {}),
    ("stream_stock_market_sensitive_alarms", _stock_sql(-100, 0.9, 50), dict(momentum_threshold=-100.0, roc_threshold=0.9, rsi_threshold=50.0)),
):

    @table_query(_name, _sql, flows_sql=True)
    def _(spark, table_dir, kw=_kw):
        folder = shared_folder(spark, "stream-stock")
        return series.run_stock_market(stream_flows(spark, table_dir), load_flows(spark, table_dir), DAY, 900, folder, **kw)


for _name, _threshold in (("stream_syn_flood", 0.3), ("stream_syn_flood_alarm_streaks", 1.9)):

    @table_query(_name, _flood_sql(_threshold), flows_sql=True)
    def _(spark, table_dir, threshold=_threshold):
        folder = shared_folder(spark, "stream-flood")
        return series.run_syn_flood(stream_flows(spark, table_dir), load_flows(spark, table_dir), DAY, 900, folder, threshold=threshold)


@table_query(
    "stream_capture",
    "SELECT strftime(slot, '%Y%m%d%H%M%S') AS capture, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows GROUP BY slot",
    flows_sql=True,
)
def _(spark, table_dir):
    folder = shared_folder(spark, "stream-capture")
    SS.capture(stream_flows(spark, table_dir), DAY, f"{folder}/flows", f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{folder}/flows")
    return stored.groupBy(F.col("capture").cast("string").alias("capture")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes")
    )


@table_query(
    "stream_channel_split",
    f"WITH {_CHANNEL_ROWS} SELECT channel, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets FROM chan GROUP BY channel",
    flows_sql=True,
)
def _(spark, table_dir):
    folder = shared_folder(spark, "stream-channels")
    rows = profiles.split(stream_flows(spark, table_dir), channels()).select("channel", "flow_id", "packets")
    SS.to_files(rows, f"{folder}/flows", f"{folder}/checkpoint", ["channel"]).awaitTermination()
    stored = spark.read.parquet(f"{folder}/flows")
    return stored.groupBy("channel").agg(F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"))
