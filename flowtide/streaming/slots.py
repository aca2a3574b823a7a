"""Timeslots on streams: live counters, release, final flush, late flows, capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtide.functions.rates import epoch_s
from flowtide.operators import profiles
from flowtide.plans import ordered
from flowtide.plans.slots import slot, width_seconds
from flowtide.schema import FLOW_SCHEMA

#: flows per block when the arrival order is replayed (see plans.ordered)
ARRIVAL_BLOCK = 1 << 20


def read_flow_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Flow files as they land in a folder."""
    reader = spark.readStream.schema(FLOW_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_timeout(stream: DataFrame, timeout_s: int) -> DataFrame:
    """Slots are released `timeout_s` seconds of flow time after they end; later flows drop.

    Adds `event_ts`, the start as a zoned timestamp, which watermarks need.
    """
    return stream.withColumn("event_ts", F.col("first_ts").cast("timestamp")).withWatermark(
        "event_ts", f"{timeout_s} seconds"
    )


def window_start() -> Column:
    return F.col("window.start").cast("timestamp_ntz").alias("slot")


def slot_counters(flows: DataFrame, width: str, timeout_s: int | None = None) -> DataFrame:
    """Flows, packets and bytes per slot, on a stream (with its timeout) or a table."""
    live = timeout_s is not None
    src = with_timeout(flows, timeout_s) if live else flows
    return (
        src.groupBy(F.window("event_ts" if live else "first_ts", width))
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"),
        )
        .select(window_start(), "flows", "packets", "bytes")
    )


def to_files(result: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append a streaming result to parquet until the input that is there is used up."""
    writer = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def run_slot_counters(stream: DataFrame, landed: DataFrame, width: str, timeout_s: int, folder: str) -> DataFrame:
    """Live counters of every slot, released in order, with the final flush.

    The stream releases slots as its watermark passes them. When the input ends, the slots
    after the last released one are counted from the landed files, so each slot appears
    once, as at the end of a capture.
    """
    spark = stream.sparkSession
    query = to_files(
        slot_counters(stream, width, timeout_s), f"{folder}/slots", f"{folder}/checkpoint"
    )
    query.awaitTermination()
    schema = "slot timestamp_ntz, flows bigint, packets bigint, bytes bigint"
    released = spark.read.schema(schema).parquet(f"{folder}/slots")
    last = released.agg(F.max("slot").alias("last")).scalar()
    # flows of later slots only: the condition reaches the scan of what has landed
    after = last + F.expr(f"INTERVAL '{width_seconds(width)}' SECOND")
    rest = slot_counters(landed.filter(last.isNull() | (F.col("first_ts") >= after)), width)
    return released.unionByName(rest)


def late_flows(flows: DataFrame, width: str, timeout_s: int, arrival: str = "flow_id", seen_s: int | None = None) -> DataFrame:
    """Flows per slot that arrive after their slot was released, replaying the arrival order.

    A slot is released when some earlier flow started `timeout_s` seconds or more after the
    slot's end; `seen_s` is the latest start (epoch seconds) before these flows. The running
    maximum over the arrivals is computed in blocks, not in one task.
    """
    seen = flows.select(F.col(arrival).alias("_arrival"), slot(width).alias("slot"), epoch_s("first_ts").alias("_s"))
    seen = ordered.running(seen, "_arrival", {"_max_s": ("max", F.col("_s"))}, block=ordered.ByRank(ARRIVAL_BLOCK))
    # a flow later than its slot's release cannot itself be the running maximum
    latest = F.greatest(F.col("_max_s"), F.lit(seen_s).cast("bigint"))
    released = latest - F.lit(timeout_s) >= epoch_s("slot") + F.lit(width_seconds(width))
    return seen.filter(released).groupBy("slot").agg(F.count(F.lit(1)).alias("late_flows"))


def run_late_flows(stream: DataFrame, width: str, timeout_s: int, folder: str, arrival: str = "flow_id") -> StreamingQuery:
    """Live counts of late flows: `<folder>/late` (slot, late_flows), a part for each batch.

    A batch carries on from the latest start seen before it, kept as one row per batch in
    `<folder>/seen`; a repeated batch replaces its own parts.
    """

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = "latest bigint, batch bigint"
        before = spark.createDataFrame([], schema)
        if epoch:
            before = spark.read.schema(schema).parquet(f"{folder}/seen").filter(F.col("batch") < epoch)
        seen = before.agg(F.max("latest")).first()[0]

        def write(df: DataFrame, name: str) -> None:
            writer = df.withColumn("batch", F.lit(epoch).cast("bigint")).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/{name}")

        write(late_flows(batch, width, timeout_s, arrival, seen), "late")
        write(batch.agg(F.max(epoch_s("first_ts")).alias("latest")), "seen")

    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{folder}/late_checkpoint")
    return query.trigger(availableNow=True).start()

def capture(stream: DataFrame, width: str, path: str, checkpoint: str) -> StreamingQuery:
    """Store flows in one folder per time window."""
    named = stream.withColumn("capture", F.date_format(slot(width), "yyyyMMddHHmmss"))
    return to_files(named, path, checkpoint, ["capture"])


def channel_counters(stream: DataFrame, channels: dict[str, Column], width: str, timeout_s: int) -> DataFrame:
    """Flows, packets and bytes per channel and slot on a stream."""
    return (
        profiles.split(with_timeout(stream, timeout_s), channels)
        .groupBy("channel", F.window("event_ts", width))
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"),
        )
        .select("channel", window_start(), "flows", "packets", "bytes")
    )
