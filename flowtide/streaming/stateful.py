"""Divergences on a stream: the counts of each slot next to those of the slot before it.

The stream only counts. Each micro-batch hands over the slots it has released; their tables are
stored per slot, and the divergences are computed from them and the one slot before. Everything
is written per slot with dynamic partition overwrite, so a replayed batch writes the same rows
again instead of doubling them. Metrics that run from slot to slot are in `streaming.series`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from flowtide.metrics.divergence import divergences_of
from flowtide.metrics.frequency import FREQUENCY_KEYS, KEY_IDS
from flowtide.plans.slots import previous_slot, width_seconds
from flowtide.streaming.slots import window_start, with_timeout

SLOT_ID = "slot_id"


def _slot_id():
    return F.date_format("slot", "yyyyMMddHHmmss")


def key_counts(flows: DataFrame, key: str, width: str, timeout_s: int | None = None) -> DataFrame:
    """Flow counts per slot and key, on a stream (with its timeout) or a table."""
    live = timeout_s is not None
    cols = FREQUENCY_KEYS[key]
    return (
        (with_timeout(flows, timeout_s) if live else flows)
        .groupBy(F.window("event_ts" if live else "first_ts", width), *cols)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(window_start(), *cols, "n")
    )


def _store(df: DataFrame, path: str) -> None:
    (
        df.withColumn(SLOT_ID, _slot_id())
        .hint("rebalance", F.col(SLOT_ID))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(SLOT_ID)
        .parquet(path)
    )


def _last_slot(spark: SparkSession, folder: str, before: str):
    """The newest stored slot older than `before`, from one row per slot, or None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/slots")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    stored = spark.read.schema(f"slot timestamp_ntz, {SLOT_ID} string").parquet(f"{folder}/slots")
    return stored.filter(F.col(SLOT_ID) < before).agg(F.max("slot")).first()[0]


def add_slots(released: DataFrame, key: str, width: str, folder: str) -> None:
    """Store the counts of released slots and compute their divergences from them and the slot before."""
    spark = released.sparkSession
    state = f"{folder}/frequencies"
    cols = FREQUENCY_KEYS[key]
    _store(released, state)
    ids = released.select(_slot_id().alias("id")).agg(F.min("id"), F.max("id")).first()
    low, high = ids[0], ids[1]
    last = _last_slot(spark, folder, low)
    since = last.strftime("%Y%m%d%H%M%S") if last else low
    # with a schema no file is opened to infer one
    schema = StructType([*released.schema.fields, StructField(SLOT_ID, StringType())])
    stored = spark.read.schema(schema).parquet(state)
    recent = stored.filter(F.col(SLOT_ID).between(since, high))
    fresh = recent.filter(F.col(SLOT_ID) >= low).select("slot").distinct()
    _store(fresh, f"{folder}/slots")
    # the calendar of these slots begins with the one before them
    known = spark.read.schema(f"slot timestamp_ntz, {SLOT_ID} string").parquet(f"{folder}/slots").filter(F.col(SLOT_ID).between(since, high)).select("slot")
    cal = previous_slot(known, {"prev_slot": F.col("slot")}, width).filter(_slot_id() >= low)
    freq = recent.select(F.lit(KEY_IDS[key]).alias("key_id"), "slot", *cols, "n")
    _store(divergences_of(freq, cal, (key,)), f"{folder}/divergences")


def run_divergences(stream: DataFrame, key: str, width: str, timeout_s: int, folder: str) -> StreamingQuery:
    """KL and Renyi divergence of one key, live.

    Results land in `<folder>/divergences`, the counts in `<folder>/frequencies`.
    """

    def on_batch(batch: DataFrame, _epoch: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                add_slots(batch, key, width, folder)
        finally:
            batch.unpersist()

    return (
        key_counts(stream, key, width, timeout_s)
        .writeStream.outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(on_batch)
        .start()
    )


def flush_divergences(landed: DataFrame, key: str, width: str, folder: str) -> None:
    """At the end of the input, add the slots after the last released one."""
    last = _last_slot(landed.sparkSession, folder, "99999999999999")
    if last is not None:
        landed = landed.filter(F.col("first_ts") >= F.lit(last).cast("timestamp_ntz") + F.expr(f"INTERVAL '{width_seconds(width)}' SECOND"))
    rest = key_counts(landed, key, width)
    if not rest.isEmpty():
        add_slots(rest, key, width, folder)
