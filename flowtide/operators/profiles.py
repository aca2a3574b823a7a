"""Channels: named filters every flow is tested against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.operators import predicates as P
from flowtide.operators.statistics import MAX_BPP, bpp_histogram, class_counters, port_histogram
from flowtide.plans.slots import with_slot


def channel(condition: Column, sources: list[str] | None = None) -> Column:
    """A channel filter: the condition, for flows of the named sources only."""
    if not sources:
        return condition
    return reduce(lambda a, b: a | b, [P.ident(s) for s in sources]) & condition


def split(flows: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """One row per flow and matching channel, in one pass; works on streams too."""
    hits = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in channels.items()]))
    return flows.withColumn("channel", F.explode(hits))


def channel_summary(flows: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """Counts by protocol class and first and last seen, per channel."""
    return (
        split(flows, channels)
        .groupBy("channel")
        .agg(*class_counters(), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen"))
    )


def channel_port_histogram(flows: DataFrame, channels: dict[str, Column]) -> DataFrame:
    return port_histogram(split(flows, channels), by=("channel",))


def channel_bpp_histogram(flows: DataFrame, channels: dict[str, Column]) -> DataFrame:
    return bpp_histogram(split(flows, channels), MAX_BPP, by=("channel",))


def channel_timeseries(flows: DataFrame, channels: dict[str, Column], width: str) -> DataFrame:
    """Flows, packets and bytes by protocol class per channel and slot."""
    return split(with_slot(flows, width), channels).groupBy("channel", "slot").agg(*class_counters())


def write_channels(flows: DataFrame, channels: dict[str, Column], path: str, mode: str = "overwrite") -> None:
    """The flows of each channel in its own folder; a large channel is spread over many tasks."""
    split(flows, channels).hint("rebalance", F.col("channel")).write.mode(mode).partitionBy("channel").parquet(path)
