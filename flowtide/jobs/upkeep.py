"""Sequence checks of exporters and retention plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from flowtide.functions.rates import epoch_s
from flowtide.plans import ordered

#: headers per block when an exporter's arrivals are replayed (see plans.ordered)
HEADER_BLOCK = 1 << 20


def sequence_steps(headers: DataFrame, exporter: str = "ident", arrival: str = "arrival") -> DataFrame:
    """Each header next to its exporter's previous one: distance, expected step, failure.

    `headers` has (exporter, arrival, flow_sequence, flow_count). The sequence is a 32-bit
    counter, so a step is taken modulo 2^32. Arrivals are cut into blocks by rank: an exporter
    may have any share of the headers, and arrivals may be as sparse as they like.
    """
    steps = ordered.previous(
        headers,
        arrival,
        {"prev_sequence": F.col("flow_sequence"), "prev_count": F.col("flow_count")},
        by=(exporter,),
        block=ordered.ByRank(HEADER_BLOCK),
    )
    distance = F.pmod(F.col("flow_sequence") - F.col("prev_sequence"), F.lit(1 << 32))
    failed = F.coalesce(distance != F.col("prev_count"), F.lit(False))
    return steps.withColumns({"distance": distance, "failure": failed})


def sequence_gaps(headers: DataFrame, exporter: str = "ident", arrival: str = "arrival") -> DataFrame:
    """Headers and sequence failures per exporter."""
    return (
        sequence_steps(headers, exporter, arrival)
        .groupBy(exporter)
        .agg(
            F.count(F.lit(1)).alias("headers"),
            F.sum(F.col("failure").cast("bigint")).alias("failures"),
        )
    )


def retention_plan(
    partitions: DataFrame,
    now: datetime,
    max_life_s: int = 0,
    max_size: int = 0,
    low_water: int = 95,
    at: str = "day",
    size: str = "size",
) -> DataFrame:
    """The partitions to drop, with the reason ("size", "age"); nothing is deleted.

    Size: when the total reaches `max_size`, drop the oldest until it is at or below the
    low-water share of it (95 percent if given as 0). Age: when the oldest partition reaches `max_life_s`, drop what
    is older than the low-water share of that life. 0 switches a limit off.

    `partitions` is one row per partition, with its time `at` and its `size`.
    """
    low_water = low_water or 95
    span = partitions.agg(
        F.struct(F.min(at).cast("timestamp_ntz").alias("first"), F.sum(size).alias("total")).alias("s")
    ).scalar()
    rows = partitions.select(
        F.col(at).cast("timestamp_ntz").alias("at"), F.col(size).cast("bigint").alias("size")
    )
    # newest first: what is kept up to and including this partition
    rows = rows.withColumn("_back", -epoch_s("at"))
    rows = ordered.running(rows, "_back", {"kept": ("sum", F.col("size"))}, block=86400 * 4096)
    now_s = epoch_s(F.lit(now).cast("timestamp_ntz"))
    by_size = (
        (span.getField("total") >= max_size) & (F.col("kept") > (low_water * max_size) // 100)
        if max_size
        else F.lit(False)
    )
    by_age = (
        (now_s - epoch_s(span.getField("first")) >= max_life_s)
        & (epoch_s("at") < now_s - (max_life_s * low_water) // 100)
        if max_life_s
        else F.lit(False)
    )
    reason = F.when(by_size, "size").when(by_age, "age")
    return rows.select("at", "size", reason.alias("reason")).filter(F.col("reason").isNotNull())
