"""Flooding danger levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtide.metrics.entropy import entropy_of_n
from flowtide.plans.slots import with_slot

LIMIT_PACKETS = 2_000_000
LIMIT_DST_ENTROPY = 8.85
LIMIT_SRC_PORT_ENTROPY = 8.45
LIMIT_PACKETS_PER_S = 38_000.0
TIMESLOT = 60


def flooding_level(
    flows: DataFrame,
    width: str,
    packets: int = LIMIT_PACKETS,
    dst_entropy: float = LIMIT_DST_ENTROPY,
    src_port_entropy: float = LIMIT_SRC_PORT_ENTROPY,
    packets_per_s: float = LIMIT_PACKETS_PER_S,
    seconds: int = TIMESLOT,
) -> DataFrame:
    """Levels 0-4 per slot; each level needs the ones below it.

    Both entropies and the packet sum come from one scan: the two keys are grouping sets,
    and the packets are summed along the destination one.
    """
    keys = ["dst_addr", "dst_hi", "dst_lo"]
    freq = (
        with_slot(flows, width)
        .select("slot", *keys, "src_port", "packets")
        .groupingSets(
            [[F.col(c) for c in ("slot", *keys)], [F.col("slot"), F.col("src_port")]],
            "slot", *keys, "src_port",
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("packets").alias("packets"),
            F.grouping("src_port").alias("by_dst"),
        )
    )
    per_key = freq.groupBy("slot", "by_dst").agg(entropy_of_n().alias("h"), F.sum("packets").alias("packets"))
    slots = per_key.groupBy("slot").agg(
        F.max(F.when(F.col("by_dst") == 1, F.col("h"))).alias("entropy_dst"),
        F.max(F.when(F.col("by_dst") == 0, F.col("h"))).alias("entropy_src_port"),
        F.max(F.when(F.col("by_dst") == 1, F.col("packets"))).alias("packets"),
    )
    slots = slots.withColumn("packets_per_s", F.col("packets") / F.lit(float(seconds)))
    level = (
        F.when(F.col("packets") < packets, 0)
        .when(F.col("entropy_dst") > dst_entropy, 1)
        .when(F.col("entropy_src_port") > src_port_entropy, 2)
        .when(F.col("packets_per_s") < packets_per_s, 3)
        .otherwise(4)
    )
    return slots.withColumn("level", level)
