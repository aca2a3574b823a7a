"""Traffic centroid per protocol and its distance from normal traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.plans.slots import with_slot
from flowtide.schema import ICMP, TCP, UDP

MAX_DISTANCE = 2.00

# Protocol -> normal (ln packets, ln bytes, ln flows).
NORMAL = {TCP: (0.1, 3.5, 0.7), UDP: (0.2, 4.0, 0.5), ICMP: (0.6, 3.1, 0.12)}

AXES = ("ln_packets", "ln_bytes", "ln_flows")


def proto_port_profile(flows: DataFrame, width: str) -> DataFrame:
    """Packets, bytes and flows per slot, protocol and source port."""
    return (
        with_slot(flows, width)
        .groupBy("slot", "prot", "src_port")
        .agg(
            F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"),
            F.count(F.lit(1)).alias("flows"),
        )
    )


def profile_counts(profile: DataFrame) -> DataFrame:
    """Number of profile entries per slot for TCP, UDP and ICMP."""
    return profile.groupBy("slot").agg(
        *[
            F.count(F.when(F.col("prot") == p, 1)).alias(f"{n}_ports")
            for n, p in (("tcp", TCP), ("udp", UDP), ("icmp", ICMP))
        ]
    )


def _safe_ln(c: str) -> Column:
    return F.when(F.col(c) > 0, F.ln(F.col(c)))


def traffic_centroid(profile: DataFrame, prot: int = TCP) -> DataFrame:
    """Mean of (ln packets, ln bytes, ln flows) over a protocol's source ports, per slot.

    Slots without that protocol have a NULL centroid.
    """
    on = F.col("prot") == prot
    return profile.groupBy("slot").agg(
        *[F.avg(F.when(on, _safe_ln(axis[3:]))).alias(axis) for axis in AXES]
    )


def centroid_distance(
    centroids: DataFrame, prot: int = TCP, normal: tuple | None = None, limit: float = MAX_DISTANCE
) -> DataFrame:
    """City-block distance from the normal centroid, and the alarm when it exceeds `limit`."""
    normal = NORMAL[prot] if normal is None else normal
    parts = [F.abs(F.lit(float(n)) - F.col(a)) for n, a in zip(normal, AXES)]
    return centroids.withColumn("distance", parts[0] + parts[1] + parts[2]).withColumn(
        "alarm", F.coalesce(F.col("distance") > limit, F.lit(False)).cast("int")
    )


def learn_normal_centroid(profile: DataFrame, prot: int = TCP) -> DataFrame:
    """One row: the mean centroid of slots known to be normal, to feed `centroid_distance`."""
    return traffic_centroid(profile, prot).agg(*[F.avg(a).alias(a) for a in AXES])
