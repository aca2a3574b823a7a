"""Timeslots: the tumbling window every metric is computed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.rates import epoch_s
from flowtide.plans import ordered


def slot_width(seconds: float) -> str:
    """Bucket width for a requested timeslot: 1 s below 10 s, 10 s below a minute, else 1 minute."""
    if not 0 < seconds < 3600:
        raise ValueError("the timeslot must lie between 0 and 3600 seconds")
    return "1 second" if seconds < 10 else "10 seconds" if seconds < 60 else "1 minute"


# Unit -> seconds.
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def width_seconds(width: str) -> int:
    """ "1 day", "10 seconds", ... as seconds."""
    n, unit = width.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def slot(width: str, ts: str = "first_ts") -> Column:
    """Start of the slot a flow belongs to; the same expression works on a stream."""
    return F.window(ts, width).getField("start")


def with_slot(flows: DataFrame, width: str) -> DataFrame:
    """Add `slot`; flows that already carry one are left as they are."""
    return flows if "slot" in flows.columns else flows.withColumn("slot", slot(width))


def slot_order(df: DataFrame) -> DataFrame:
    """Add `_at`, the slot start in epoch seconds, as the BIGINT order of the series."""
    return df.withColumn("_at", epoch_s("slot"))


def block_span(width: str) -> int:
    """Seconds covered by one block of slots (see plans.ordered)."""
    return width_seconds(width) * ordered.BLOCK


def previous_slot(df: DataFrame, values: dict[str, Column], width: str, k: int = 1) -> DataFrame:
    """Values of the last slots that exist before each one; empty slots do not count."""
    return ordered.previous(slot_order(df), "_at", values, k, block=block_span(width)).drop("_at")


def running_slots(df: DataFrame, values: dict[str, tuple], width: str) -> DataFrame:
    """Running values over all slots so far (see plans.ordered.running)."""
    return ordered.running(slot_order(df), "_at", values, block=block_span(width)).drop("_at")


def slot_streak(df: DataFrame, hit: Column, out: str, width: str) -> DataFrame:
    """Length of the run of hits over consecutive existing slots that ends at each slot."""
    return running_slots(df, {out: ("since", hit.cast("bigint"), ~hit)}, width)


def calendar(flows: DataFrame, width: str) -> DataFrame:
    """One row per slot that holds flows: slot, flows, prev_slot (NULL for the first).

    Reads only the timestamp column; the counts are shuffled once, whoever refers to them.
    """
    slots = with_slot(flows, width).groupBy("slot").agg(F.count(F.lit(1)).alias("flows"))
    return previous_slot(slots, {"prev_slot": F.col("slot")}, width)
