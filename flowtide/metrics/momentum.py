"""Stock-market style indicators on the packet count per slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.rates import div_or_zero
from flowtide.metrics.frequency import packets_per_slot
from flowtide.plans.slots import previous_slot, running_slots

MOMENTUM_THRESHOLD = 40.0
ROC_THRESHOLD = 800.0
RSI_THRESHOLD = 70.0
MIN_VIOLATIONS = 3


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def packet_series(slots: DataFrame, width: str) -> DataFrame:
    """Packets of each slot next to those of the two slots before it; takes (slot, packets)."""
    return previous_slot(slots.select("slot", "packets"), {"packets": F.col("packets")}, width, k=2)


def momentum(series: DataFrame) -> DataFrame:
    """Percent change against the previous slot; 0 for the first slot or after an empty one."""
    change = F.try_divide(F.lit(100.0) * (F.col("packets") - F.col("packets_1")), F.col("packets_1"))
    return series.withColumn("momentum", _or_zero(change))


def rate_of_change(series: DataFrame, threshold: float = MOMENTUM_THRESHOLD) -> DataFrame:
    """packets / previous, now and one slot before; only where momentum reaches the threshold
    and three slots were seen, else 0 (also for a zero divisor)."""
    with_m = momentum(series)
    counted = (F.col("momentum") >= threshold) & F.col("packets_2").isNotNull()
    return with_m.withColumns(
        {
            "counted": counted,
            "roc": _or_zero(F.when(counted, F.try_divide("packets", "packets_1"))),
            "roc_prev": _or_zero(F.when(counted, F.try_divide("packets_1", "packets_2"))),
        }
    )


def rsi(series: DataFrame, width: str, also: dict[str, tuple] | None = None) -> DataFrame:
    """Relative strength index over all slots so far.

    From the third slot on a difference counts as gain (also 0) or loss. Mean gain and
    mean loss (integer division) are smoothed with the current change:
    (mean * (i - 1) + current) / i at slot i. 0 while there is no gain or no loss.
    `also` are further running values to compute in the same pass.
    """
    zero = F.lit(0).cast("bigint")
    diff = F.col("packets") - F.col("packets_1")
    seen = F.col("packets_2").isNotNull()
    gain, loss = seen & (diff >= 0), seen & (diff < 0)
    run = running_slots(
        series,
        {
            **(also or {}),
            "i": ("sum", F.lit(1).cast("bigint")),
            "gain_sum": ("sum", F.when(gain, diff).otherwise(zero)),
            "gain_n": ("sum", F.when(gain, 1).otherwise(0).cast("bigint")),
            "loss_sum": ("sum", F.when(loss, -diff).otherwise(zero)),
            "loss_n": ("sum", F.when(loss, 1).otherwise(0).cast("bigint")),
        },
        width,
    )
    i = F.col("i")
    mean_gain = F.try_divide("gain_sum", "gain_n")
    mean_loss = div_or_zero(F.col("loss_sum"), F.col("loss_n")).cast("double")
    now_gain = F.greatest(diff, zero)
    now_loss = F.greatest(-diff, zero)
    g = (mean_gain * (i - 1) + now_gain) / i
    l = (mean_loss * (i - 1) + now_loss) / i
    value = F.when((F.col("gain_n") > 0) & (F.col("loss_n") > 0), 100.0 - 100.0 / (1.0 + g / l))
    return run.withColumn("rsi", _or_zero(value)).drop("i", "gain_sum", "gain_n", "loss_sum", "loss_n")


def stock_market_of(
    slots: DataFrame,
    width: str,
    momentum_threshold: float = MOMENTUM_THRESHOLD,
    roc_threshold: float = ROC_THRESHOLD,
    rsi_threshold: float = RSI_THRESHOLD,
    violations: int = MIN_VIOLATIONS,
) -> DataFrame:
    """Momentum, rates of change, RSI, the rate-of-change run and the alarm, a row per slot.

    Takes the packets per slot.

    The run counts slots with both rates at or above their threshold, over the counted
    slots only (those with enough momentum); other slots neither extend nor end it. Each
    time it reaches `violations` the RSI is tested: at or above its threshold the alarm
    fires and the count starts again, below it the run stays silent until it ends.
    """
    series = rate_of_change(packet_series(slots, width), momentum_threshold)
    high = (F.col("roc") >= roc_threshold) & (F.col("roc_prev") >= roc_threshold)
    series = series.withColumns({"hit": F.col("counted") & high, "miss": F.col("counted") & ~high})
    run = {"roc_run": ("since", F.col("hit").cast("bigint"), F.col("miss"))}
    series = rsi(series, width, run)
    # a checkpoint that fails silences the rest of its run
    check = F.col("hit") & (F.col("roc_run") % violations == 0)
    failed = (check & (F.col("rsi") < rsi_threshold)).cast("bigint")
    series = running_slots(series, {"failures": ("since", failed, F.col("miss"))}, width)
    return series.select(
        "slot", "packets", "momentum", "roc", "roc_prev", "rsi", "roc_run",
        (check & (F.col("failures") == 0)).cast("int").alias("alarm"),
    )


def stock_market(flows: DataFrame, width: str, **kw) -> DataFrame:
    return stock_market_of(packets_per_slot(flows, width), width, **kw)
