"""Divergence of a slot's key distribution from the slot before it.

Only keys present in both slots count, and both sides are normalised over these common
keys. With C and P the sums of the two counts over the common keys,

    KL    = (sum of c ln(c/p)) / C - ln(C/P)
    Renyi = ln(P^(a-1) / C^a * sum of c^a / p^(a-1)) / (a-1)

so one aggregation per slot is enough and the distributions are never materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowtide.metrics.frequency import FREQUENCY_KEYS, KEY_IDS, frequencies, key_name
from flowtide.plans.slots import calendar, with_slot

KL_THRESHOLD = 1.80
RENYI_THRESHOLD = 2.70
RENYI_ALPHA = 5


def common_key_sums(freq: DataFrame, cal: DataFrame, alpha: float = RENYI_ALPHA) -> DataFrame:
    """Per (key_id, slot): the sums over keys that also occur in the previous slot.

    The count of the same key in the last slot it occurred in comes from a window over the
    key, which holds at most one row per slot. Rows whose last slot is not the one before are
    left out by the calendar, one row per slot, before anything is summed.
    """
    values = [c for c in freq.columns if c not in ("key_id", "slot", "n")]
    w = Window.partitionBy("key_id", *values).orderBy("slot")
    pairs = freq.select(
        "key_id",
        "slot",
        F.lag("slot").over(w).alias("seen"),
        F.col("n").cast("double").alias("c"),
        F.lag("n").over(w).cast("double").alias("p"),
    ).filter(F.col("seen").isNotNull())
    before = cal.select("slot", F.col("prev_slot").alias("seen"))
    return pairs.join(before, ["slot", "seen"]).groupBy("key_id", "slot").agg(
        F.count(F.lit(1)).alias("common_keys"),
        F.sum("c").alias("c_sum"),
        F.sum("p").alias("p_sum"),
        F.sum(F.col("c") * F.ln(F.col("c") / F.col("p"))).alias("c_log"),
        F.sum(F.pow("c", F.lit(float(alpha))) / F.pow("p", F.lit(alpha - 1.0))).alias("c_pow"),
    )


def divergences_of(
    freq: DataFrame,
    cal: DataFrame,
    keys=tuple(FREQUENCY_KEYS),
    alpha: float = RENYI_ALPHA,
    kl_threshold: float = KL_THRESHOLD,
    renyi_threshold: float = RENYI_THRESHOLD,
) -> DataFrame:
    """(key, slot, common_keys, kl, kl_alarm, renyi, renyi_alarm), a row per key and slot.

    0 for the first slot and where no key is common; alarms from the second slot on.
    """
    c, p = F.col("c_sum"), F.col("p_sum")
    kl = F.col("c_log") / c - F.ln(c / p)
    inner = F.col("c_pow") * F.pow(p, F.lit(alpha - 1.0)) / F.pow(c, F.lit(float(alpha)))
    renyi = F.when(inner > 0, F.ln(inner) / F.lit(alpha - 1.0))
    sums = common_key_sums(freq, cal, alpha).select("key_id", "slot", "common_keys", kl.alias("kl"), renyi.alias("renyi"))
    # a slot holds flows, so every key has a row for it
    grid = cal.select("slot", F.col("prev_slot").isNotNull().alias("has_prev"), F.explode(F.array(*[F.lit(KEY_IDS[k]) for k in keys])).alias("key_id"))
    zero = F.lit(0.0)
    return (
        grid.join(sums, ["key_id", "slot"], "left")
        .select(
            key_name().alias("key"),
            "slot",
            F.coalesce("common_keys", F.lit(0).cast("bigint")).alias("common_keys"),
            F.coalesce("kl", zero).alias("kl"),
            F.coalesce("renyi", zero).alias("renyi"),
            "has_prev",
        )
        .withColumns(
            {
                "kl_alarm": ((F.col("kl") >= kl_threshold) & (F.col("has_prev"))).cast("int"),
                "renyi_alarm": ((F.col("renyi") >= renyi_threshold) & (F.col("has_prev"))).cast("int"),
            }
        )
        .drop("has_prev")
    )


def divergences(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS), cal: DataFrame | None = None, **kw) -> DataFrame:
    flows = with_slot(flows, width)
    cal = calendar(flows, width) if cal is None else cal
    return divergences_of(frequencies(flows, width, keys), cal, keys, **kw)


def wide(div: DataFrame, metric: str, keys=tuple(FREQUENCY_KEYS)) -> DataFrame:
    """One row per slot: `<metric>_<key>` and `alarm_<key>` columns; metric is "kl" or "renyi"."""

    def pick(k: str, c: str):
        return F.max(F.when(F.col("key") == k, F.col(c)))

    return div.groupBy("slot").agg(
        *[pick(k, metric).alias(f"{metric}_{k}") for k in keys],
        *[pick(k, f"{metric}_alarm").alias(f"alarm_{k}") for k in keys],
    )


def kl_divergence(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS), **kw) -> DataFrame:
    return wide(divergences(flows, width, keys, **kw), "kl", keys)


def renyi_divergence(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS), **kw) -> DataFrame:
    return wide(divergences(flows, width, keys, **kw), "renyi", keys)


def kl_entropy_product(entropy: DataFrame, kl: DataFrame) -> DataFrame:
    """Entropy times KL divergence of the source addresses, joined on the slot.

    Takes the results of the two metrics it depends on.
    """
    return entropy.select("slot", "entropy_src").join(kl.select("slot", "kl_src"), "slot").select(
        "slot", "entropy_src", "kl_src", (F.col("entropy_src") * F.col("kl_src")).alias("product")
    )
