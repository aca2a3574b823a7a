"""Shannon entropy per slot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.metrics.frequency import FREQUENCY_KEYS, KEY_IDS, frequencies, frequency

ENTROPY_THRESHOLD = 0.30


def entropy_of_n() -> Column:
    # sum(p log2 1/p) with p = n / N, written so that N need not be known beforehand
    n = F.col("n").cast("double")
    h = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
    return F.greatest(h, F.lit(0.0))


def entropy(flows: DataFrame, key: str, width: str, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """(slot, entropy, alarm) of one frequency key; the alarm is entropy <= threshold."""
    return (
        frequency(flows, key, width)
        .groupBy("slot")
        .agg(entropy_of_n().alias("entropy"))
        .withColumn("alarm", (F.col("entropy") <= threshold).cast("int"))
    )


def entropies_of(freq: DataFrame, keys=tuple(FREQUENCY_KEYS), threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """Entropy and alarm of every key from one frequency table, one row per slot."""
    per_key = freq.groupBy("slot", "key_id").agg(entropy_of_n().alias("h"))
    wide = per_key.groupBy("slot").agg(
        *[F.max(F.when(F.col("key_id") == KEY_IDS[k], F.col("h"))).alias(f"entropy_{k}") for k in keys]
    )
    return wide.withColumns({f"alarm_{k}": (F.col(f"entropy_{k}") <= threshold).cast("int") for k in keys})


def entropies(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS), threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    return entropies_of(frequencies(flows, width, keys), keys, threshold)


def on_slot(*tables: DataFrame) -> DataFrame:
    """Put metric tables side by side on `slot`."""
    return reduce(lambda a, b: a.join(b, "slot"), tables)
