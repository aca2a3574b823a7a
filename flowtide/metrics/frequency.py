"""Per-slot counts and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.plans.slots import width_seconds, with_slot

# Frequency key -> columns.
FREQUENCY_KEYS = {
    "src": ["src_addr", "src_hi", "src_lo"],
    "dst": ["dst_addr", "dst_hi", "dst_lo"],
    "src_sport": ["src_addr", "src_hi", "src_lo", "src_port"],
    "dst_dport": ["dst_addr", "dst_hi", "dst_lo", "dst_port"],
    "pkts_bytes": ["packets", "bytes"],
    "src_sport_dst_dport": [
        "src_addr", "src_hi", "src_lo", "src_port", "dst_addr", "dst_hi", "dst_lo", "dst_port",
    ],
}


#: number of each key in the combined table
KEY_IDS = {k: i for i, k in enumerate(FREQUENCY_KEYS)}


def key_name(key_id: str = "key_id") -> Column:
    return F.get(F.array(*[F.lit(k) for k in KEY_IDS]), F.col(key_id))


def frequency(flows: DataFrame, key: str, width: str) -> DataFrame:
    """Flow count per slot and key: (slot, key columns, n)."""
    return (
        with_slot(flows, width)
        .groupBy("slot", *FREQUENCY_KEYS[key])
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequencies(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS)) -> DataFrame:
    """All frequency tables in one scan: (key_id, slot, key columns, n).

    Grouping sets expand a flow to one row per key before the map-side count, so the
    input is read once and shuffled once for all keys; columns outside a key are NULL.
    """
    cols = list(dict.fromkeys(c for k in keys for c in FREQUENCY_KEYS[k]))
    sets = [["slot", *FREQUENCY_KEYS[k]] for k in keys]
    # the grouping id has one bit per grouping column, set when the column is aggregated away
    ids = {
        KEY_IDS[k]: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in FREQUENCY_KEYS[k])
        for k in keys
    }
    to_id = F.create_map(*[F.lit(x) for k, i in ids.items() for x in (i, k)])
    return (
        with_slot(flows, width)
        .select("slot", *cols)
        .groupingSets([[F.col(c) for c in s] for s in sets], "slot", *cols)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("_gid"))
        .select(to_id[F.col("_gid")].alias("key_id"), "slot", *cols, "n")
    )


def unique_counts(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS)) -> DataFrame:
    """Distinct keys per slot, one column per key."""
    freq = frequencies(flows, width, keys)
    return freq.groupBy("slot").agg(
        *[F.count(F.when(F.col("key_id") == KEY_IDS[k], 1)).alias(f"unique_{k}") for k in keys]
    )


def unique_counts_approx(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS), rsd: float = 0.02) -> DataFrame:
    """The same with sketches: one pass, a fixed amount of state per slot."""
    return (
        with_slot(flows, width)
        .groupBy("slot")
        .agg(
            *[
                F.approx_count_distinct(F.struct(*FREQUENCY_KEYS[k]), rsd).alias(f"unique_{k}")
                for k in keys
            ]
        )
    )


def unique_sketches(flows: DataFrame, width: str, keys=tuple(FREQUENCY_KEYS), log2_buckets: int = 14) -> DataFrame:
    """One mergeable distinct-count sketch per slot and key, to be stored: `slot`, `sketch_<key>`.

    A sketch takes 2 ** log2_buckets bytes at most, whatever a slot holds; its relative error is
    about 1.04 / sqrt(2 ** log2_buckets), 0.8 percent by default.
    """
    def element(k: str):
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in FREQUENCY_KEYS[k]])

    return with_slot(flows, width).groupBy("slot").agg(*[F.hll_sketch_agg(element(k), log2_buckets).alias(f"sketch_{k}") for k in keys])


def united_counts(sketches: DataFrame, *by, keys=tuple(FREQUENCY_KEYS)) -> DataFrame:
    """Distinct keys over all slots of each group of `by` (columns, or expressions over `slot`), from sketches alone."""
    union = [F.round(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{k}"))).cast("bigint").alias(f"unique_{k}") for k in keys]
    return sketches.groupBy(*by).agg(*union)


def bytes_per_slot(flows: DataFrame, width: str) -> DataFrame:
    return with_slot(flows, width).groupBy("slot").agg(F.sum("bytes").alias("bytes"))


def flows_per_slot(flows: DataFrame, width: str) -> DataFrame:
    return with_slot(flows, width).groupBy("slot").agg(F.count(F.lit(1)).alias("flows"))


def packets_per_slot(flows: DataFrame, width: str, seconds: int | None = 60) -> DataFrame:
    """Packets and packets per second; `seconds` None divides by the slot width."""
    per = width_seconds(width) if seconds is None else seconds
    return (
        with_slot(flows, width)
        .groupBy("slot")
        .agg(F.sum("packets").alias("packets"))
        .withColumn("packets_per_s", F.col("packets") / F.lit(float(per)))
    )

