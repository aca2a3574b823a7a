"""Exact medians of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def exact_median(df: DataFrame, by: list[str], value: str, out: str = "median", accuracy: int = 1_000) -> DataFrame:
    """The median of `value` per group; NULL values do not count.

    A sketch first brackets the middle ranks of each group; its rank error is at most
    n / accuracy. Rows below the bracket are only counted and rows above it dropped, so
    the final ordering within a group sees about 4 n / accuracy rows. The result is exact.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    margin = 2.0 / accuracy
    bracket = F.percentile_approx("_x", [0.5 - margin, 0.5 + margin], accuracy)
    bounds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), bracket.alias("_b"))
    low, high = F.get("_b", F.lit(0)), F.get("_b", F.lit(1))
    near = (
        rows.join(bounds, by)
        .filter(F.col("_x") <= high)
        .groupBy(*by, "_n", F.when(F.col("_x") >= low, F.col("_x")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    w = Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_first())
    upto = F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = near.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_k"))

    def at(rank):
        return F.max(F.when((F.col("_from") < rank) & (rank <= F.col("_upto")), F.col("_x")))

    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    # a bracket that missed a middle rank must not pass for a group without values
    missed = F.raise_error(F.lit("the bracket of a median missed its rank; raise `accuracy`")).cast("double")
    return ranked.groupBy(*by).agg(F.coalesce((at(lower) + at(upper)) / 2, missed).alias(out))
