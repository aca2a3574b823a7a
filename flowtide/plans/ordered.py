"""Running values and predecessors over an ordered series, without one-task windows.

A window ordered over a whole table runs in a single task. These operators cut the order
into blocks instead: a window inside each block, then one row per block that carries what
the blocks before it add up to. With n rows and blocks of b rows, no task sees more than
about max(b, n / b) of them.

Blocks are spans of the order column, for series with about as many rows in each (timeslots),
or `ByRank`, cut where a given number of rows has passed, whatever the values are.

The order column is a BIGINT; together with `by` it must be unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.functions.rates import int_div

BLOCK = 4096
#: blocks by rank, at most; the driver holds their bounds
MOST_BLOCKS = 1 << 16


@dataclass(frozen=True)
class ByRank:
    """Blocks of about `rows` rows each, over all `by` together, however the order is spread.

    Bounds are approximate quantiles of all rows, fixed before the plan is made, so all parts of
    it see the same blocks. Of more than MOST_BLOCKS times `rows` rows a block has more.
    """

    rows: int

    def bounds(self, df: DataFrame, order: str) -> list[float]:
        blocks = min(-(-df.count() // self.rows), MOST_BLOCKS)
        if blocks < 2:
            return [0.0]
        shares = [k / blocks for k in range(1, blocks)]
        found = df.agg(F.percentile_approx(order, shares, max(10_000, 10 * blocks))).first()[0]
        # numbers beyond 53 bits are rounded, which keeps their order
        return sorted({float(v) for v in found})


def _in_blocks(df: DataFrame, order: str, block: int | ByRank) -> DataFrame:
    if isinstance(block, ByRank):
        splits = [float("-inf"), *block.bounds(df, order), float("inf")]
        cut = Bucketizer(splits=splits, inputCol="_at_order", outputCol="_cut")
        numbered = cut.transform(df.withColumn("_at_order", F.col(order).cast("double")))
        return numbered.withColumn("_blk", F.col("_cut").cast("bigint")).drop("_at_order", "_cut")
    start = F.col(order) - F.pmod(F.col(order), F.lit(block).cast("bigint"))
    return df.withColumn("_blk", int_div(start, F.lit(block).cast("bigint")))


def _with_carry(local: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """Left join of the carried columns on (by, block); `by` may hold NULL."""
    renamed = carry.select(
        *[F.col(c).alias(f"_c_{c}") for c in by],
        F.col("_blk").alias("_c_blk"),
        *[c for c in carry.columns if c not in (*by, "_blk")],
    )
    cond = F.col("_blk") == F.col("_c_blk")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return local.join(renamed, cond, "left").drop("_c_blk", *[f"_c_{c}" for c in by])


def running(
    df: DataFrame, order: str, values: dict[str, tuple], by: tuple[str, ...] = (), block: int | ByRank = BLOCK
) -> DataFrame:
    """Add running values along `order` within `by`, the current row included.

    `values` maps a new column to one of
      ("sum", expr)           sum so far
      ("max", expr)           maximum so far
      ("since", expr, reset)  sum of a non-negative value since the last row where `reset`
                              holds; that row itself contributes nothing
    """
    by = list(by)
    inputs = {f"_v_{n}": spec[1] for n, spec in values.items()}
    inputs.update({f"_r_{n}": F.coalesce(spec[2], F.lit(False)) for n, spec in values.items() if spec[0] == "since"})
    blocked = _in_blocks(df.withColumns(inputs), order, block)
    w = Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns(
        {f"_l_{n}": (F.max if spec[0] == "max" else F.sum)(f"_v_{n}").over(w) for n, spec in values.items()}
    )
    resets = [n for n, spec in values.items() if spec[0] == "since"]
    if resets:
        local = local.withColumns(
            {f"_m_{n}": F.max(F.when(F.col(f"_r_{n}"), F.col(f"_l_{n}"))).over(w) for n in resets}
        )

    totals = local.groupBy(*by, "_blk").agg(
        *[(F.max if spec[0] == "max" else F.sum)(f"_v_{n}").alias(f"_p_{n}") for n, spec in values.items()],
        *[F.max(f"_m_{n}").alias(f"_q_{n}") for n in resets],
    )
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns(
        {f"_p_{n}": (F.max if spec[0] == "max" else F.sum)(f"_p_{n}").over(before) for n, spec in values.items()}
    )
    carry = carry.withColumns(
        {
            f"_q_{n}": F.max(F.coalesce(f"_p_{n}", F.lit(0)) + F.col(f"_q_{n}")).over(before)
            for n in resets
        }
    )

    def value(n: str, op: str) -> Column:
        here, prior = F.col(f"_l_{n}"), F.col(f"_p_{n}")
        if op == "max":
            return F.greatest(prior, here)
        total = F.coalesce(prior, F.lit(0)) + here
        if op == "sum":
            return total
        last_reset = F.greatest(F.col(f"_q_{n}"), F.coalesce(prior, F.lit(0)) + F.col(f"_m_{n}"))
        return total - F.coalesce(last_reset, F.lit(0))

    return (
        _with_carry(local, carry, by)
        .withColumns({n: value(n, spec[0]) for n, spec in values.items()})
        .drop("_blk", *[f"_{k}_{n}" for n in values for k in "vrlmpq"])
    )


def previous(
    df: DataFrame,
    order: str,
    values: dict[str, Column],
    k: int = 1,
    by: tuple[str, ...] = (),
    block: int | ByRank = BLOCK,
) -> DataFrame:
    """Add the values of the preceding rows along `order` within `by`; NULL where there is none.

    With k = 1 the new columns are the names given; otherwise `<name>_1` is one row back,
    up to `<name>_k`.
    """
    by = list(by)
    blocked = _in_blocks(df, order, block).withColumn("_row", F.struct(*[e.alias(n) for n, e in values.items()]))
    w = Window.partitionBy(*by, "_blk").orderBy(order)
    local = blocked.withColumns(
        {
            "_nth": F.row_number().over(w),
            "_tail": F.lead(order, k).over(w).isNull(),
            **{f"_lag{i}": F.lag("_row", i).over(w) for i in range(1, k + 1)},
        }
    )
    # the last k rows of each block; every block holds a row, so k blocks back are enough
    tails = local.filter("_tail").groupBy(*by, "_blk").agg(
        F.collect_list(F.struct(F.col(order).alias("o"), F.col("_row").alias("row"))).alias("_rows")
    )
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(-k, -1)
    newest_first = F.sort_array(F.flatten(F.collect_list("_rows").over(before)), asc=False)
    carry = tails.withColumn("_rows", F.slice(newest_first, 1, k))

    def back(i: int) -> Column:
        at = F.lit(i) - F.col("_nth")
        carried = F.when(at >= 0, F.get("_rows", at)["row"])
        return F.when(F.col("_nth") > i, F.col(f"_lag{i}")).otherwise(carried)

    out = {
        (n if k == 1 else f"{n}_{i}"): back(i).getField(n) for n in values for i in range(1, k + 1)
    }
    return (
        _with_carry(local, carry, by)
        .withColumns(out)
        .drop("_blk", "_row", "_nth", "_tail", "_rows", *[f"_lag{i}" for i in range(1, k + 1)])
    )
