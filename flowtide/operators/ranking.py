"""Date sort, top-N and limits. Every order has a tie-break, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.functions import rates as R

ORDERS = ("flows", "packets", "bytes", "pps", "bps", "bpp")


def order_value(order: str, flows_column: str = "flows") -> Column:
    """The value one of the six orders ranks by, on an aggregated table."""
    if order not in ORDERS:
        raise ValueError(f"unknown order: {order}")
    value = {
        "flows": lambda: F.col(flows_column),
        "packets": lambda: F.col("packets"),
        "bytes": lambda: F.col("bytes"),
        "pps": R.pps,
        "bps": R.bps,
        "bpp": R.bpp,
    }[order]()
    return value.cast("bigint")


def _top(df: DataFrame, orders, n: int, tie: list[str], flows_column: str) -> DataFrame:
    """One row per order of each row of `df`, of which the n largest of each order are kept.

    The aggregation below is computed once whatever the orders are; every task keeps its own n
    largest of an order before rows of one order meet.
    """
    values = F.array(*[F.struct(F.lit(o).alias("ordered_by"), order_value(o, flows_column).alias("rank_value")) for o in orders])
    ranked = df.withColumn("_o", F.explode(values)).withColumns({"rank_value": F.col("_o.rank_value"), "ordered_by": F.col("_o.ordered_by")})
    ranked = ranked.drop("_o").filter("rank_value > 0")
    if n == 0:
        return ranked
    order = Window.partitionBy("ordered_by").orderBy(F.col("rank_value").desc(), *[F.col(c).asc() for c in tie])
    return ranked.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def top_elements(stats: DataFrame, orders=("flows",), n: int = 10, tie: list[str] | None = None) -> DataFrame:
    """The n largest rows of an element statistic under each order; n = 0 keeps all.

    Rows whose value is 0 do not rank. `ordered_by` and `rank_value` say which order a row
    belongs to.
    """
    tie = [c for c in stats.columns if c == "prot" or c.startswith("value")] if tie is None else tie
    return _top(stats, orders, n, tie, "flows")


def top_flows(merged: DataFrame, orders=("flows",), n: int = 10, tie: list[str] | None = None) -> DataFrame:
    """As `top_elements`, over the result of a flow aggregation."""
    if tie is None:
        counters = {
            "packets", "bytes", "out_packets", "out_bytes", "first_ts", "last_ts", "tcp_flags", "aggr_flows",
        }
        tie = [c for c in merged.columns if c not in counters]
    return _top(merged, orders, n, tie, "aggr_flows")


def sort_by_date(flows: DataFrame) -> DataFrame:
    """By first seen in milliseconds, then arrival."""
    return flows.orderBy(F.date_trunc("MILLISECOND", F.col("first_ts").cast("timestamp")), "flow_id")


def limit_flows(flows: DataFrame, n: int) -> DataFrame:
    """The first n flows in arrival order."""
    return flows.orderBy("flow_id").limit(n)
