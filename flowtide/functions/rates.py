"""Durations and rates. Integer division throughout; a zero divisor gives 0."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def div_or_zero(a: Column, b: Column) -> Column:
    """`a div b`, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(int_div(a, b))


def epoch_ms(ts) -> Column:
    return F.unix_millis(_col(ts).cast("timestamp"))


def epoch_s(ts) -> Column:
    return F.unix_seconds(_col(ts).cast("timestamp"))


def duration_ms(first="first_ts", last="last_ts") -> Column:
    return epoch_ms(last) - epoch_ms(first)


MOST = 2**63 - 1


def per_time(count: Column, factor: int, ms: Column) -> Column:
    """`count * factor div ms` without its product: whole parts and remainders apart.

    A rate beyond 64 bits is given as the largest of them; 0 where no time passed.
    """
    whole = F.try_multiply(int_div(count, ms), F.lit(factor).cast("bigint"))
    rest = int_div((count % ms) * F.lit(factor).cast("bigint"), ms)
    rate = F.coalesce(F.try_add(whole, rest), F.lit(MOST))
    return F.when(ms == 0, F.lit(0).cast("bigint")).when(count.isNotNull() & ms.isNotNull(), rate)


def pps(packets="packets", ms: Column | None = None) -> Column:
    ms = duration_ms() if ms is None else ms
    return per_time(_col(packets).cast("bigint"), 1000, ms)


def bps(bytes_="bytes", ms: Column | None = None) -> Column:
    ms = duration_ms() if ms is None else ms
    return per_time(_col(bytes_).cast("bigint"), 8000, ms)


def bpp(bytes_="bytes", packets="packets") -> Column:
    return div_or_zero(_col(bytes_), _col(packets))


def flow_weight(aggr_flows="aggr_flows") -> Column:
    """How many flows a record stands for: its own count, or 1 when that is 0 or absent."""
    c = _col(aggr_flows)
    return F.when(c > 0, c).otherwise(F.lit(1).cast("bigint"))
