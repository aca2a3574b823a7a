"""Handshake tests: unusual handshakes, SYN floods, incomplete connections.

All counts depend on a connection (source, destination) and on its reverse only through
sums and flags, so both are aggregated under one canonical pair of addresses: a single
group-by with map-side partial sums, no join and never flow against flow.

Flags above 63 are neither SYN, ACK nor RST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.rates import epoch_s
from flowtide.operators.aggregate import address_end, not_after
from flowtide.plans.slots import slot_streak, with_slot

DELAY = 100
SYN_FLOOD_THRESHOLD = 0.3
MAX_VIOLATIONS = 3
SYN_RATE_THRESHOLD = 0.3
CONNECTION_THRESHOLD = 0.035

_ENDS = ["src_addr", "src_hi", "src_lo", "dst_addr", "dst_hi", "dst_lo"]


def _flag(bit: int) -> Column:
    flags = F.col("tcp_flags")
    return (flags <= 63) & (flags.bitwiseAND(F.lit(bit)) != 0)


def _syn() -> Column:
    return _flag(2) & ~_flag(16)


def _synack() -> Column:
    return _flag(2) & _flag(16)


def _per_connection(when: Column | None = None) -> dict[str, Column]:
    def count(cond: Column) -> Column:
        cond = cond if when is None else when & cond
        return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    first = epoch_s("first_ts")
    return {
        "n": count(F.lit(True)),
        "syn": count(_syn()),
        "synack": count(_synack()),
        "ack": count(_flag(16)),
        "rst": count(_flag(4)),
        "any_syn": count(_flag(2)),
        "first_s": F.min(first if when is None else F.when(when, first)),
    }


def connection_table(flows: DataFrame, width: str) -> DataFrame:
    """Per slot and (src, dst): flows, pure SYN, SYN+ACK, ACK and RST flows, first second."""
    return (
        with_slot(flows, width)
        .groupBy("slot", *_ENDS)
        .agg(*[e.alias(n) for n, e in _per_connection().items()])
    )


def pair_table(flows: DataFrame, width: str) -> DataFrame:
    """Both directions of every address pair of a slot in one row.

    `f_*` describes the direction from the smaller end (`a_hi`, `a_lo`) to the larger one
    (`b_hi`, `b_lo`), `r_*` the other. A flow from an address to itself is its own reverse:
    such pairs have only `f_*`.
    """
    src, dst = address_end("src"), address_end("dst")
    names = ("hi", "lo")
    keyed = (
        with_slot(flows, width)
        .withColumn("_fwd", not_after(src, dst))
        .select(
            "slot", "is_v6", "tcp_flags", "first_ts", "_fwd",
            *[F.when(F.col("_fwd"), s).otherwise(d).alias(f"a_{n}") for n, s, d in zip(names, src, dst)],
            *[F.when(F.col("_fwd"), d).otherwise(s).alias(f"b_{n}") for n, s, d in zip(names, src, dst)],
        )
    )
    fwd = F.col("_fwd")
    return keyed.groupBy("slot", "is_v6", "a_hi", "a_lo", "b_hi", "b_lo").agg(
        *[e.alias(f"f_{n}") for n, e in _per_connection(fwd).items()],
        *[e.alias(f"r_{n}") for n, e in _per_connection(~fwd).items()],
    )


def _self_pair() -> Column:
    return (F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") == F.col("b_lo"))


_FIELDS = ("n", "syn", "synack", "ack", "rst", "first_s")


def reverse_pairs(pairs: DataFrame) -> DataFrame:
    """Connections next to their reverse: one row per direction that has a reverse.

    Columns `n, syn, ...` describe the connection, `rev_*` its reverse.
    """

    def way(src: str, dst: str, fwd: str, rev: str) -> Column:
        return F.struct(
            *[F.col(f"{e}_{n}").alias(f"{side}_{n}") for side, e in (("src", src), ("dst", dst)) for n in ("hi", "lo")],
            *[F.col(f"{fwd}_{c}").alias(c) for c in _FIELDS],
            *[F.col(f"{rev}_{c}").alias(f"rev_{c}") for c in _FIELDS],
        )

    self_pair = _self_pair()
    ways = (
        F.when(self_pair, F.array(way("a", "b", "f", "f")))
        .when((F.col("f_n") > 0) & (F.col("r_n") > 0), F.array(way("a", "b", "f", "r"), way("b", "a", "r", "f")))
    )
    return (
        pairs.select("slot", "is_v6", F.explode(ways).alias("w"))
        .select(
            "slot",
            *[
                e
                for side in ("src", "dst")
                for e in (
                    F.when(~F.col("is_v6"), F.col(f"w.{side}_lo")).alias(f"{side}_addr"),
                    F.when(F.col("is_v6"), F.col(f"w.{side}_hi")).alias(f"{side}_hi"),
                    F.when(F.col("is_v6"), F.col(f"w.{side}_lo")).alias(f"{side}_lo"),
                )
            ],
            *[F.col(f"w.{c}").alias(c) for c in (*_FIELDS, *[f"rev_{c}" for c in _FIELDS])],
        )
    )


def _contributions(fwd: str, rev: str, delay: int) -> dict[str, Column]:
    """What one direction of a pair adds to each count of its slot (0 without a reverse)."""

    def f(c: str) -> Column:
        return F.col(f"{fwd}_{c}")

    def r(c: str) -> Column:
        return F.col(f"{rev}_{c}")

    answered = (r("synack") > 0) & (r("first_s") > delay)
    counts = {
        "syn_no_answer": F.when(~answered, f("syn")),
        "syn_server_reset": F.when(r("rst") > 0, f("syn")),
        "syn_synack": F.when(answered, f("syn")),
        "syn_synack_client_reset": F.when(f("rst") > 0, f("syn") * r("synack")),
        "incomplete": f("syn") * (r("n") - r("synack"))
        + F.when(f("ack") == 0, f("syn") * r("synack")).otherwise(0),
        "complete": F.when(f("ack") > 0, f("syn") * r("synack")),
    }
    return {n: F.coalesce(F.when(r("n") > 0, e), F.lit(0).cast("bigint")) for n, e in counts.items()}


def handshake_counts_of(pairs: DataFrame, delay: int = DELAY) -> DataFrame:
    """Per slot: flows, SYN flows and the six handshake counts, from the pair table."""
    self_pair = _self_pair()
    one, other, own = (_contributions(x, y, delay) for x, y in (("f", "r"), ("r", "f"), ("f", "f")))
    return pairs.groupBy("slot").agg(
        F.sum(F.col("f_n") + F.col("r_n")).alias("flows"),
        F.sum(F.col("f_any_syn") + F.col("r_any_syn")).alias("syn_flows"),
        *[F.sum(F.when(self_pair, own[n]).otherwise(one[n] + other[n])).alias(n) for n in one],
    )


def handshake_counts(flows: DataFrame, width: str, delay: int = DELAY) -> DataFrame:
    return handshake_counts_of(pair_table(flows, width), delay)


UNUSUAL = ("syn_no_answer", "syn_server_reset", "syn_synack", "syn_synack_client_reset")


def with_entropy(counts: DataFrame) -> DataFrame:
    """The four unusual-handshake counts of each slot, their total and their entropy."""
    total = sum((F.col(c) for c in UNUSUAL), F.lit(0).cast("bigint"))
    slots = counts.select("slot", *UNUSUAL, total.alias("unusual_total"))
    n = F.col("unusual_total").cast("double")
    terms = [F.when(F.col(c) > 0, F.col(c) / n * F.log2(n / F.col(c))).otherwise(0.0) for c in UNUSUAL]
    return slots.withColumn("entropy", F.when(F.col("unusual_total") > 0, sum(terms[1:], terms[0])).otherwise(0.0))


def syn_flood_of(counts: DataFrame, width: str, threshold: float = SYN_FLOOD_THRESHOLD, violations: int = MAX_VIOLATIONS) -> DataFrame:
    """Entropy of the four unusual-handshake counts and the alarm on every third low slot.

    A slot violates when the entropy is at or below the threshold; the alarm comes after
    `violations` violating slots in a row and the count then starts again.
    """
    slots = with_entropy(counts)
    low = F.col("entropy") <= threshold
    run = slot_streak(slots, low, "run", width)
    return run.withColumn(
        "alarm", (low & (F.col("run") % violations == 0)).cast("int")
    )


def syn_flood(flows: DataFrame, width: str, threshold: float = SYN_FLOOD_THRESHOLD, violations: int = MAX_VIOLATIONS, delay: int = DELAY) -> DataFrame:
    return syn_flood_of(handshake_counts(flows, width, delay), width, threshold, violations)


def ddos_test_of(counts: DataFrame, high: float = SYN_RATE_THRESHOLD, low: float = CONNECTION_THRESHOLD) -> DataFrame:
    """SYN, incomplete and complete rates per flow, and the high-rate and low-rate alarms.

    The low-rate test looks at complete minus incomplete.
    """
    n = F.col("flows").cast("double")
    rates = counts.select(
        "slot",
        (F.col("syn_flows") / n).alias("syn_rate"),
        (F.col("incomplete") / n).alias("incomplete_rate"),
        (F.col("complete") / n).alias("complete_rate"),
    )
    is_high = F.col("syn_rate") >= high
    is_low = ~is_high & (F.col("complete_rate") - F.col("incomplete_rate") >= low)
    return rates.withColumns({"alarm_high": is_high.cast("int"), "alarm_low": is_low.cast("int")})


def ddos_test(flows: DataFrame, width: str, high: float = SYN_RATE_THRESHOLD, low: float = CONNECTION_THRESHOLD) -> DataFrame:
    return ddos_test_of(handshake_counts(flows, width), high, low)
