"""Metrics that run from slot to slot, on a stream: what they remember is keyed state.

The stream counts per slot. When its watermark releases slots, they reach the state of their
series in order of time; the state is a handful of numbers, whatever the series' length, and
no earlier slot is read again. The slots after the last released one are added at the end of the input
from the state that the last row carries.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtide.metrics import handshake, momentum
from flowtide.plans.slots import width_seconds
from flowtide.streaming.slots import to_files, with_timeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class FloodStreak:
    """Runs of slots whose handshake entropy is low; every `violations`-th of a run raises the alarm."""

    threshold: float = handshake.SYN_FLOOD_THRESHOLD
    violations: int = handshake.MAX_VIOLATIONS

    takes = {**{c: "bigint" for c in handshake.UNUSUAL}, "unusual_total": "bigint", "entropy": "double"}
    keeps = {"run": "bigint"}
    adds = {"alarm": "int"}

    def start(self) -> tuple:
        return (0,)

    def step(self, state: tuple, row: Any) -> tuple[tuple, tuple]:
        low = row.entropy <= self.threshold
        run = state[0] + 1 if low else 0
        return (run,), (int(low and run % self.violations == 0),)


@dataclass(frozen=True)
class StockMarket:
    """The indicators of `momentum.stock_market_of` from the packets of slot after slot."""

    momentum_threshold: float = momentum.MOMENTUM_THRESHOLD
    roc_threshold: float = momentum.ROC_THRESHOLD
    rsi_threshold: float = momentum.RSI_THRESHOLD
    violations: int = momentum.MIN_VIOLATIONS

    takes = {"packets": "bigint"}
    #: slots so far, packets of the last two, sums and numbers of gains and losses, the run, its failed checks
    keeps = {k: "bigint" for k in ("i", "packets_1", "packets_2", "gain_sum", "gain_n", "loss_sum", "loss_n", "roc_run", "failures")}
    adds = {"momentum": "double", "roc": "double", "roc_prev": "double", "rsi": "double", "alarm": "int"}

    def start(self) -> tuple:
        return (0,) * len(self.keeps)

    def step(self, state: tuple, row: Any) -> tuple[tuple, tuple]:
        i, p1, p2, gain_sum, gain_n, loss_sum, loss_n, run, failures = state
        p, i = int(row.packets), i + 1
        diff = p - p1
        change = 100.0 * diff / p1 if i > 1 and p1 else 0.0
        counted = change >= self.momentum_threshold and i > 2
        roc = p / p1 if counted and p1 else 0.0
        roc_prev = p1 / p2 if counted and p2 else 0.0
        if i > 2 and diff >= 0:
            gain_sum, gain_n = gain_sum + diff, gain_n + 1
        elif i > 2:
            loss_sum, loss_n = loss_sum - diff, loss_n + 1
        rsi = 0.0
        if gain_n and loss_n:
            gain = (gain_sum / gain_n * (i - 1) + max(diff, 0)) / i
            loss = (loss_sum // loss_n * (i - 1) + max(-diff, 0)) / i
            rsi = 100.0 - 100.0 / (1.0 + gain / loss)
        hit = counted and roc >= self.roc_threshold and roc_prev >= self.roc_threshold
        if counted and not hit:
            run = failures = 0
        run += hit
        check = hit and run % self.violations == 0
        failures += check and rsi < self.rsi_threshold
        kept = (i, p, p1, gain_sum, gain_n, loss_sum, loss_n, int(run), int(failures))
        return kept, (change, roc, roc_prev, rsi, int(check and not failures))


Fold = FloodStreak | StockMarket


def _schema(fold: Fold) -> str:
    fields = {"series": "string", "slot": "timestamp", **fold.takes, **fold.keeps, **fold.adds}
    return ", ".join(f"`{n}` {t}" for n, t in fields.items())


def _folded(fold: Fold, series: str, rows: pd.DataFrame, state: tuple, after: Any) -> tuple[pd.DataFrame, tuple, Any]:
    """The rows of one series, in order of time, with what follows from the state before each; slots seen before are left out."""
    out = []
    for row in rows.sort_values("slot").itertuples(index=False):
        if after is not None and row.slot <= after:
            continue
        state, added = fold.step(state, row)
        after = row.slot
        out.append((series, row.slot, *(getattr(row, c) for c in fold.takes), *state, *added))
    names = ["series", "slot", *fold.takes, *fold.keeps, *fold.adds]
    return pd.DataFrame(out, columns=names), state, after


class _SeriesState(StatefulProcessor):
    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = ", ".join(f"{n} {t}" for n, t in self.fold.keeps.items())
        self.kept = handle.getValueState("kept", f"{kept}, at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.kept.get()
        state, after = (tuple(old[:-1]), pd.Timestamp(old[-1])) if old else (self.fold.start(), None)
        frame, state, after = _folded(self.fold, key[0], pd.concat(list(rows)), state, after)
        if len(frame):
            self.kept.update((*state, after.to_pydatetime()))
            yield frame

    def close(self) -> None:
        pass


@contextmanager
def _state_in_files(spark: SparkSession):
    """Queries started here keep their state in RocksDB, which arbitrary state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def fold_stream(slots: DataFrame, fold: Fold) -> DataFrame:
    """A streaming table of slots (`series`, `slot`, what the fold takes), each with what follows from those before it.

    `series` is the key: each has a state of its own. Slots must come in order of time from one
    batch to the next, as a watermark releases them.
    """
    return slots.groupBy("series").transformWithStateInPandas(_SeriesState(fold), _schema(fold), "Append", "None")


def fold_rows(slots: DataFrame, fold: Fold, last: dict[str, Row]) -> DataFrame:
    """The same for a table of slots, from the state that the last row of each series carries."""
    starts = {series: (tuple(row[c] for c in fold.keeps), pd.Timestamp(row["slot"])) for series, row in last.items()}

    def fold_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _folded(fold, key[0], rows, *starts.get(key[0], (fold.start(), None)))[0]

    return slots.groupBy("series").applyInPandas(fold_one, _schema(fold))


def _series_of(flows: DataFrame, width: str, timeout_s: int | None, series: Column, aggregated) -> DataFrame:
    """Slots of a series, from a stream (with its timeout) or a table."""
    live = timeout_s is not None
    flows = with_timeout(flows, timeout_s) if live else flows.withColumn("event_ts", F.col("first_ts").cast("timestamp"))
    counted = aggregated(flows.withColumn("slot", F.window("event_ts", width)))
    return counted.select(series.alias("series"), F.col("slot.start").alias("slot"), *[c for c in counted.columns if c != "slot"])


def unusual_handshakes(flows: DataFrame, width: str, timeout_s: int | None = None) -> DataFrame:
    """The four unusual-handshake counts of each slot and their entropy: pairs first, then slots, both on the stream."""

    def aggregated(slotted: DataFrame) -> DataFrame:
        counts = handshake.handshake_counts_of(handshake.pair_table(slotted, width))
        return handshake.with_entropy(counts)

    return _series_of(flows, width, timeout_s, F.lit("all"), aggregated)


def slot_packets(flows: DataFrame, width: str, timeout_s: int | None = None) -> DataFrame:
    """Packets of each slot."""
    return _series_of(flows, width, timeout_s, F.lit("all"), lambda slotted: slotted.groupBy("slot").agg(F.sum("packets").alias("packets")))


def run_series(stream: DataFrame, landed: DataFrame, slots_of, fold: Fold, width: str, timeout_s: int, folder: str) -> DataFrame:
    """Live rows of every slot, in order, with the final flush.

    Released slots go to `<folder>/slots`. When the input ends, the slots after the last
    released one are counted from what has landed and folded on from the state of that row.
    `slots_of` is `unusual_handshakes` or `slot_packets`, or the like.
    """
    spark = stream.sparkSession
    with _state_in_files(spark):
        query = to_files(fold_stream(slots_of(stream, width, timeout_s), fold), f"{folder}/slots", f"{folder}/checkpoint")
    query.awaitTermination()
    released = spark.read.schema(_schema(fold)).parquet(f"{folder}/slots")
    # one row per series
    newest = released.groupBy("series").agg(F.max_by(F.struct("*"), "slot").alias("r")).select("r.*").collect()
    last = {row["series"]: row for row in newest}
    if last:
        # slots are released together: what starts before the earliest of these was counted
        since = min(row["slot"] for row in newest)
        landed = landed.filter(F.col("first_ts") >= F.lit(since).cast("timestamp_ntz") + F.expr(f"INTERVAL '{width_seconds(width)}' SECOND"))
    rest = fold_rows(slots_of(landed, width), fold, last)
    return released.unionByName(rest).withColumn("slot", F.col("slot").cast("timestamp_ntz"))


def run_syn_flood(stream: DataFrame, landed: DataFrame, width: str, timeout_s: int, folder: str, **kw: Any) -> DataFrame:
    """`handshake.syn_flood`, live: counts, entropy, run and alarm of every slot."""
    fold = FloodStreak(**kw)
    out = run_series(stream, landed, unusual_handshakes, fold, width, timeout_s, folder)
    return out.select("slot", *handshake.UNUSUAL, "unusual_total", "entropy", "run", "alarm")


def run_stock_market(stream: DataFrame, landed: DataFrame, width: str, timeout_s: int, folder: str, **kw: Any) -> DataFrame:
    """`momentum.stock_market`, live."""
    out = run_series(stream, landed, slot_packets, StockMarket(**kw), width, timeout_s, folder)
    return out.select("slot", "packets", "momentum", "roc", "roc_prev", "rsi", "roc_run", "alarm")
