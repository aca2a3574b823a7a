"""Bounded, deterministic samples for fitting models, and fitting in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import stored


def bounded_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """About `n` rows of each value of `by`, or all where there are fewer.

    A row is taken if the hash of its `key`, as a share of all hashes, is below n / (rows of its
    value): whether it is depends on nothing but its key and that count, and no rows are gathered.
    """
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(key), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return rows.join(counts, F.col(by).eqNullSafe(F.col("_by"))).filter(share * F.col("_n") < n).drop("_by", "_n")


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """`key`, `label` (0 or 1), one row for each id: its commoner label. Null ids, other labels and ties are left out."""
    some = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).filter("key IS NOT NULL AND label IN (0, 1)")
    return some.groupBy("key").agg(F.avg("label").alias("label")).filter("label <> 0.5").select("key", F.round("label").cast("int").alias("label"))


def sampled_texts(sample: DataFrame, docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """`sample` (few rows, with a column `key` of different values) and a text of each: of several the one with the least hash."""
    few = stored(sample, "sample")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    met = texts.join(few, F.col("_id") == F.col(key)).drop("_id")
    return met.groupBy(*few.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fitted(sample: DataFrame, order: str, fit: Callable[[pa.Table], Any], *columns: str | Column) -> Any:
    """What `fit` makes of a bounded sample (its `columns`, or all), in one task, in an order that does not vary.

    Only the sample's rows go to that task; what they are chosen from is read by many.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*batches]
        table = pa.Table.from_batches(held).sort_by(order) if held else None
        # the unsorted rows go before the fit begins
        del held
        yield pa.record_batch([pa.array([pickle.dumps(fit(table or None))], pa.binary())], names=["model"])

    rows = sample.select(*columns or ("*",)).repartition(1).mapInArrow(task, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else fit(None)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of an id as text (of no text for a null id), modulo `folds`."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
