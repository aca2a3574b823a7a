"""Block-wise running values against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowtide.plans import ordered


def series(seed: int, n: int, span: int):
    rng = random.Random(seed)
    return [
        (by, pos, rng.randint(0, 5), rng.random() < 0.7)
        for by in ("a", "b", None)
        for pos in sorted(rng.sample(range(-span, span), n))
    ]


@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_running(spark, block):
    rows = series(1, 60, 400)
    df = spark.createDataFrame(rows, "by string, pos bigint, v bigint, hit boolean")
    out = ordered.running(
        df,
        "pos",
        {
            "total": ("sum", F.col("v")),
            "top": ("max", F.col("pos") % 17),
            "run": ("since", F.col("hit").cast("bigint"), ~F.col("hit")),
        },
        by=("by",),
        block=block,
    )
    assert out.columns == [*df.columns, "total", "top", "run"]
    got = {(r.by, r.pos): (r.total, r.top, r.run) for r in out.collect()}
    assert len(got) == len(rows)
    want, total, top, run, last = {}, 0, None, 0, object()
    for by, pos, v, hit in rows:
        if by != last:
            total, top, run, last = 0, None, 0, by
        total += v
        m = pos % 17 if pos >= 0 else -((-pos) % 17)
        top = m if top is None else max(top, m)
        run = run + 1 if hit else 0
        want[by, pos] = (total, top, run)
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 100_000])
@pytest.mark.parametrize("k", [1, 3])
def test_previous(spark, block, k):
    rows = series(2, 50, 300)
    df = spark.createDataFrame(rows, "by string, pos bigint, v bigint, hit boolean")
    out = ordered.previous(df, "pos", {"before": F.col("v")}, k, ("by",), block)
    names = ["before"] if k == 1 else [f"before_{i}" for i in range(1, k + 1)]
    got = {(r.by, r.pos): tuple(r[c] for c in names) for r in out.collect()}
    want = {}
    for by in ("a", "b", None):
        mine = [r for r in rows if r[0] == by]
        for i, r in enumerate(mine):
            want[by, r[1]] = tuple(mine[i - j][2] if i >= j else None for j in range(1, k + 1))
    assert got == want


def test_no_window_without_partition_sees_all_rows(spark):
    """The only unpartitioned window runs over the block table."""
    df = spark.range(100_000).select(F.col("id").alias("pos"))
    out = ordered.running(df, "pos", {"n": ("sum", F.lit(1))}, block=1000)
    assert out.filter("n <> pos + 1").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_blk" in plan


@pytest.mark.parametrize("kind", ["even", "sparse", "outliers", "crowded"])
def test_blocks_by_rank_hold_about_as_many_rows(spark, kind):
    """However the order is spread, the largest block is near its size, and running values are right."""
    i = F.col("id")
    orders = {
        "even": i,
        "sparse": i * 1_000_003,
        "outliers": F.when(i == 0, F.lit(-4 * 10**18)).when(i > 9995, F.lit(9 * 10**18) + i).otherwise(i),
        "crowded": F.when(i < 9000, i).otherwise(F.pow(F.lit(1.002), i).cast("bigint") + i),
    }
    df = spark.range(10_000).select(orders[kind].alias("o"), i.alias("v"), (i % 3).alias("by"))
    blocks = ordered._in_blocks(df, "o", ordered.ByRank(1000)).groupBy("_blk").count().collect()
    assert 9 <= len(blocks) <= 11 and max(r["count"] for r in blocks) <= 1100
    got = ordered.running(df, "o", {"s": ("sum", F.col("v"))}, block=ordered.ByRank(1000)).orderBy("o").collect()
    assert [r.s for r in got[:100]] == [k * (k + 1) // 2 for k in range(100)] and got[-1].s == 9999 * 5000
    before = ordered.previous(df, "o", {"p": F.col("v")}, by=("by",), block=ordered.ByRank(700))
    assert before.filter("NOT p <=> (CASE WHEN v > 2 THEN v - 3 END)").count() == 0


def test_blocks_by_rank_of_few_rows_and_ties(spark):
    df = spark.range(5).select(F.lit(7).cast("bigint").alias("o"), F.col("id").alias("by"), F.col("id").alias("v"))
    for rows in (2, 100):
        got = ordered.running(df, "o", {"s": ("sum", F.col("v"))}, by=("by",), block=ordered.ByRank(rows)).collect()
        assert sorted((r.by, r.s) for r in got) == [(k, k) for k in range(5)]
    assert ordered.running(df.limit(0), "o", {"s": ("sum", F.col("v"))}, block=ordered.ByRank(5)).count() == 0
