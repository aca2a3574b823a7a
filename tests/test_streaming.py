"""Streams against the batch functions and against a replay of the arrivals."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import at, make_flows
from flowtide.metrics import divergence, handshake, momentum
from flowtide.operators import predicates as P
from flowtide.streaming import series, slots as SS, stateful

WIDTH = "1 minute"


def arrivals(seed: int, n: int, slots: int):
    """Mostly ordered flows; one in six comes late by up to some minutes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = i * slots * 60 / n
        if rng.random() < 0.17:
            t = max(0.0, t - rng.uniform(0, 400))
        first = at(round(t, 3))
        rows.append(dict(flow_id=i, first_ts=first, last_ts=first, src_addr=rng.randrange(4), src_port=rng.choice([80, 53]), packets=rng.randrange(1, 9)))
    return rows


def land(spark, rows, path, files):
    """One file per batch of arrivals, oldest first."""
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        make_flows(spark, rows[i : i + step]).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("timeout", [0, 120, 100_000])
def test_late_flows_replay(spark, timeout):
    rows = arrivals(1, 500, 30)
    got = {r.slot: r.late_flows for r in SS.late_flows(make_flows(spark, rows), WIDTH, timeout).collect()}
    want, top = {}, float("-inf")
    for r in rows:
        s = int((r["first_ts"] - at(0)).total_seconds())
        end = s // 60 * 60 + 60
        if top - timeout >= end:
            slot = at(end - 60)
            want[slot] = want.get(slot, 0) + 1
        top = max(top, s)
    assert got == want
    assert bool(want) == (timeout < 1000)


def test_slot_counters_release_and_flush(spark, tmp_path):
    rows = sorted(arrivals(2, 200, 12), key=lambda r: r["first_ts"])
    land(spark, rows, str(tmp_path / "in"), 5)
    stream = SS.read_flow_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    landed = spark.read.parquet(str(tmp_path / "in"))
    out = SS.run_slot_counters(stream, landed, WIDTH, 60, str(tmp_path / "out"))
    batch = SS.slot_counters(landed, WIDTH)
    assert sorted(out.collect()) == sorted(batch.collect())
    released = spark.read.parquet(str(tmp_path / "out/slots")).count()
    assert 0 < released < batch.count()


def test_late_flows_drop(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, [dict(first_ts=at(30)), dict(first_ts=at(600))], path, 1)
    land(spark, [dict(first_ts=at(660))], path, 1)
    land(spark, [dict(first_ts=at(31)), dict(first_ts=at(720))], path, 1)
    stream = SS.read_flow_stream(spark, path, files_per_batch=1)
    out = SS.run_slot_counters(stream, spark.read.parquet(path), WIDTH, 60, str(tmp_path / "out"))
    got = {r.slot: r.flows for r in out.collect()}
    assert got == {at(0): 1, at(600): 1, at(660): 1, at(720): 1}


def landed_in_parts(spark, tmp_path):
    rows = sorted(arrivals(3, 240, 10), key=lambda r: r["first_ts"])
    # an empty stretch in the middle
    rows = [r for r in rows if not at(240) <= r["first_ts"] < at(400)]
    rng = random.Random(9)
    rows = [{**r, "dst_addr": rng.randrange(4), "tcp_flags": rng.choice([2, 18, 16, 4])} for r in rows]
    land(spark, rows, str(tmp_path / "in"), 4)
    landed = spark.read.parquet(str(tmp_path / "in"))
    return landed, SS.read_flow_stream(spark, str(tmp_path / "in"), files_per_batch=1)


def test_divergences_equal_batch(spark, tmp_path):
    landed, stream = landed_in_parts(spark, tmp_path)
    out = str(tmp_path / "out")
    stateful.run_divergences(stream, "src", WIDTH, 60, out).awaitTermination()
    early = spark.read.parquet(f"{out}/slots").count()
    stateful.flush_divergences(landed, "src", WIDTH, out)
    stateful.flush_divergences(landed, "src", WIDTH, out)  # nothing left, nothing doubled
    div = divergence.divergences(landed, WIDTH, ("src",)).orderBy("slot").collect()
    got = spark.read.parquet(f"{out}/divergences").orderBy("slot").collect()
    assert [(r.slot, r.common_keys) for r in got] == [(r.slot, r.common_keys) for r in div]
    assert [(r.kl, r.renyi) for r in got] == [pytest.approx((r.kl, r.renyi)) for r in div]
    assert 0 < early < len(div)


@pytest.mark.parametrize("timeout", [60, 100_000])
def test_series_equal_batch(spark, tmp_path, timeout):
    """Runs and indicators carried in keyed state, over several batches and the flush."""
    landed, stream = landed_in_parts(spark, tmp_path)
    kw = dict(momentum_threshold=-100.0, roc_threshold=0.5, rsi_threshold=50.0, violations=2)
    stock = momentum.stock_market(landed, WIDTH, **kw).orderBy("slot").collect()
    live = series.run_stock_market(stream, landed, WIDTH, timeout, str(tmp_path / "stock"), **kw).orderBy("slot")
    released = spark.read.schema("slot timestamp").parquet(str(tmp_path / "stock/slots")).count()
    assert (released > 3) == (timeout == 60) and released < len(stock)
    for got, want in zip(live.collect(), stock, strict=True):
        assert (got.slot, got.packets, got.roc_run, got.alarm) == (want.slot, want.packets, want.roc_run, want.alarm)
        assert (got.momentum, got.roc, got.roc_prev, got.rsi) == pytest.approx((want.momentum, want.roc, want.roc_prev, want.rsi))
    flood = handshake.syn_flood(landed, WIDTH, threshold=1.9, violations=2).orderBy("slot").collect()
    live = series.run_syn_flood(stream, landed, WIDTH, timeout, str(tmp_path / "flood"), threshold=1.9, violations=2).orderBy("slot")
    columns = [c for c in live.columns if c != "entropy"]
    assert [[r[c] for c in columns] for r in live.collect()] == [[r[c] for c in columns] for r in flood]
    assert {r.alarm for r in flood} == {0, 1}


def test_a_series_starts_from_its_own_state(spark):
    """Each key has its own run; slots at or before the last one seen are left out."""
    fold = series.FloodStreak(threshold=1.0, violations=2)
    counts = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in (*handshake.UNUSUAL, "unusual_total"))
    rows = spark.sql(f"""SELECT series, TIMESTAMP '2024-03-01' + make_interval(0, 0, 0, 0, 0, minute) AS slot, {counts}, CAST(h AS DOUBLE) AS entropy
        FROM VALUES ('a', 1, 0.5), ('a', 0, 0.5), ('a', 2, 2.0), ('a', 3, 0.1), ('b', 1, 0.5), ('b', 2, 0.5) t(series, minute, h)""")
    got = {(r.series, r.slot.minute): (r.run, r.alarm) for r in series.fold_rows(rows, fold, {}).collect()}
    assert got == {("a", 0): (1, 0), ("a", 1): (2, 1), ("a", 2): (0, 0), ("a", 3): (1, 0), ("b", 1): (1, 0), ("b", 2): (2, 1)}
    last = series.fold_rows(rows.filter("series = 'a' AND minute(slot) < 2"), fold, {}).filter("minute(slot) = 1").first()
    got = {(r.series, r.slot.minute): r.run for r in series.fold_rows(rows.filter("series = 'a'"), fold, {"a": last}).collect()}
    assert got == {("a", 2): 0, ("a", 3): 1}


def test_replayed_batch_writes_the_same(spark, tmp_path):
    spark.catalog.clearCache()
    counts = stateful.key_counts(make_flows(spark, arrivals(4, 60, 4)), "src", WIDTH)
    for _ in range(2):
        stateful.add_slots(counts, "src", WIDTH, str(tmp_path))
    slots = counts.select("slot").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/slots").count() == slots
    assert spark.read.parquet(f"{tmp_path}/divergences").count() == slots
    assert spark.read.parquet(f"{tmp_path}/frequencies").count() == counts.count()
    # nothing stays persisted after a batch
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_a_batch_reads_the_slot_before_and_no_older_one(spark, tmp_path):
    flows = make_flows(spark, arrivals(6, 120, 6))
    counts = stateful.key_counts(flows, "src", WIDTH)
    slots = sorted(r.slot for r in counts.select("slot").distinct().collect())
    want = {r.slot: r.common_keys for r in divergence.divergences(flows, WIDTH, ("src",)).collect()}
    for k, slot in enumerate(slots):
        stateful.add_slots(counts.filter(F.col("slot") == slot), "src", WIDTH, str(tmp_path))
        if k > 1:
            # the counts of slots two back are spoilt: whoever reads them fails
            for part in (tmp_path / "frequencies" / f"{stateful.SLOT_ID}={slots[k - 1]:%Y%m%d%H%M%S}").parent.glob(f"*={slots[k - 2]:%Y%m%d%H%M%S}/*.parquet"):
                part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
                part.write_bytes(b"no parquet")
    got = {r.slot: r.common_keys for r in spark.read.parquet(f"{tmp_path}/divergences").collect()}
    assert got == want and len(slots) > 4


def test_capture_and_channels(spark, tmp_path):
    rows = arrivals(5, 100, 5)
    land(spark, rows, str(tmp_path / "in"), 2)
    stream = SS.read_flow_stream(spark, str(tmp_path / "in"))
    SS.capture(stream, WIDTH, str(tmp_path / "cap"), str(tmp_path / "c1")).awaitTermination()
    landed = spark.read.parquet(str(tmp_path / "in"))
    got = {str(r.capture): r["count"] for r in spark.read.parquet(str(tmp_path / "cap")).groupBy("capture").count().collect()}
    want = {r.slot.strftime("%Y%m%d%H%M%S"): r.flows for r in SS.slot_counters(landed, WIDTH).collect()}
    assert got == want
    channels = {"web": P.port("=", 80), "all": P.any_()}
    live = SS.channel_counters(stream, channels, WIDTH, 0)
    SS.to_files(live, str(tmp_path / "ch"), str(tmp_path / "c2")).awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "ch")).collect():
        assert r.flows == landed.filter(channels[r.channel]).filter(F.date_trunc("minute", "first_ts") == r.slot).count()


def test_late_flows_live_over_batches(spark, tmp_path):
    """Several micro-batches count what one replay of all arrivals counts."""
    rows = [{"flow_id": i, "first_ts": at(t), "last_ts": at(t)} for i, t in enumerate([0, 30, 400, 20, 70, 410, 900, 5, 420, 800, 901, 10])]
    for k in range(4):
        make_flows(spark, rows[3 * k : 3 * k + 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    stream = SS.read_flow_stream(spark, str(tmp_path / "landed"), 1)
    SS.run_late_flows(stream, "1 minute", 60, str(tmp_path / "out")).awaitTermination()
    late = spark.read.parquet(str(tmp_path / "out/late"))
    got = {(r.slot, r.n) for r in late.groupBy("slot").agg(F.sum("late_flows").alias("n")).collect()}
    assert got == {(r.slot, r.late_flows) for r in SS.late_flows(landed, "1 minute", 60).collect()} and got
    assert spark.read.parquet(str(tmp_path / "out/seen")).count() == 4
