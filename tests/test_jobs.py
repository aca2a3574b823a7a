from __future__ import annotations

import ipaddress
import random
from pathlib import Path
import statistics
import warnings
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_flows
from flowtide.functions.addresses import split_v6
from flowtide.jobs import anonymise as AN, centres, features as FE, upkeep
from flowtide.jobs.quantiles import exact_median

KEY = bytes(range(32))


def shared_bits(a: int, b: int, width: int) -> int:
    return width - (a ^ b).bit_length()


def test_aes_vector(spark):
    block = F.unhex(F.lit("00112233445566778899aabbccddeeff"))
    out = spark.range(1).select(F.lower(F.hex(AN.aes_block(block, bytes(range(16)))))).first()[0]
    assert out == "69c4e0d86a7b0430d8cdb78070b4c55a"


def aes_top_bits(spark, blocks: list[str]) -> list[int]:
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b string")
    rows = df.select("i", F.hex(AN.aes_block(F.unhex("b"), KEY)).alias("h")).orderBy("i").collect()
    return [int(r.h[0], 16) >> 3 for r in rows]


def test_v4_bit_by_bit(spark):
    """The scheme spelt out: bit i of the flip is AES(first i bits, rest of the pad)."""
    addr = 0xC0A8017B
    pad_hex = spark.range(1).select(F.hex(AN.aes_block(F.lit(KEY[16:]), KEY))).first()[0]
    pad = int(pad_hex, 16)
    blocks = []
    for pos in range(32):
        top = (addr >> (32 - pos) << (32 - pos)) << 96 if pos else 0
        blocks.append(f"{top | (pad & ((1 << (128 - pos)) - 1)):032x}")
    want = addr ^ int("".join(map(str, aes_top_bits(spark, blocks))), 2)
    got = spark.range(1).select(AN.anonymise_v4(F.lit(addr).cast("bigint"), KEY)).first()[0]
    assert got == want


def test_v4_keeps_prefixes(spark):
    rng = random.Random(1)
    addrs = sorted({rng.getrandbits(32) >> s << s for s in (0, 8, 16) for _ in range(8)} | {0, 2**32 - 1, 0x0A000001, 0x0A000002})
    df = spark.createDataFrame([(a,) for a in addrs], "a bigint")
    got = {r.a: r.b for r in df.select("a", AN.anonymise_v4(F.col("a"), KEY).alias("b")).collect()}
    for x in addrs:
        for y in addrs:
            assert shared_bits(x, y, 32) == shared_bits(got[x], got[y], 32)
    assert all(0 <= v < 2**32 for v in got.values()) and got != {a: a for a in addrs}


def test_v6_keeps_prefixes(spark):
    base = int(ipaddress.IPv6Address("2001:db8:1:2::7"))
    addrs = [base, base ^ 1, base ^ (1 << 15), base ^ (1 << 63), base ^ (1 << 64), base ^ (1 << 111), base ^ (1 << 127), 0, (1 << 128) - 1]
    df = spark.createDataFrame([(i, *split_v6(a)) for i, a in enumerate(addrs)], "i int, hi bigint, lo bigint")
    hi, lo = AN.anonymise_v6(F.col("hi"), F.col("lo"), KEY)
    got = {r.i: ((r.h % (1 << 64)) << 64) | (r.l % (1 << 64)) for r in df.select("i", hi.alias("h"), lo.alias("l")).collect()}
    for i, x in enumerate(addrs):
        for j, y in enumerate(addrs):
            assert shared_bits(x, y, 128) == shared_bits(got[i], got[j], 128)


def test_a_prefix_is_encrypted_once(spark):
    """Ciphers by level of the tree: its distinct prefixes times the bits since the level before."""
    rng = random.Random(4)
    nets = [rng.getrandbits(24) << 8 for _ in range(12)]
    addrs = sorted({n + rng.getrandbits(8) for n in nets for _ in range(60)})
    df = spark.createDataFrame([(a,) for a in addrs], "v4 bigint")
    tree = AN.prefix_tree_v4(df, KEY)
    ciphers = sum(level.count() * (bits - before) for level, bits, before in zip(tree, AN.LEVELS_V4, (0, *AN.LEVELS_V4)))
    assert ciphers == 16 * len({a >> 16 for a in addrs}) + 8 * len({a >> 8 for a in addrs}) + 8 * len(addrs) < 10 * len(addrs)
    got = {r.v4: r.a for r in tree[-1].select("v4", F.col("v4").bitwiseXOR(F.col("flips")).alias("a")).collect()}
    want = {r.v4: r.a for r in df.select("v4", AN.anonymise_v4(F.col("v4"), KEY).alias("a")).collect()}
    assert got == want
    v6 = [split_v6(int(ipaddress.IPv6Address("2001:db8::")) + (a << (s % 100))) for s, a in enumerate(addrs[:150])]
    df = spark.createDataFrame(sorted(set(v6)), "hi bigint, lo bigint")
    hi, lo = AN.anonymise_v6(F.col("hi"), F.col("lo"), KEY)
    want = {(r.hi, r.lo): (r.h, r.l) for r in df.select("hi", "lo", hi.alias("h"), lo.alias("l")).collect()}
    last = AN.prefix_tree_v6(df, KEY)[-1]
    got = {(r.hi, r.lo): (r.h, r.l) for r in last.select("hi", "lo", F.col("hi").bitwiseXOR(F.col("flips_hi")).alias("h"), F.col("lo").bitwiseXOR(F.col("flips_lo")).alias("l")).collect()}
    assert got == want


def test_anonymisation_stores_nothing_and_joins_once(spark, tmp_path):
    """No table of addresses and pseudonyms is left anywhere; flows move for one join."""
    flows = make_flows(spark, [dict(src_addr=k % 5, dst_addr=7, packets=k) for k in range(20)])
    flows.write.parquet(str(tmp_path / "flows"))
    stored = spark.read.schema(flows.schema).parquet(str(tmp_path / "flows"))
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(Path(root).parent.rglob("*")) if Path(root).exists() else set()
    out = AN.anonymise(stored, KEY)
    assert out.count() == 20 and len({r.src_addr for r in out.collect()}) == 5
    after = set(Path(root).parent.rglob("*")) if Path(root).exists() else set()
    assert not {p for p in after - before if "flowtide" in p.name}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Join" in line]
    assert len([line for line in wide if "LeftOuter" in line]) == 1


def test_anonymise_flows(spark):
    hi, lo = split_v6(int(ipaddress.IPv6Address("2001:db8::1")))
    df = make_flows(spark, [
        dict(src_addr=1, dst_addr=2, next_hop=3, bgp_next_hop=4, router=5, src_as=6, dst_as=7, mpls=[1]),
        dict(is_v6=True, src_hi=hi, src_lo=lo, dst_hi=hi, dst_lo=lo),
        dict(src_addr=2, dst_addr=1),
    ])
    out = {r.flow_id: r for r in AN.anonymise(df, "0x" + KEY.hex()).collect()}
    assert len(out) == 3 and list(out[0].asDict()) == df.columns
    assert out[0].src_addr == out[2].dst_addr and out[0].dst_addr == out[2].src_addr != out[0].src_addr
    assert (out[0].src_as, out[0].dst_as, out[1].src_as, out[0].mpls) == (0, 0, None, [1])
    assert (out[1].src_hi, out[1].src_lo) == (out[1].dst_hi, out[1].dst_lo) != (hi, lo)
    assert out[1].src_addr is None and out[0].src_hi is None and out[2].next_hop is None


def test_keys():
    assert AN.parse_key("a" * 32) == b"a" * 32 and AN.parse_key("0X" + "0f" * 32) == b"\x0f" * 32
    for bad in ("short", "0x12", "1x" + "00" * 32):
        with pytest.raises(ValueError):
            AN.parse_key(bad)


def test_sequence_wrap_and_gap(spark):
    rows = [("a", i, s, c) for i, (s, c) in enumerate([(4294967290, 5), (4294967295, 3), (2, 4), (9, 1), (10, 1)])]
    rows += [("b", 100 + i, 7 * i, 7) for i in range(4)]
    df = spark.createDataFrame(rows, "ident string, arrival bigint, flow_sequence bigint, flow_count bigint")
    got = {r.ident: (r.headers, r.failures) for r in upkeep.sequence_gaps(df).collect()}
    assert got == {"a": (5, 1), "b": (4, 0)}


def brute_retention(parts, now, max_life, max_size, low):
    parts, dropped = sorted(parts), set()
    total = sum(s for _, s in parts)
    size_done = not max_size or total < max_size
    life_done = not max_life or (now - parts[0][0]).total_seconds() < max_life
    for day, size in parts:
        if not size_done:
            if total > low * max_size // 100:
                total -= size
                dropped.add((day, "size"))
                continue
            size_done = True
        if not life_done:
            if (now - day).total_seconds() > max_life * low // 100:
                dropped.add((day, "age"))
            else:
                life_done = True
    return dropped


@pytest.mark.parametrize("life_days,size,low", [(0, 0, 95), (10, 0, 95), (0, 500, 50), (12, 400, 60), (100, 10**6, 95), (5, 100, 95)])
def test_retention(spark, life_days, size, low):
    rng = random.Random(3)
    parts = [(datetime(2024, 1, d), rng.randint(1, 99)) for d in range(1, 21)]
    now = datetime(2024, 1, 25)
    df = spark.createDataFrame(parts, "day timestamp_ntz, size bigint")
    got = {(r.at, r.reason) for r in upkeep.retention_plan(df, now, life_days * 86400, size, low).collect()}
    assert got == brute_retention(parts, now, life_days * 86400, size, low)


@pytest.mark.parametrize("accuracy", [10, 100_000])
def test_exact_median(spark, accuracy):
    rng = random.Random(5)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(501)], "even": [rng.random() for _ in range(400)], "one": [7.0],
        "two": [1.0, 4.0], "ties": [1.0] * 300 + [2.0] * 300, "hot": [5.0] * 1000 + [rng.random() for _ in range(99)],
        "tail": [10.0 ** rng.randint(-9, 9) for _ in range(600)], "none": [None, None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", accuracy=accuracy).collect()}
    assert got == {g: pytest.approx(statistics.median(vs)) for g, vs in groups.items() if vs[0] is not None}


ROWS = [[1.0, 2.0, None, 4.0], [-3.0, 0.5, 8.0, 2.0], [None, None, None, None], [0.0, 0.0, 0.0, 0.0], [5.0, None, 7.0, -1.0]]


def rows_of(spark):
    return spark.createDataFrame([(i, r) for i, r in enumerate(ROWS)], "i int, features array<double>")


def matrix(df):
    return np.array([[np.nan if v is None else v for v in r.features] for r in df.orderBy("i").collect()])


def test_row_transforms(spark):
    df, m = rows_of(spark), np.array([[np.nan if v is None else v for v in r] for r in ROWS])
    with np.errstate(all="ignore"), pytest.warns(RuntimeWarning):
        logs = np.where(m > 0, np.log2(np.where(m > 0, m, 1)), np.nan)
        means, medians = np.nanmean(m, 1, keepdims=True), np.nanmedian(m, 1, keepdims=True)
        col_means, col_medians = np.nanmean(m, 0), np.nanmedian(m, 0)
        norms = np.sqrt(np.nansum(m * m, 1, keepdims=True))
        col_norms = np.sqrt(np.nansum(m * m, 0))
        unit = np.where(norms > 0, m / norms, m)
    apply = lambda e: matrix(df.withColumn("features", e))
    np.testing.assert_allclose(apply(FE.log2_transform("features")), logs)
    np.testing.assert_allclose(apply(FE.center_row("features")), m - means)
    np.testing.assert_allclose(apply(FE.center_row("features", "median")), m - medians)
    np.testing.assert_allclose(apply(FE.normalize_row("features")), unit)
    np.testing.assert_allclose(matrix(FE.center_columns(df)), m - col_means)
    np.testing.assert_allclose(matrix(FE.center_columns(df, method="median")), m - col_medians)
    np.testing.assert_allclose(matrix(FE.normalize_columns(df)), m / col_norms)


def test_row_filter(spark):
    df = rows_of(spark)
    kept = lambda **kw: [r.i for r in df.filter(FE.row_filter("features", **kw)).orderBy("i").collect()]
    assert kept(percent=75) == [0, 1, 3, 4] and kept(percent=76) == [1, 3]
    assert kept(std=1.0) == [0, 1, 4] and kept(std=5) == []
    assert kept(abs_value=4.0, abs_count=1) == [0, 1, 4] and kept(abs_value=5.0, abs_count=2) == [4]
    assert kept(max_min=8.0) == [1, 4] and kept() == [0, 1, 2, 3, 4]


def test_distances(spark):
    x, y, w = [1.0, 2.0, None, 4.0], [2.0, 0.0, 5.0, 3.0], [1.0, 2.0, 3.0, 0.5]
    df = spark.createDataFrame([(x, y, [None] * 4, [3.0] * 4)], "x array<double>, y array<double>, n array<double>, c array<double>")
    a, b, ww = np.array([1.0, 2.0, 4.0]), np.array([2.0, 0.0, 3.0]), np.array([1.0, 2.0, 0.5])
    sw = ww.sum()
    cov = (ww * a * b).sum() - (ww * a).sum() * (ww * b).sum() / sw
    va = (ww * a * a).sum() - (ww * a).sum() ** 2 / sw
    vb = (ww * b * b).sum() - (ww * b).sum() ** 2 / sw
    r, u = cov / np.sqrt(va * vb), (ww * a * b).sum() / np.sqrt((ww * a * a).sum() * (ww * b * b).sum())
    want = {
        "euclid": (ww * (a - b) ** 2).sum() / sw, "cityblock": (ww * abs(a - b)).sum() / sw, "correlation": 1 - r,
        "abs_correlation": 1 - abs(r), "uncentered": 1 - u, "abs_uncentered": 1 - abs(u),
    }
    for m in FE.METRICS:
        d, none, flat = df.select(
            FE.distance(F.col("x"), F.col("y"), m, w), FE.distance(F.col("x"), F.col("n"), m), FE.distance(F.col("c"), F.col("y"), m)
        ).first()
        assert d == pytest.approx(want[m]) and none == 0.0
        if "correlation" in m:
            assert flat == 1.0


@pytest.mark.parametrize("metric", ["euclid", "cityblock"])
def test_distances_without_weights_are_plain_sums(spark, metric):
    df = spark.sql("SELECT * FROM VALUES (array(1.5D, 2D, NULL), array(0D, NULL, 3D)), (array(0.1D, 0.7D), array(1.1D, 2.7D, 9.3D)), (NULL, array(1D)), (array(NULL), array(1D)) t(x, y)")
    out = df.select(FE.distance(F.col("x"), F.col("y"), metric).alias("d"))
    plain = df.select(FE.distance(F.col("x"), F.col("y"), metric, [1.0] * 3)).collect()
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in plain]
    assert "arrays_zip" not in df.select(FE.distance(F.col("x"), F.col("y"), metric))._jdf.queryExecution().analyzed().toString()


def test_clusters_and_components(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 5]], dtype=float)
    data = [(int(i), [float(v) for v in centres[i % 3] + rng.normal(0, 0.1, 3)]) for i in range(60)]
    df = spark.createDataFrame(data, "i int, features array<double>")
    scored = FE.kmeans(df, 3, restarts=3)
    groups = {}
    for r in scored.collect():
        groups.setdefault(r.i % 3, set()).add(r.cluster)
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == 3
    far = FE.row_to_centre(scored, FE.centre_vectors(FE.cluster_centres(scored))).agg(F.max("distance"), F.count("*")).first()
    assert far[0] < 0.5 and far[1] == 60
    pcs = FE.principal_components(df, 2).orderBy("component").collect()
    m = np.array([d[1] for d in data])
    values, vectors = np.linalg.eigh(np.cov(m.T))
    for i, r in enumerate(pcs):
        assert abs(np.dot(r.loadings, vectors[:, -1 - i])) == pytest.approx(1.0, abs=1e-6)
        assert r.explained_variance == pytest.approx(values[-1 - i] / values.sum())
    assert len(FE.project_components(df, 2).first().coordinates) == 2


def test_kmeans_steps_over_blocks(spark, monkeypatch):
    given = []

    class Recorded(FE.KMeans):
        def _fit(self, data):
            given.append((self.getSolver(), data.is_cached, data.columns))
            return super()._fit(data)

    monkeypatch.setattr(FE, "KMeans", Recorded)
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(20)], "i int, features array<double>")
    found = FE.kmeans(df, 2, restarts=2).collect()
    assert given == [("block", False, ["_vec"])] * 2
    assert len({(r.i % 2, r.cluster) for r in found}) == 2 and all(r.within_cost == 0 for r in found)


def test_clusters_with_missing_values_and_medians(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [None if k == 0 and rng.random() < 0.3 else float(v) for k, v in enumerate(np.array([0, 5, -5]) * (i % 3) + rng.normal(0, 0.2, 3))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, features array<double>")
    for scored in (FE.kmeans(df, 3, restarts=6), FE.k_clusters(df, 3, "median", "cityblock", restarts=6)):
        found = scored.collect()
        groups = {}
        for r in found:
            groups.setdefault(r.i % 3, set()).add(r.cluster)
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == 3
        assert all(r.converged and r.within_cost > 0 for r in found)
    with pytest.raises(RuntimeError):
        FE.k_clusters(df, 3, max_iter=1)


@pytest.mark.parametrize("listed", [200_000, 0])
def test_steps_over_blocks_as_plain_ones(spark, monkeypatch, listed):
    monkeypatch.setattr(centres, "LISTED", listed)  # none: bounds are narrowed until they rest
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (300, 5)), 1) * [1, 1, 1e6, 0, 1]
    x[:, 4] = np.where(rng.random(300) < 0.5, -1.0, 1.0)  # two far values, as many of each at times
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)] + [(300, None)]
    df = spark.createDataFrame(rows, "i int, features array<double>").repartition(3)
    blocks = centres.Blocks(df, "features")
    old = np.array([[0.0] * 5, [1.0, np.nan, 2e5, 0.0, 1.0], [1e9] * 5])
    extent = blocks.extent()
    assert np.array_equal(extent[0], np.nanmin(x, 0)) and np.array_equal(extent[1], np.nanmax(x, 0))
    for metric in FE.METRICS:
        d = np.stack([centres.distances(x.T, c, metric) for c in old])
        near = d.argmin(0)
        cols = [F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in c]) for c in old]
        plain = df.filter("i < 300").orderBy("i").select(*[FE.distance(F.col("features"), c, metric) for c in cols]).collect()
        assert np.array_equal(d.T, np.array([tuple(r) for r in plain]))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            mean, middle = (np.stack([f(x[near == c], 0) for c in range(3)]) for f in (np.nanmean, np.nanmedian))
        cost, got = blocks.means(old, metric)
        assert cost == pytest.approx(d.min(0).sum()) and np.allclose(got, mean, equal_nan=True)
        guesses = ((-9.0, 9e7), (0.3, 0.4), (1e8, 1e9), (0.0, 0.0))
        for low, high in guesses if metric == "cityblock" else guesses[:1]:
            cost, got = blocks.medians(old, metric, np.full((3, 5), low), np.full((3, 5), high), extent)
            assert cost == pytest.approx(d.min(0).sum()) and np.array_equal(got, middle, equal_nan=True)
    blocks.drop()


def test_clusters_of_copies_start_apart(spark):
    points = [[0.0, 0.0], [0.0, 9.0], [9.0, 0.0], [9.0, 9.0]]
    rows = [(i, points[0 if i < 90 else i % 4]) for i in range(100)] + [(100, [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, features array<double>")
    for seed in range(1, 4):
        found = FE.k_clusters(df, 4, "median", "cityblock", seed=seed).collect()
        assert len(found) == 101 and len({r.cluster for r in found}) == 4
        assert all(r.within_cost == 0 and r.converged for r in found)
    # fewer different vectors than clusters: one cluster for each
    assert len({r.cluster for r in FE.k_clusters(df, 6, "median", "cityblock").collect()}) == 4


def test_median_steps_take_one_pass_where_few_values_are_near(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (3000, 3)).astype(np.float32).astype(float)
    x[:, 2] = rng.normal(0, 1, 3000)  # not exact in four bytes
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, features array<double>").repartition(2)
    blocks = centres.Blocks(df, "features")
    passes, plain = [], centres.Blocks._run
    monkeypatch.setattr(centres.Blocks, "_run", lambda self, *a, **k: (passes.append(1), plain(self, *a, **k))[1])
    old = np.array([[0.0, 0.0, 0.0], [0.5, -0.5, 1.0]])
    near = np.stack([centres.distances(x.T, c, "cityblock") for c in old]).argmin(0)
    middle = np.stack([np.median(x[near == c], 0) for c in range(2)])
    got = blocks.medians(old, "cityblock", middle - 0.1, middle + 0.1, blocks.extent())[1]
    assert np.array_equal(got, middle) and len(passes) == 1
    # where a task meets too many, the bounds are narrowed first
    monkeypatch.setattr(centres, "LISTED", 100)
    got = blocks.medians(old, "cityblock", middle - 0.1, middle + 0.1, blocks.extent())[1]
    assert np.array_equal(got, middle) and len(passes) > 2
    blocks.drop()
