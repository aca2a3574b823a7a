"""Metrics against brute force and against identities."""

from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import at, make_flows
from flowtide.metrics import centroid, divergence, entropy, flooding, frequency, handshake, momentum
from flowtide.plans import registry
from flowtide.plans.slots import slot_width

WIDTH = "1 minute"


def random_flows(seed: int, n: int, slots: int, hosts: int = 5):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        first = at(60 * rng.choice([s for s in range(slots) if s % 4 != 2]) + rng.randrange(60))
        rows.append(
            {
                "first_ts": first, "last_ts": first, "src_addr": rng.randrange(hosts), "dst_addr": rng.randrange(hosts),
                "src_port": rng.randrange(3), "dst_port": rng.randrange(3), "tcp_flags": rng.randrange(80),
                "packets": rng.randrange(1, 9), "bytes": rng.randrange(40, 60), "prot": rng.choice([6, 17]),
            }
        )
    return rows


def slot_of(row):
    return row["first_ts"].replace(second=0)


# --- handshakes -----------------------------------------------------------------


def brute_handshakes(rows, delay=100):
    """The double loop over flows and reverse flows, slot by slot."""
    def flag(f, bit):
        return f <= 63 and f & bit

    out = {}
    by_slot = defaultdict(list)
    for r in rows:
        by_slot[slot_of(r)].append(r)
    for slot, members in by_slot.items():
        conns = defaultdict(list)
        for r in members:
            conns[r["src_addr"], r["dst_addr"]].append(r)
        c = Counter(flows=len(members), syn_flows=sum(1 for r in members if flag(r["tcp_flags"], 2)))
        for (s, d), fwd in conns.items():
            rev = conns.get((d, s))
            for r in fwd:
                f = r["tcp_flags"]
                if not flag(f, 2) or flag(f, 16) or rev is None:
                    continue
                answers = [x for x in rev if flag(x["tcp_flags"], 2) and flag(x["tcp_flags"], 16)]
                c["syn_synack" if answers else "syn_no_answer"] += 1
                c["syn_server_reset"] += any(flag(x["tcp_flags"], 4) for x in rev)
                client_reset = any(flag(x["tcp_flags"], 4) for x in fwd)
                acked = any(flag(x["tcp_flags"], 16) for x in fwd)
                for x in rev:
                    if x in answers:
                        c["syn_synack_client_reset"] += client_reset
                        c["complete" if acked else "incomplete"] += 1
                    else:
                        c["incomplete"] += 1
        out[slot] = c
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_handshakes_match_the_double_loop(spark, seed):
    rows = random_flows(seed, 300, 6)
    got = handshake.handshake_counts(make_flows(spark, rows), WIDTH).collect()
    want = brute_handshakes(rows)
    assert len(got) == len(want)
    for r in got:
        for name in set(r.asDict()) - {"slot"}:
            assert r[name] == want[r.slot][name], (r.slot, name)


def test_handshake_scenarios(spark):
    a, b, c, d, e = range(5)
    rows = [
        # full handshake a-b
        dict(src_addr=a, dst_addr=b, tcp_flags=2), dict(src_addr=b, dst_addr=a, tcp_flags=18), dict(src_addr=a, dst_addr=b, tcp_flags=16),
        # SYN answered by a reset c-d
        dict(src_addr=c, dst_addr=d, tcp_flags=2), dict(src_addr=d, dst_addr=c, tcp_flags=4),
        # SYN without any reverse
        dict(src_addr=e, dst_addr=a, tcp_flags=2),
        # flags above 63 are no SYN
        dict(src_addr=b, dst_addr=c, tcp_flags=66), dict(src_addr=c, dst_addr=b, tcp_flags=66),
    ]
    r = handshake.handshake_counts(make_flows(spark, rows), WIDTH).first()
    assert (r.syn_flows, r.syn_no_answer, r.syn_server_reset, r.syn_synack, r.syn_synack_client_reset) == (4, 1, 1, 1, 0)
    assert (r.complete, r.incomplete) == (1, 1)
    # with a delay after the data's times no answer counts
    late = handshake.handshake_counts(make_flows(spark, rows), WIDTH, delay=4_000_000_000).first()
    assert (late.syn_no_answer, late.syn_synack) == (2, 0)


def test_v6_pairs_do_not_meet_v4(spark):
    rows = [
        dict(src_addr=1, dst_addr=2, tcp_flags=2),
        dict(is_v6=True, src_hi=0, src_lo=2, dst_hi=0, dst_lo=1, tcp_flags=18),
        dict(is_v6=True, src_hi=-5, src_lo=2, dst_hi=7, dst_lo=1, tcp_flags=2),
        dict(is_v6=True, src_hi=7, src_lo=1, dst_hi=-5, dst_lo=2, tcp_flags=18),
    ]
    df = make_flows(spark, rows)
    r = handshake.handshake_counts(df, WIDTH).first()
    assert (r.syn_synack, r.syn_no_answer) == (1, 0)
    pairs = handshake.reverse_pairs(handshake.pair_table(df, WIDTH)).collect()
    assert {(p.src_hi, p.dst_hi, p.src_addr) for p in pairs} == {(-5, 7, None), (7, -5, None)}
    assert {r.n for r in frequency.frequency(df, "src", WIDTH).collect()} == {1}


def slots_from(spark, values, column, kind):
    rows = [(at(60 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"slot timestamp_ntz, {column} {kind}")


@pytest.mark.parametrize("lows", ["11", "111", "111111", "1111111", "0110111011110111111", "1" * 10])
def test_syn_flood_streaks(spark, lows):
    """The alarm comes with every third low slot of a run."""
    counts = spark.createDataFrame(
        # all in one class: entropy 0; spread over two: entropy 1
        [(at(60 * i), 4, 0, 0 if c == "1" else 4, 0) for i, c in enumerate(lows)],
        "slot timestamp_ntz, syn_no_answer bigint, syn_server_reset bigint, syn_synack bigint, syn_synack_client_reset bigint",
    )
    got = [r.alarm for r in handshake.syn_flood_of(counts, WIDTH).orderBy("slot").collect()]
    want, violations = [], 0
    for c in lows:
        violations = violations + 1 if c == "1" else 0
        want.append(int(violations == 3))
        violations = 0 if violations == 3 else violations
    assert got == want


# --- entropy and divergence --------------------------------------------------------


def test_entropy_identities(spark):
    rows = [dict(src_addr=i % 8, dst_addr=1, first_ts=at(0)) for i in range(64)]
    df = make_flows(spark, rows)
    uniform = entropy.entropy(df, "src", WIDTH).first()
    assert uniform.entropy == pytest.approx(3.0) and uniform.alarm == 0
    one = entropy.entropy(df, "dst", WIDTH).first()
    assert one.entropy == 0.0 and one.alarm == 1


def brute_divergence(cur: Counter, prev: Counter, alpha=5):
    common = set(cur) & set(prev)
    if not common:
        return 0, 0.0, 0.0
    cs, ps = sum(cur[k] for k in common), sum(prev[k] for k in common)
    kl = sum(cur[k] / cs * math.log((cur[k] / cs) / (prev[k] / ps)) for k in common)
    inner = sum((cur[k] / cs) ** alpha / (prev[k] / ps) ** (alpha - 1) for k in common)
    return len(common), kl, math.log(inner) / (alpha - 1)


def test_divergence_against_definition(spark):
    rows = random_flows(5, 400, 9, hosts=9)
    out = divergence.divergences(make_flows(spark, rows), WIDTH)
    got = {(r.key, r.slot): r for r in out.collect()}
    fields = {
        "src": ("src_addr",), "dst": ("dst_addr",), "src_sport": ("src_addr", "src_port"),
        "dst_dport": ("dst_addr", "dst_port"), "pkts_bytes": ("packets", "bytes"),
        "src_sport_dst_dport": ("src_addr", "src_port", "dst_addr", "dst_port"),
    }
    for key, cols in fields.items():
        tables = defaultdict(Counter)
        for r in rows:
            tables[slot_of(r)][tuple(r[c] for c in cols)] += 1
        prev = Counter()
        for i, slot in enumerate(sorted(tables)):
            n, kl, renyi = brute_divergence(tables[slot], prev)
            r = got[key, slot]
            assert r.common_keys == n
            assert r.kl == pytest.approx(kl, abs=1e-9) and r.renyi == pytest.approx(renyi, abs=1e-9)
            assert r.kl > -1e-9 and r.renyi > r.kl - 1e-9
            assert r.kl_alarm == int(i > 0 and kl >= 1.80) and r.renyi_alarm == int(i > 0 and renyi >= 2.70)
            prev = tables[slot]


def test_divergence_special_slots(spark):
    rows = []
    for slot, hosts in enumerate([[1, 1, 2], [1, 1, 2], [3, 4], [4, 5, 5, 5]]):
        rows += [dict(src_addr=h, dst_addr=0, first_ts=at(60 * slot)) for h in hosts]
    # a gap: the slot before is the last one with flows
    rows += [dict(src_addr=5, dst_addr=0, first_ts=at(60 * 50)), dict(src_addr=4, dst_addr=0, first_ts=at(60 * 50))]
    out = divergence.divergences(make_flows(spark, rows), WIDTH, ("src",)).orderBy("slot").collect()
    assert [r.common_keys for r in out] == [0, 2, 0, 1, 2]
    assert out[1].kl == pytest.approx(0) and out[1].renyi == pytest.approx(0)
    assert out[2].kl == 0 and out[3].kl == pytest.approx(0)
    want = 0.5 * math.log(0.5 / 0.25) + 0.5 * math.log(0.5 / 0.75)
    assert out[4].kl == pytest.approx(want)


# --- momentum ----------------------------------------------------------------------


def brute_stock(packets, m_limit, roc_limit, rsi_limit, need=3):
    """Slot by slot, with the counters a live run would hold."""
    out, violations, dead = [], 0, False
    for i, n1 in enumerate(packets):
        n2 = packets[i - 1] if i >= 1 else None
        n3 = packets[i - 2] if i >= 2 else None
        m = 100 * (n1 - n2) / n2 if n2 else 0.0
        gains = [b - a for a, b in zip(packets[1 : i + 1], packets[2 : i + 1]) if b >= a]
        losses = [a - b for a, b in zip(packets[1 : i + 1], packets[2 : i + 1]) if b < a]
        rsi = 0.0
        if gains and losses:
            g = (sum(gains) / len(gains) * i + max(n1 - n2, 0)) / (i + 1)
            l = (sum(losses) // len(losses) * i + max(n2 - n1, 0)) / (i + 1)
            rsi = 100 - 100 / (1 + g / l)
        roc = prev = 0.0
        alarm = 0
        if m >= m_limit and n3 is not None:
            roc, prev = (n1 / n2 if n2 else 0.0), (n2 / n3 if n3 else 0.0)
            if roc >= roc_limit and prev >= roc_limit:
                violations += 1
            else:
                violations, dead = 0, False
            if violations == need and not dead:
                if rsi >= rsi_limit:
                    alarm, violations = 1, 0
                else:
                    dead = True
        out.append((m, roc, prev, rsi, alarm))
    return out


SERIES = {
    "rising": [10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120],
    "falling": [900, 800, 650, 500, 300, 299, 100],
    "flat": [5] * 6,
    "zeros": [0, 0, 5, 0, 7, 7, 0],
    "mixed": [100, 90, 95, 200, 410, 390, 800, 1700, 3500, 3400, 7000, 15000, 31000, 64000, 128000, 260000, 600000],
    "wild": [random.Random(8).randint(50, 200) for _ in range(40)],
}


@pytest.mark.parametrize("name", SERIES)
@pytest.mark.parametrize("limits", [(40.0, 1.9, 70.0), (-100.0, 0.8, 50.0)])
def test_stock_market(spark, name, limits):
    slots = slots_from(spark, SERIES[name], "packets", "bigint")
    got = momentum.stock_market_of(slots, WIDTH, *limits).orderBy("slot").collect()
    for r, (m, roc, prev, rsi, alarm) in zip(got, brute_stock(SERIES[name], *limits)):
        assert (r.momentum, r.roc, r.roc_prev) == pytest.approx((m, roc, prev))
        assert r.rsi == pytest.approx(rsi)
        assert r.alarm == alarm, r


def test_stock_alarms_do_fire():
    fired = [sum(x[4] for x in brute_stock(s, *limits)) for s in SERIES.values() for limits in [(40.0, 1.9, 70.0), (-100.0, 0.8, 50.0)]]
    assert max(fired) >= 1


# --- flooding, centroids, slots ------------------------------------------------------


@pytest.mark.parametrize("limits,level", [
    ((10**9, 9, 9, 0), 0), ((1, 0.5, 9, 0), 1), ((1, 9, 0.5, 0), 2), ((1, 9, 9, 10**6), 3), ((1, 9, 9, 0), 4),
])
def test_flooding_levels(spark, limits, level):
    rows = [dict(dst_addr=i % 4, src_port=i % 4, packets=30) for i in range(16)]
    r = flooding.flooding_level(make_flows(spark, rows), WIDTH, *limits).first()
    assert (r.level, r.packets, r.packets_per_s) == (level, 480, 8.0)
    assert r.entropy_dst == pytest.approx(2) and r.entropy_src_port == pytest.approx(2)


def test_centroid_of_absent_protocol(spark):
    rows = [dict(prot=17, src_port=1, packets=2, bytes=9)]
    profile = centroid.proto_port_profile(make_flows(spark, rows), WIDTH)
    r = centroid.centroid_distance(centroid.traffic_centroid(profile, 6), 6).first()
    assert r.ln_packets is None and r.distance is None and r.alarm == 0
    u = centroid.centroid_distance(centroid.traffic_centroid(profile, 17), 17).first()
    assert u.distance == pytest.approx(abs(0.2 - math.log(2)) + abs(4.0 - math.log(9)) + 0.5)


def test_slot_width_rule():
    assert [slot_width(t) for t in (1, 9, 10, 59, 60, 300, 3599)] == ["1 second"] * 2 + ["10 seconds"] * 2 + ["1 minute"] * 3
    for bad in (0, 3600, -1):
        with pytest.raises(ValueError):
            slot_width(bad)


def test_frequencies_equal_single_keys(spark):
    df = make_flows(spark, random_flows(6, 200, 5)).cache()
    together = frequency.frequencies(df, WIDTH)
    for key, cols in frequency.FREQUENCY_KEYS.items():
        alone = frequency.frequency(df, key, WIDTH).select("slot", *cols, "n")
        mine = together.filter(F.col("key_id") == frequency.KEY_IDS[key]).select("slot", *cols, "n")
        assert sorted(map(repr, alone.collect())) == sorted(map(repr, mine.collect()))


# --- registry ------------------------------------------------------------------------


def test_registry_order_and_errors(spark):
    assert registry.resolve(["kl_entropy_product"])[-1] == "kl_entropy_product"
    order = registry.resolve(["kl_entropy_product", "renyi"])
    assert order.index("divergences") < order.index("kl") < order.index("kl_entropy_product")
    df = make_flows(spark, random_flows(7, 40, 3))
    with pytest.raises(KeyError):
        registry.metric_run(df, ["nothing"], WIDTH)
    with pytest.raises(ValueError):
        registry.metric_run(df, [{"name": "kl", "deps": ["entropy"]}], WIDTH)
    registry.metric("loop_a", deps=["loop_b"])(lambda ctx: None)
    registry.metric("loop_b", deps=["loop_a"])(lambda ctx: None)
    try:
        with pytest.raises(ValueError):
            registry.resolve(["loop_a"])
    finally:
        del registry.METRICS["loop_a"], registry.METRICS["loop_b"]


def test_metric_run_shares_and_releases(spark):
    df = make_flows(spark, random_flows(7, 80, 5))
    run = registry.metric_run(df, ["entropy", "kl", "ddos_test", {"name": "syn_flood", "threshold": 1.0}, "flooding_level", "stock_market", "centroid", "bytes", "flows"], WIDTH)
    assert run._context.shared == {"frequencies", "handshakes"}
    slots = run["flows"].count()
    for name in ("entropy", "kl", "ddos_test", "syn_flood", "flooding_level", "stock_market", "centroid", "bytes"):
        assert run[name].count() == slots, name
    shared = run._context.table("frequencies")
    assert not shared.is_cached and all(os.path.exists(f.removeprefix("file://")) for f in shared.inputFiles())
    files = shared.inputFiles()
    run.release()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
