"""Physical plans: what must and must not appear in them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import make_flows
from flowtide.catalog import QUERIES
from flowtide.metrics import divergence, entropy, frequency, handshake
from flowtide.operators import aggregate as AG, joins, predicates as P, ranking, statistics as ST
from flowtide.plans.slots import calendar, previous_slot, slot
from flowtide.sources import files
from flowtide.sources.derived import load_flows

# filters and single statistics look alike; streams and writers run jobs when they are built; their plans only read a result back
PLANNED = [n for n in sorted(QUERIES) if not n.startswith(("filter_", "stat_", "stream_", "stored_", "exported_", "kmeans", "principal"))]


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> str:
    """The plan after adaptive execution."""
    df.collect()
    return planned(df).split("\n+- == Initial Plan ==")[0]


@pytest.fixture
def stored(spark, flows, tmp_path):
    files.write_flows(flows, str(tmp_path / "flows"))
    return files.read_flows(spark, str(tmp_path / "flows"))


def test_no_query_sorts_to_aggregate_or_pairs_everything(spark, sf_dir):
    for name in PLANNED:
        plan = planned(QUERIES[name](spark, sf_dir))
        for bad in ("SortAggregate", "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
            assert bad not in plan, (name, bad)


def test_windows_over_everything_only_see_blocks(spark, sf_dir):
    """A window without partition is fed by the one-row-per-block tables, never by flows."""
    built = {name: QUERIES[name](spark, sf_dir) for name in ("late_flows", "stock_market", "syn_flood", "retention_plan_by_size")}
    slots = load_flows(spark, sf_dir).groupBy(slot("1 day").alias("slot")).count()
    built["previous_slot"] = previous_slot(slots, {"prev_slot": F.col("slot")}, "1 day")
    for name, df in built.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        firsts = re.findall(r"windowspecdefinition\(([^,]*),", plan)
        assert firsts
        for first in firsts:
            # a specification that starts with its order has no partition
            assert not re.search(r" (ASC|DESC) ", first) or first.startswith("_blk"), (name, first)


@pytest.mark.parametrize("name", ["stock_market", "syn_flood"])
def test_series_read_the_flows_once(spark, sf_dir, name):
    """All parts of a series' plan share one shuffle of the counts per slot; nothing is written between them."""
    plan = executed(QUERIES[name](spark, sf_dir))
    assert plan.count("FileScan") == 1 and "events.parquet" in plan


def test_filters_and_columns_reach_the_scan(stored):
    df = stored.filter(P.proto("tcp") & P.port("=", 443, "dst")).groupBy("src_addr").agg(F.sum("bytes"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(prot,6\).*EqualTo\(dst_port,443\)", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["bytes", "dst_port", "prot", "src_addr"]
    net = stored.filter(P.net("10.0.0.0/30", direction="src")).select("flow_id")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(src_addr,167772160\)", planned(net))


@pytest.mark.parametrize("build,shuffles", [
    (lambda f: AG.aggregate_flows(f), 1),
    (lambda f: AG.aggregate_bidir(f), 1),
    (lambda f: ST.element_stats(f, "ip"), 1),
    (lambda f: ST.port_histogram(f), 1),
    (lambda f: handshake.pair_table(f, "1 day"), 1),
    (lambda f: handshake.handshake_counts(f, "1 day"), 2),
    (lambda f: entropy.entropy(f, "src", "1 day"), 2),
    (lambda f: entropy.entropies(f, "1 day"), 3),
    (lambda f: frequency.unique_counts(f, "1 day"), 2),
    (lambda f: frequency.bytes_per_slot(f, "1 day"), 1),
])
def test_one_scan_and_few_shuffles(stored, build, shuffles):
    plan = planned(build(stored))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange ") == shuffles
    assert "partial_" in plan


def test_divergence_reads_keys_once(stored):
    plan = executed(divergence.kl_divergence(stored, "1 day"))
    # the grouping sets over the keys appear once; the calendar is a per-slot table read back
    assert plan.count("Expand ") == 1 and "InMemoryTableScan" not in plan


def test_orders_share_one_aggregation(stored):
    top = ranking.top_elements(ST.element_stats(stored, "port"), ranking.ORDERS, 5)
    flows = ranking.top_flows(AG.aggregate_flows(stored), ranking.ORDERS, 5)
    for plan in (executed(top), executed(flows)):
        # one scan, and the n largest of a task before rows of one order meet
        assert plan.count("FileScan") == 1 and plan.count("WindowGroupLimit") == 2


def test_network_lists_match_distinct_addresses(spark, stored):
    nets = joins.network_table(spark, ["10.0.0.0/30", "10.0.0.9", "2001:db8::/32"])
    plan = planned(joins.in_networks(stored, nets, "src"))
    assert plan.count("LeftSemi") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_divergence_leaves_other_slots_out_before_it_sums(stored):
    freq, cal = frequency.frequencies(stored, "1 day", ("src",)), calendar(stored, "1 day")
    plan = divergence.common_key_sums(freq, cal)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    first = {word: min(i for i, line in enumerate(lines) if word in line) for word in ("Aggregate", "Join", "Window")}
    assert first["Aggregate"] < first["Join"] < first["Window"]


def test_no_result_leaves_a_persisted_table(spark, sf_dir):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("kl_divergence_six_keys", "renyi_divergence_six_keys", "syn_flood", "stock_market", "slot_calendar", "metric_run_with_dependencies", "kl_entropy_product"):
        QUERIES[name](spark, sf_dir).collect()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before, name


def test_limit_does_not_sort_everything(spark):
    plan = planned(ranking.limit_flows(make_flows(spark, [{}, {}]), 1))
    assert "TakeOrderedAndProject" in plan
