"""User-defined metrics and metric runs.

    @metric("product", deps=["entropy", "kl"], uses=["frequencies"])
    def product(ctx):
        return ctx.result("entropy").join(ctx.result("kl"), "slot") ...

A metric takes a context and returns a DataFrame keyed by `slot`. The context gives it the
flows, the shared tables and the results of the metrics it depends on. A shared table that
several chosen metrics use is written to the shared folder once per run and deleted with the run.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Callable

from pyspark.sql import DataFrame

from flowtide.metrics import divergence, entropy, flooding, frequency, handshake, momentum
from flowtide.metrics import centroid
from flowtide.plans.slots import calendar, with_slot
from flowtide.session import drop_held, hold


@dataclass(frozen=True)
class Metric:
    name: str
    fn: Callable[["Context"], DataFrame]
    deps: tuple[str, ...] = ()
    uses: tuple[str, ...] = ()


METRICS: dict[str, Metric] = {}


def metric(name: str, deps=(), uses=()):
    """Register a metric; `deps` are metrics, `uses` shared tables it asks the context for."""

    def register(fn):
        METRICS[name] = Metric(name, fn, tuple(deps), tuple(uses))
        return fn

    return register


SHARED: dict[str, Callable[["Context"], DataFrame]] = {
    "frequencies": lambda ctx: frequency.frequencies(ctx.flows, ctx.width),
    "handshakes": lambda ctx: handshake.handshake_counts(ctx.flows, ctx.width),
    "profile": lambda ctx: centroid.proto_port_profile(ctx.flows, ctx.width),
    "calendar": lambda ctx: calendar(ctx.flows, ctx.width),
}


@dataclass
class Context:
    flows: DataFrame
    width: str
    parameters: dict[str, dict] = field(default_factory=dict)
    shared: set[str] = field(default_factory=set)
    _tables: dict[str, DataFrame] = field(default_factory=dict)
    _results: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            df = SHARED[name](self)
            self._tables[name] = hold(df, f"run-{name}") if name in self.shared else df
        return self._tables[name]

    def result(self, name: str) -> DataFrame:
        """The result of a metric of the run, computed when it is first asked for."""
        if name not in self._results:
            self._results[name] = METRICS[name].fn(self)
        return self._results[name]

    def params(self, name: str) -> dict:
        return self.parameters.get(name, {})


@dataclass
class MetricRun:
    order: list[str]
    _context: Context

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.order:
            raise KeyError(f"not in this run: {name}")
        return self._context.result(name)

    @property
    def results(self) -> dict[str, DataFrame]:
        """All results, dependencies first."""
        return {name: self[name] for name in self.order}

    def release(self) -> None:
        """Delete the tables the run wrote for its metrics; call it after the results were written.

        Nothing of a run is held on executors, and what is not released goes with the application.
        """
        for name in self._context.shared & set(self._context._tables):
            drop_held(self._context._tables[name])


def resolve(names) -> list[str]:
    """The chosen metrics and everything they depend on, dependencies first.

    Unknown names and cycles are errors.
    """
    graph, todo = {}, list(names)
    while todo:
        name = todo.pop()
        if name in graph:
            continue
        if name not in METRICS:
            raise KeyError(f"unknown metric: {name}")
        graph[name] = METRICS[name].deps
        todo.extend(METRICS[name].deps)
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"metrics depend on each other: {e.args[1]}") from e


def metric_run(flows: DataFrame, metrics, width: str) -> MetricRun:
    """Compute metrics by name, or by config dicts {"name": ..., "deps": [...], parameters...}.

    `deps` in a config must agree with the registered ones; other entries are passed on as
    the metric's parameters. A result is computed when it is taken from the run, so a metric
    that nobody reads costs nothing; tables that several metrics of the run use are written once.
    """
    parameters, names = {}, []
    for m in metrics:
        config = {"name": m} if isinstance(m, str) else dict(m)
        name = config.pop("name")
        if name not in METRICS:
            raise KeyError(f"unknown metric: {name}")
        deps = config.pop("deps", None)
        if deps is not None and set(deps) != set(METRICS[name].deps):
            raise ValueError(f"{name} depends on {METRICS[name].deps}, config says {tuple(deps)}")
        names.append(name)
        parameters[name] = config
    order = resolve(names)
    uses = Counter(t for n in order for t in METRICS[n].uses)
    ctx = Context(
        with_slot(flows, width), width, parameters, {t for t, k in uses.items() if k > 1}
    )
    return MetricRun(order, ctx)


# --- the built-in metrics ---------------------------------------------------------


@metric("bytes")
def _bytes(ctx):
    return frequency.bytes_per_slot(ctx.flows, ctx.width)


@metric("flows")
def _flows(ctx):
    return frequency.flows_per_slot(ctx.flows, ctx.width)


@metric("entropy", uses=["frequencies"])
def _entropy(ctx):
    return entropy.entropies_of(ctx.table("frequencies"), **ctx.params("entropy"))


@metric("divergences", uses=["frequencies", "calendar"])
def _divergences(ctx):
    return divergence.divergences_of(ctx.table("frequencies"), ctx.table("calendar"), **ctx.params("divergences"))


@metric("kl", deps=["divergences"])
def _kl(ctx):
    return divergence.wide(ctx.result("divergences"), "kl")


@metric("renyi", deps=["divergences"])
def _renyi(ctx):
    return divergence.wide(ctx.result("divergences"), "renyi")


@metric("kl_entropy_product", deps=["entropy", "kl"])
def _product(ctx):
    return divergence.kl_entropy_product(ctx.result("entropy"), ctx.result("kl"))


@metric("syn_flood", uses=["handshakes"])
def _syn_flood(ctx):
    return handshake.syn_flood_of(ctx.table("handshakes"), ctx.width, **ctx.params("syn_flood"))


@metric("ddos_test", uses=["handshakes"])
def _ddos(ctx):
    return handshake.ddos_test_of(ctx.table("handshakes"), **ctx.params("ddos_test"))


@metric("flooding_level")
def _flooding(ctx):
    return flooding.flooding_level(ctx.flows, ctx.width, **ctx.params("flooding_level"))


@metric("stock_market")
def _stock(ctx):
    return momentum.stock_market(ctx.flows, ctx.width, **ctx.params("stock_market"))


@metric("centroid", uses=["profile"])
def _centroid(ctx):
    p = ctx.params("centroid")
    prot = p.get("prot", 6)
    return centroid.centroid_distance(centroid.traffic_centroid(ctx.table("profile"), prot), **{"prot": prot, **p})
