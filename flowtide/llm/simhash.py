"""SimHash near-duplicates, linked by a generalised pigeonhole join.

Fingerprints of 64 bits link when at most `radius` bits differ. The bits are dealt into parts,
correlated bits together. For thresholds t of the parts with sum(t) = radius - parts + 1, two
fingerprints within the radius differ by at most t bits in some part; a threshold of -1 leaves a
part out. Each fingerprint gets the thresholds with the fewest estimated candidates, by dynamic
programming over the parts, probes the index of each part with all values within its threshold,
and every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import numbered, stored
from flowtide.llm.components import components
from flowtide.llm.textbytes import NOT_WHITE, Words, words

#: words of a shingle
SHINGLE = 3
#: most differing bits of a link
RADIUS = 3
#: rows of one key that meet in a task; longer lists are dealt into blocks that meet pairwise
BLOCK = 2048
#: values of a part that count as frequent have at least this share of all fingerprints
FREQUENT = 1 / 512

_PAIRS = 1 << 21


# -- fingerprints ---------------------------------------------------------------------------


def _shingle_hashes(block: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all shingles of a block, text after text, and how many each text has."""
    from xxhash import xxh64_intdigest

    length = block.end - block.start
    # the words of the block, each followed by one blank
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    spaced = np.full(int(begin[-1]), 0x20, np.uint8)
    target = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    source = np.arange(int(length.sum())) + np.repeat(block.start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    spaced[target] = block.data[source]
    counts = block.counts
    shingles = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    # first and last word of each shingle
    first = np.arange(int(shingles.sum())) + np.repeat(block.first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles)
    last = first + np.repeat(np.minimum(counts, n) - 1, shingles)
    text = spaced.tobytes()
    bounds = zip(begin[first].tolist(), (begin[last] + length[last]).tolist())
    return np.fromiter((xxh64_intdigest(text[a:b], 42) for a, b in bounds), np.uint64, len(first)), shingles


def _fingerprints(block: Words, n: int) -> np.ndarray:
    hashes, shingles = _shingle_hashes(block, n)
    out = np.zeros(len(shingles), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        at = np.concatenate([[0], np.cumsum(shingles[full])])
        ones = np.zeros((len(full), 64), np.int64)
        step = 1 << 18
        # a long text's shingles are unpacked in pieces
        for lo in range(0, len(hashes), step):
            piece = hashes[lo : lo + step]
            bits = np.unpackbits(piece.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            a = int(np.searchsorted(at, lo, side="right")) - 1
            b = int(np.searchsorted(at, lo + len(piece), side="left"))
            ones[a:b] += np.add.reduceat(bits, np.maximum(at[a:b] - lo, 0), axis=0, dtype=np.int64)
        majority = (2 * ones > shingles[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Signed 64-bit SimHash of the lower-cased (A-Z) words of a text; 0 for null or no words."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        found = [_fingerprints(block, shingle) for block in words(texts, NOT_WHITE, lower=True)]
        return pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))

    return simhash(text)


def hex_text(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- parts and thresholds -------------------------------------------------------------------


@dataclass
class Parts:
    """Bits of each part, and what estimates of candidates need."""

    bits: list[list[int]]
    radius: int
    n: int
    frequent: list[tuple[np.ndarray, np.ndarray]]  # values of each part and their counts
    usual: list[float]  # fingerprints that share an infrequent value, on average
    spread: list[float]  # fingerprints per possible value, frequent ones left out

    def values(self, fps: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for k, bit in enumerate(self.bits[part]):
            out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        return out

    def candidates(self, values: np.ndarray, part: int) -> np.ndarray:
        """Estimated cost of thresholds -1 .. radius (columns) for each value."""
        known, counts = self.frequent[part]
        width = len(self.bits[part])
        cost = np.zeros((len(values), self.radius + 2))
        near = np.bitwise_count(values[:, None] ^ known[None, :]) if len(known) else np.zeros((len(values), 0), np.uint8)
        probes = 0
        for t in range(self.radius + 1):
            probes += comb(width, t)
            among_frequent = (counts[None, :] * (near <= t)).sum(1) if len(known) else np.zeros(len(values))
            own = np.where((near == 0).any(1) if len(known) else False, 0.0, self.usual[part])
            cost[:, t + 1] = probes + among_frequent + own + (probes - 1) * self.spread[part]
        return cost

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """For each fingerprint (rows) the thresholds of all parts with the least estimated cost.

        Dynamic programming: after part k, the best cost of every sum of thresholds + 1.
        """
        m, r = len(self.bits), self.radius
        total = r + 1  # sum of (t + 1) over all parts
        best = np.full((len(values[0]), total + 1), np.inf)
        best[:, 0] = 0
        choices = []
        for part in range(m):
            cost = self.candidates(values[part], part)
            after = np.full_like(best, np.inf)
            choice = np.zeros(best.shape, np.int8)
            for t in range(total + 1):
                for s in range(total + 1 - t):
                    new = best[:, s] + cost[:, t]
                    better = new < after[:, s + t]
                    after[better, s + t] = new[better]
                    choice[better, s + t] = t
            best = after
            choices.append(choice)
        out = np.zeros((len(values[0]), m), np.int8)
        left = np.full(len(values[0]), total)
        rows = np.arange(len(left))
        for part in reversed(range(m)):
            out[:, part] = choices[part][rows, left]
            left = left - out[:, part]
        return out - 1


def _co_occurrence(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits set, for each pair of bits; each task sends its sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            x = batch.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])

    found = fps.mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4096 rows at most
    out = np.zeros(64 * 64)
    for at, n in found:
        out[at] = n
    return out.reshape(64, 64)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into parts of equal size; each part takes the bits that correlate most with its own."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free = list(range(64))
    out = []
    for k in range(parts):
        size = len(free) // (parts - k)
        part = [free.pop(0)]
        while len(part) < size:
            nearest = max(free, key=lambda b: (correlation[b, part].mean(), -b))
            free.remove(nearest)
            part.append(nearest)
        out.append(part)
    return out


def plan_parts(fps: DataFrame, radius: int = RADIUS) -> Parts:
    """Parts and estimates from all distinct fingerprints.

    The number of parts makes a part about as wide as the logarithm of their number, so that an
    infrequent value is shared by few. Frequent values are at most 1 / FREQUENT for each part.
    """
    n = fps.count()
    m = min(max(round(64 / log2(max(n, 2))), 2), radius + 1)
    bits = group_bits(_co_occurrence(fps), n, m)
    plan = Parts(bits, radius, n, [], [], [])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for part in range(m):
                yield pa.record_batch([pa.array(np.full(len(x), part)), pa.array(plan.values(x, part).view(np.int64))], names=["part", "value"])

    counts = stored(fps.mapInArrow(valued, "part long, value long").groupBy("part", "value").count(), "values")
    limit = max(2.0, n * FREQUENT)
    often = counts.filter(F.col("count") >= limit).collect()
    rest = {r["part"]: r for r in counts.filter(F.col("count") < limit).groupBy("part").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("n2")).collect()}
    for part in range(m):
        own = sorted((r["value"], r["count"]) for r in often if r["part"] == part)
        plan.frequent.append((np.array([v for v, _ in own], np.int64).view(np.uint64), np.array([c for _, c in own], float)))
        r = rest.get(part)
        plan.usual.append(r["n2"] / r["n"] if r else 0.0)
        plan.spread.append((r["n"] if r else 0) / 2.0 ** len(bits[part]))
    return plan


def _masks(width: int, threshold: int) -> np.ndarray:
    """All numbers of `width` bits with at most `threshold` set."""
    return np.array([sum(1 << b for b in chosen) for t in range(threshold + 1) for chosen in combinations(range(width), t)], np.uint64)


# -- probe and verify -----------------------------------------------------------------------

_KEYED = "part long, value long, fp long, probe boolean"


def _keyed(fps: DataFrame, plan: Parts) -> DataFrame:
    """One index row for each part of a fingerprint, and its probes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            if not len(x):
                continue
            values = [plan.values(x, p) for p in range(len(plan.bits))]
            chosen = plan.thresholds(values)
            for p, v in enumerate(values):
                yield _keyed_batch(p, v, x, False)
                for t in range(plan.radius + 1):
                    at = np.flatnonzero(chosen[:, p] == t)
                    masks = _masks(len(plan.bits[p]), t)
                    step = max(1, (1 << 18) // len(masks))
                    for lo in range(0, len(at), step):
                        some = at[lo : lo + step]
                        yield _keyed_batch(p, (v[some][:, None] ^ masks[None, :]).ravel(), np.repeat(x[some], len(masks)), True)

    return fps.mapInArrow(rows, _KEYED)


def _keyed_batch(part: int, values: np.ndarray, fps: np.ndarray, probe: bool) -> pa.RecordBatch:
    n = len(values)
    columns = [pa.array(np.full(n, part)), pa.array(values.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(np.full(n, probe))]
    return pa.record_batch(columns, names=["part", "value", "fp", "probe"])


def _star(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b between positions of `nodes`, as one link from each linked node to a smallest one."""
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _verified(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by key, index rows before probes; stars instead of all pairs of a key."""
    keys = ["part", "value", "probe_block", "index_block"]
    held: pa.Table | None = None
    for batch in _then_none(batches):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not len(table):
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.ones(len(table), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.flatnonzero(new)
        # the last key may go on in the next batch
        stop = len(table) if batch is None else int(starts[-1])
        held = None if batch is None else table.slice(stop)
        starts = np.append(starts[starts < stop], stop)
        if len(starts) > 1:
            yield from _links(table.column("fp").to_numpy()[:stop].view(np.uint64), table.column("probe").to_numpy()[:stop], starts, radius)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _links(fps: np.ndarray, probe: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    indexed = np.add.reduceat((~probe).astype(np.int64), starts[:-1])
    asks = np.flatnonzero(probe & (indexed[run] > 0))
    if not len(asks):
        return
    nodes, at = np.unique(fps, return_inverse=True)
    width = indexed[run[asks]]
    ends = np.cumsum(width)
    left, right = [], []
    lo = 0
    while lo < len(asks):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, side="right")), lo + 1)
        some, w = asks[lo:hi], width[lo:hi]
        a = np.repeat(some, w)
        b = np.arange(int(w.sum())) + np.repeat(starts[run[some]] - np.concatenate([[0], np.cumsum(w)[:-1]]), w)
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= radius) & (fps[a] != fps[b])
        left.append(at[a[near]])
        right.append(at[b[near]])
        if sum(map(len, left)) > _PAIRS:
            la, lb = _star(nodes, np.concatenate(left), np.concatenate(right))
            left, right = [np.searchsorted(nodes, la)], [np.searchsorted(nodes, lb)]
        lo = hi
    la, lb = _star(nodes, np.concatenate(left), np.concatenate(right))
    if len(la):
        yield pa.record_batch([pa.array(la.view(np.int64)), pa.array(lb.view(np.int64))], names=["a", "b"])


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links `a`, `b` that connect exactly what all pairs of distinct fingerprints `fp` within `radius` connect."""
    plan = plan_parts(fps, radius)
    keyed = _keyed(fps, plan)
    long_keys = (
        keyed.groupBy("part", "value")
        .agg(F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("n_index"), F.sum(F.when(F.col("probe"), 1).otherwise(0)).alias("n_probe"))
        .filter((F.col("n_index") > BLOCK) | (F.col("n_probe") > BLOCK))
        .select("part", "value", F.ceil(F.col("n_index") / BLOCK).alias("index_blocks"), F.ceil(F.greatest("n_probe", F.lit(1)) / BLOCK).alias("probe_blocks"))
    )
    dealt = keyed.join(long_keys, ["part", "value"], "left").fillna(1, ["index_blocks", "probe_blocks"])
    own = lambda blocks: F.pmod(F.xxhash64("fp"), F.col(blocks))
    every = lambda blocks: F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    met = (
        dealt.withColumn("probe_block", F.explode(F.when(F.col("probe"), F.array(own("probe_blocks"))).otherwise(every("probe_blocks"))))
        .withColumn("index_block", F.explode(F.when(F.col("probe"), every("index_blocks")).otherwise(F.array(own("index_blocks")))))
        .select("part", "value", "probe_block", "index_block", "fp", "probe")
        .repartition("part", "value", "probe_block", "index_block")
        .sortWithinPartitions("part", "value", "probe_block", "index_block", "probe")
    )
    return met.mapInArrow(lambda batches: _verified(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: `id_col`, `fingerprint` (long), `component` (smallest id reachable).

    Texts without words, null ones too, have fingerprint 0 and link like any other. Rows with
    the same fingerprint are one node, however many; rows that share an id may be in different
    components. A null id never names a component unless all its ids are null. An empty table
    gives no rows. Fingerprints, keys and links stay on the executors.
    """
    marked = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    linked = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(linked, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "component").select(F.col("fp").alias("_fp"), F.col("component_id").alias("component"))
    return marked.join(classes, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the one with the smallest id.

    Rows that share an id, or have none, are told apart by their texts; of equal rows one stays.
    """
    rows, u = numbered(docs, id_col, text_col)
    found = near_duplicates(rows, u, text_col, shingle, radius)
    keep = stored(found.filter(F.col(u) == F.col("component")).select(F.col(u).alias("_keep")), "keep")
    # what is kept grows with the rows: the same merge join at every size
    return rows.hint("merge").join(keep, F.col(u) == F.col("_keep"), "left_semi").drop(u)
