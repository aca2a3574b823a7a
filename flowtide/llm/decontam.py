"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, and a scan of all texts.

Words are runs of digits, letters a-z (A-Z lowered) and non-ASCII characters. A window is N
consecutive words of a benchmark item; an item with fewer words is one window. A text's windows
are looked up by hash, hits are verified word by word, and every word inside a verified hit
counts as contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import drop_stored, fresh_name, stored
from flowtide.llm.textbytes import ALPHANUMERIC, Words, words

#: words of a window
WINDOW = 10
#: bytes of benchmark text held by one broadcast set; a larger benchmark takes more passes
SET_BYTES = 16 << 20
#: words of a piece of an item; longer items are cut into pieces that overlap by a window
PIECE_WORDS = 1 << 14

_FILTER_BITS = 22
_HITS = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<begin:bigint,end:bigint>>,items:array<string>>"
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n consecutive words."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _STEP + hashes[k : k + len(out)]
    return out


class WindowSet:
    """All windows of some benchmark items, by length: sorted hashes, where each window begins, and the words to verify it by.

    A window takes twelve bytes besides its words. `hits` counts on words of the lower-cased text.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.items = [item for item, _ in items]
        texts = pa.array([text for _, text in items], pa.string())
        data, start, end, owner, hashes, at = [], [], [], [], {}, {}
        size = n_words = 0
        for block in words(texts, ALPHANUMERIC, lower=True):
            h = block.hashes()
            for k in range(len(block.first) - 1):
                a, b = int(block.first[k]), int(block.first[k + 1])
                n = min(window, b - a)
                if n:
                    hashes.setdefault(n, []).append(_window_hashes(h[a:b], n))
                    at.setdefault(n, []).append(np.arange(n_words + a, n_words + b - n + 1, dtype=np.int32))
            data.append(block.data)
            start.append(block.start + size)
            end.append(block.end + size)
            owner.append((block.row + block.text_of_word()).astype(np.int32))
            size, n_words = size + len(block.data), n_words + len(block.start)
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.data, self.start, self.end, self.owner = flat(data, np.uint8), flat(start, np.int32), flat(end, np.int32), flat(owner, np.int32)
        self.hashes, self.at, self.seen = {}, {}, {}
        for n in hashes:
            h, place = np.concatenate(hashes[n]), np.concatenate(at[n])
            order = np.argsort(h, kind="stable")
            self.hashes[n], self.at[n] = h[order], place[order]
            self.seen[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.seen[n][h >> np.uint64(64 - _FILTER_BITS)] = True

    def _equal(self, block: Words, i: int, place: int, n: int) -> bool:
        own = (block.word(k) for k in range(i, i + n))
        return all(w == self.data[self.start[k] : self.end[k]].tobytes() for k, w in enumerate(own, place))

    def hits(self, block: Words) -> list[tuple[int, int, set[str]]]:
        """(first word, words, items with an id) of each verified window, none across two texts."""
        found = []
        h = block.hashes()
        for n, known in self.hashes.items():
            grams = _window_hashes(h, n)
            at = np.flatnonzero(self.seen[n][grams >> np.uint64(64 - _FILTER_BITS)])
            low, high = (np.searchsorted(known, grams[at], side=side) for side in ("left", "right"))
            row = np.searchsorted(block.first, at, side="right") - 1
            good = (low < high) & (at + n <= block.first[row + 1])
            for i, a, b in zip(at[good].tolist(), low[good].tolist(), high[good].tolist()):
                places = [p for p in self.at[n][a:b].tolist() if self._equal(block, i, p, n)]
                if places:
                    found.append((i, n, {self.items[self.owner[p]] for p in places} - {None}))
        return found


def _pieces(window: int):
    """Items cut into pieces of PIECE_WORDS words, each beginning with the last window - 1 words of the one before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for block in words(texts, ALPHANUMERIC, lower=True):
                out = ([], [])
                for k in range(len(block.first) - 1):
                    a, b = int(block.first[k]), int(block.first[k + 1])
                    for first in range(a, max(b - window + 1, a + 1) if b > a else a, PIECE_WORDS):
                        last = min(first + PIECE_WORDS + window - 1, b) - 1
                        out[0].append(ids[block.row + k].as_py())
                        out[1].append(block.data[block.start[first] : block.end[last]].tobytes().decode())
                yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["item", "text"])

    return task


def _scan(texts: pa.Array, windows: WindowSet, before: pa.Array) -> pa.Array:
    """Hits of each text as _HITS; `before` has those of earlier passes, null in the first."""
    rows: list[dict] = []
    base = 0
    earlier = before.to_pylist() if before.null_count < len(before) else None
    for block in words(texts, ALPHANUMERIC, lower=True):
        n_rows = len(block.first) - 1
        found = windows.hits(block)
        items: dict[int, set[str]] = {}
        covered = np.zeros(len(block.start) + 1, np.int32)
        if found:
            first = np.array([i for i, _, _ in found])
            np.add.at(covered, first, 1)
            np.add.at(covered, first + [n for _, n, _ in found], -1)
            for row, (_, _, ids) in zip((np.searchsorted(block.first, first, side="right") - 1).tolist(), found):
                items.setdefault(row, set()).update(ids)
        mask = np.cumsum(covered[:-1]) > 0
        for k, n in enumerate(block.counts.tolist()):
            row = {"n_words": n, "n_hit": 0, "spans": [], "items": []}
            old = earlier[base + k] if earlier is not None else None
            if k in items or (old and old["n_hit"]):
                a = int(block.first[k])
                inside = mask[a : a + n].copy()
                start, end = block.start[a : a + n], block.end[a : a + n]
                origin = int(block.text_start[k])
                for span in old["spans"] if old else ():
                    inside |= (start - origin >= span["begin"]) & (end - origin <= span["end"])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                row["n_hit"] = int(inside.sum())
                row["spans"] = [{"begin": int(start[i]) - origin, "end": int(end[j - 1]) - origin} for i, j in zip(edges[::2], edges[1::2])]
                row["items"] = sorted(items.get(k, set()).union(old["items"] if old else ()))
            rows.append(row)
        base += n_rows
    return pa.array(rows, _ARROW_HITS)


_ARROW_HITS = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with a struct column `hits`: `n_words`, `n_hit`, `spans` (byte ranges of hit words), `items`.

    The struct gets underscores before its name if `docs` has that column. `items` are ids of the
    items with a window in the text, as text, sorted; windows of items without an id count as
    hits and name no item. A null text or item has no words; repeated items all count; an empty
    benchmark or table gives no hits. Texts are scanned whole and no row moves. The benchmark,
    long items in pieces, is dealt into sets of about SET_BYTES. Each is broadcast and scanned in
    a pass of its own, and what a pass found is written before the next set is made, so that the
    driver and a task hold one set, whatever the benchmark's size.
    """
    spark = docs.sparkSession
    name = fresh_name(docs, "hits")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    items = items.mapInArrow(_pieces(window), "item string, text string")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // SET_BYTES))
    out, before = docs, None
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k) if passes > 1 else items
        held = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()], window))
        found = F.col(name) if k else F.lit(None).cast(_HITS)
        out = out.withColumn(name, _pass(held)(F.col(text_col), found))
        if k < passes - 1:
            out = stored(out, "hits")
            held.destroy()
            if before is not None:
                drop_stored(before)
            before = out
    return out


def _pass(held):
    @F.arrow_udf(_HITS)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        return _scan(texts, held.value, before)

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **columns: str) -> DataFrame:
    """`docs` without contaminated rows, or with `remove="spans"` without their hit spans; columns unchanged."""
    found = find_contamination(docs, benchmark, text_col, **columns)
    hits = found.columns[-1]
    if remove == "documents":
        return found.filter(F.col(f"{hits}.n_hit") == 0).drop(hits)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    return found.withColumn(text_col, without_spans(F.col(text_col), F.col(f"{hits}.spans"))).drop(hits)


def _cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None or not cuts:
            out.append(text)
            continue
        data, at, kept = text.encode(), 0, []
        for cut in cuts:
            kept.append(data[at : cut["begin"]])
            at = cut["end"]
        out.append(b"".join([*kept, data[at:]]).decode())
    return pa.array(out, pa.string())


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the given byte ranges."""
    return F.arrow_udf(_cut_spans, "string")(text, spans)


def items_digest(items: Column) -> Column:
    """Lowercase hex sha256 of item ids, sorted as strings, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)
