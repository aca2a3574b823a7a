"""Repeated byte strings: a synchronised sample of suffixes, sorted, compared with neighbours.

The scheme is that of difference-cover suffix sorting, with a sample chosen by content instead
of by residues: every run of WINDOW bytes holds a sampled position at a place that depends only
on its bytes (see `anchors`), so two equal runs always meet at two samples, and about one suffix
in 30 is sampled instead of two in three.

1. Samples whose grams occur once cannot be part of a repeat and are left out.
2. Samples with equal bytes around them get one name; all but the first of a name lie in
   repeats of the first, with every run that belongs to them.
3. What is left are edges of repeats: samples with equal grams but different surroundings. They
   are sorted by what follows and by what precedes them, and neighbours in these orders show
   how far the longest common prefix with any other sample reaches.
4. The other suffixes that may still repeat, runs between samples, are represented by their
   bytes up to the sample and from it on; equal ones are compared, the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtide.llm.anchors import GRAM, anchors
from flowtide.llm.common import drop_stored, fresh_name, numbered, stored
from flowtide.llm.textbytes import segments_hash, text_bytes

#: bytes of a string that counts as repeated
WINDOW = 100
#: rows of a batch that a task sends on
BATCH_ROWS = 1 << 16

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: a fixed shuffle of the byte values, for a second hash
_OTHER = np.random.default_rng(11).permutation(256).astype(np.uint8)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every data[start:end]."""
    return segments_hash(data, start, end), segments_hash(_OTHER[data], start, end)


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A sample's position and the runs that belong to it, in one number that sorts by position."""
    return (at << 16) | ((at - first) << 8) | (at - last)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 16
    return at, at - ((place >> 8) & 0xFF), at - (place & 0xFF)


def _longs(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def _gathered(names: list[str], parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The parts of many texts in batches of some tens of thousands of rows."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= BATCH_ROWS:
            yield _longs(names, *map(np.concatenate, zip(*held)))
            held, rows = [], 0
    if rows:
        yield _longs(names, *map(np.concatenate, zip(*held)))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, key and bytes of each text of a batch with columns u, text."""
    data, offsets = text_bytes(batch.column("text"))
    for k, (u, a, b) in enumerate(zip(batch.column("u").to_pylist(), offsets.tolist(), offsets[1:].tolist())):
        yield k, u, data[a:b]


def _samples(keyed: DataFrame, window: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for _, u, data in _each(batch):
                at, gram, first, last = anchors(data, window)
                yield gram, np.full(len(at), u), _pack(at, first, last)

    return keyed.mapInArrow(lambda batches: _gathered(["gram", "u", "place"], rows(batches)), "gram long, u long, place long")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and flat fields of a column of lists of structs."""
    column = batch.column(name)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _with_samples(keyed: DataFrame, samples: DataFrame) -> DataFrame:
    """Texts that have samples (u, gram, place), with the list of them in order."""
    lists = samples.groupBy(F.col("u").alias("_u")).agg(F.array_sort(F.collect_list(F.struct("place", "gram"))).alias("samples"))
    return keyed.join(lists, F.col("u") == F.col("_u")).select("u", "text", "samples")


def _named(with_samples: DataFrame, window: int) -> DataFrame:
    """Each sample's name: hashes of all bytes of the runs that belong to it, and where it is in them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            offsets, fields = _lists(batch, "samples")
            for k, u, data in _each(batch):
                place, gram = (fields[n][offsets[k] : offsets[k + 1]] for n in ("place", "gram"))
                at, first, last = _unpack(place)
                a, b = _hashes(data, first, last + window)
                shape = (place & 0xFFFF).astype(np.uint64)
                yield gram, (a ^ shape).view(np.int64), b.view(np.int64), np.full(len(at), u), place

    return with_samples.mapInArrow(lambda batches: _gathered(["gram", "a", "b", "u", "place"], rows(batches)), "gram long, a long, b long, u long, place long")


def _surroundings(with_samples: DataFrame, window: int) -> DataFrame:
    """Bytes before a sample, backwards, and from it on, as far as its runs reach."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, fields = _lists(batch, "samples")
            left, right = [], []
            for k, _, data in _each(batch):
                at, first, last = (x.tolist() for x in _unpack(fields["place"][offsets[k] : offsets[k + 1]]))
                text = data.tobytes()
                left += [text[f:q][::-1] for q, f in zip(at, first)]
                right += [text[q : e + window] for q, e in zip(at, last)]
            u = np.repeat(batch.column("u").to_numpy(), np.diff(offsets))
            columns = [pa.array(fields["gram"]), pa.array(u), pa.array(fields["place"]), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            whole = pa.record_batch(columns, names=["gram", "u", "place", "left", "right"])
            for lo in range(0, len(u), BATCH_ROWS):
                yield whole.slice(lo, BATCH_ROWS)

    return with_samples.mapInArrow(rows, "gram long, u long, place long, left binary, right binary")


def _common_with_neighbours(gram: np.ndarray, strings: pa.Array, most: int) -> np.ndarray:
    """The longest common prefix of each string with its neighbours of the same gram.

    Strings are sorted, so no other string of the gram shares more. The first and last of a
    batch may have neighbours elsewhere and count as sharing `most` bytes.
    """
    n = len(gram)
    data, offsets = text_bytes(strings)
    length = np.diff(offsets)
    matrix = np.zeros((n, most), np.uint8)
    inside = np.arange(most)[None, :] < length[:, None]
    matrix[inside] = data[offsets[0] : offsets[-1]]
    differ = (matrix[1:] != matrix[:-1]) | ~(inside[1:] & inside[:-1])
    shared = np.where(differ.any(1), differ.argmax(1), most)
    shared[gram[1:] != gram[:-1]] = 0
    out = np.full(n, most)
    if n > 1:
        out[1:-1] = np.maximum(shared[:-1], shared[1:])
    return out


def _runs_that_may_repeat(surroundings: DataFrame, window: int) -> DataFrame:
    """Hashes of all runs at edges that neighbours in both orders allow to repeat."""
    reach = window - GRAM

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shared = _common_with_neighbours(batch.column("gram").to_numpy(), batch.column("right"), window)
                whole = batch.append_column("after", pa.array(shared.astype(np.int32)))
                at, first, _ = _unpack(batch.column("place").to_numpy())
                yield whole.filter(pa.array(window - shared <= at - first))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            before = _common_with_neighbours(batch.column("gram").to_numpy(), batch.column("left"), reach)
            at, first, last = _unpack(batch.column("place").to_numpy())
            low = np.maximum(at - last, window - batch.column("after").to_numpy())
            high = np.minimum(at - first, before)
            count = np.maximum(high - low + 1, 0)
            text = [left[::-1] + right for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            data = np.frombuffer(b"".join(text), np.uint8)
            begin = np.cumsum([0, *map(len, text)])[:-1]
            which = np.repeat(np.arange(len(text)), count)
            # the farthest before the sample first, so that starts ascend
            back = np.repeat(high, count) - (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
            start = begin[which] + (at - first)[which] - back
            for lo in range(0, len(start), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                a, b = _hashes(data, start[part], start[part] + window)
                yield _longs(["a", "b", "u", "p"], a, b, batch.column("u").to_numpy()[which[part]], (at[which] - back)[part])

    kept = "gram long, u long, place long, left binary, right binary, after int"
    by_right = surroundings.repartitionByRange("gram", "right").sortWithinPartitions("gram", "right").mapInArrow(after, kept)
    by_left = by_right.repartitionByRange("gram", "left").sortWithinPartitions("gram", "left")
    return by_left.mapInArrow(runs, "a long, b long, u long, p long")


def repeated_ranges(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """`u`, `first`, `last`: starts (inclusive, in bytes) of runs of `window` bytes that also start earlier.

    `keyed` has `u` (order of the texts, unique) and `text`. Ranges of a text may adjoin; every
    start is in one at most. Intermediate tables lie in the shared folder, and shuffle files of
    a finished step are removed with it.
    """
    samples = _samples(keyed.filter(F.octet_length("text") >= window), window)
    often = samples.groupBy("gram").count().filter("count > 1").select("gram")
    repeated = stored_tidily(samples.join(stored_tidily(often, "grams"), "gram", "left_semi"), "samples")
    named = stored_tidily(_named(_with_samples(keyed, repeated), window), "names")
    names = stored_tidily(named.groupBy("gram", "a", "b").agg(F.min(F.struct("u", "place")).alias("first"), F.count("*").alias("n")), "classes")
    # all but the first sample of a name, with all their runs
    again = named.join(names.filter("n > 1"), ["gram", "a", "b"]).filter(F.struct("u", "place") > F.col("first"))
    bulk = again.select("u", (F.expr("shiftright(place, 16)") - F.expr("shiftright(place, 8) & 255")).alias("first"), (F.expr("shiftright(place, 16)") - F.expr("place & 255")).alias("last"))
    # edges: grams with several names
    several = names.groupBy("gram").count().filter("count > 1").select("gram")
    edges = names.join(several, "gram", "left_semi").select("gram", "first.u", "first.place")
    runs = stored_tidily(_runs_that_may_repeat(_surroundings(_with_samples(keyed, edges), window), window), "runs")
    earliest = runs.groupBy("a", "b").agg(F.min(F.struct("u", "p")).alias("e"), F.count("*").alias("n")).filter("n > 1")
    later = runs.join(earliest, ["a", "b"]).filter(F.struct("u", "p") > F.col("e")).select("u", F.col("p").alias("first"), F.col("p").alias("last"))
    out = stored_tidily(bulk.union(later), "ranges")
    for table in (repeated, named, names, runs):
        drop_stored(table)
    return out


def stored_tidily(df: DataFrame, purpose: str) -> DataFrame:
    """`stored`, and the shuffle files that led to it removed."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return stored(df, purpose)
    finally:
        spark.conf.set(_CLEANUP, before)


_RESULT = "struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<begin:bigint,end:bigint>>,kept:binary>"


def _cut(window: int):
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        data, at = text_bytes(texts)
        some = pa.record_batch([ranges], names=["r"])
        offsets, fields = _lists(some, "r")
        removed, n_spans, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        begins, ends = [], []
        for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            own = data[at[k] : at[k + 1]]
            if a == b:
                kept.append(own.tobytes())
                continue
            order = np.argsort(fields["first"][a:b], kind="stable")
            first, last = fields["first"][a:b][order], np.maximum.accumulate(fields["last"][a:b][order] + window)
            new = np.append(True, first[1:] > last[:-1])
            begin, end = first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]
            begins.append(begin)
            ends.append(end)
            marks = np.zeros(len(own) + 1, np.int32)
            marks[begin] += 1
            marks[end] -= 1
            stays = np.cumsum(marks[:-1]) == 0
            kept.append(own[stays].tobytes())
            removed[k], n_spans[k] = int((end - begin).sum()), len(begin)
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (begins, ends)], names=["begin", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), spans)
        return pa.StructArray.from_arrays([pa.array(np.diff(at)), pa.array(removed), lists, pa.array(kept, pa.binary())], names=["n_bytes", "n_removed", "spans", "kept"])

    return cut


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows of `docs` with a struct column `repeats`: `n_bytes`, `n_removed`, `spans`, `kept`.

    Each byte covered by a `window`-byte string that also starts earlier is removed: in a row
    with a smaller id, or before in the same text. Strings are judged on the input; matches do
    not cross texts; `kept` are the other bytes (a cut may fall inside a character). A null text
    has no bytes. Rows that share an id, or have none, come in order of their texts, so of equal
    rows one is the earlier. The struct gets underscores before its name if `docs` has that
    column. Texts shorter than the window are kept whole; an empty table gives no rows.
    """
    rows, u = numbered(docs, id_col, text_col)
    keyed = rows.select(F.col(u).alias("u"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(keyed, window)
    lists = ranges.groupBy(F.col("u").alias("_u")).agg(F.collect_list(F.struct("first", "last")).alias("_ranges"))
    name = fresh_name(docs, "repeats")
    joined = rows.join(lists.select(F.struct("_u", "_ranges").alias("_l")), F.col(u) == F.col("_l._u"), "left")
    return joined.withColumn(name, F.arrow_udf(_cut(window), _RESULT)(F.col(text_col), F.col("_l._ranges"))).select(*docs.columns, name)
