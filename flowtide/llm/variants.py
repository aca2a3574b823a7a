"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Every word of the vocabulary generates the words that one deletion or one replacement makes of it
(an insertion is the other word's deletion). These probe Bloom filters of the vocabulary, sharded
by word length and blocked, so that a probe reads one 64-bit block; only the few that pass are
shuffled to a join with the vocabulary itself, which removes what the filters let through falsely.

Hashes are polynomials of code points, so an edit's hash follows from its word's in a few
operations, for all places of all words at once. Deletions are made at the first of equal
neighbours only and replacements only by greater code points: each pair of words is met once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import stored
from flowtide.llm.suffixes import stored_tidily
from flowtide.llm.textbytes import mix, text_bytes

#: code points of a word, and occurrences, at least
SHORTEST, OFTEN = 7, 2
#: one run in so many loses a code point
SLIPS = 31
#: how many times a form's count is its variant's, at least
RATIO = 10

#: words longer than this share a shard, with more probes: they make more edits
LONG = 40
#: blocks of 64 bits of a slice of a filter
SLICE_BLOCKS = 1 << 15
#: words of a slice: 24 bits for each, and twice that for long ones
SLICE_WORDS = SLICE_BLOCKS * 64 // 24
#: slices broadcast at once (32 MB); more slices take more passes
PASS_SLICES = 128
#: edits made at once
CHUNK = 1 << 18

_RUN = "[A-Za-z\\u00C0-\\u00FF]"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _patterns(bits: int = 4, n: int = 4096) -> np.ndarray:
    """Blocks with `bits` bits set, drawn once."""
    rng = np.random.default_rng(12)
    out = np.zeros(n, np.uint64)
    for row in range(n):
        for b in rng.choice(64, bits, replace=False).tolist():
            out[row] |= np.uint64(1) << np.uint64(b)
    return out


_PATTERNS = _patterns()


def slipped_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """`word`: the runs of letters of all texts, A-Z lowered, some with a slip, of `shortest` code points or more.

    With h the crc32 of `<id>:<run>` (no text for a null id), a run loses its code point
    h % length where SLIPS divides h. Null texts have no runs.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(lower, F.lit(f"{_RUN}{{{shortest},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    slip = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return hashed.select(F.when(F.pmod("h", F.lit(SLIPS)) == 0, slip).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= shortest)


def vocabulary(words: DataFrame, often: int = OFTEN) -> DataFrame:
    """`word`, `n` of the words that occur `often` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte per code point (all are below 256) and the offsets of words."""
    data, offsets = text_bytes(words)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    lead = data == 0xC3
    before = np.concatenate([[0], np.cumsum(lead)])
    codes = np.where(data >= 0x80, (data & 0x3F) | 0xC0, data)[~lead]
    return codes.astype(np.uint8), offsets - before[offsets]


def _texts(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """UTF-8 strings of rows of code points that lie one after another; `ends` are their ends."""
    two = codes >= 0x80
    place = np.arange(len(codes)) + np.cumsum(two)
    out = np.empty(len(codes) + int(two.sum()), np.uint8)
    out[place] = np.where(two, (codes & 0x3F) | 0x80, codes)
    out[place[two] - 1] = 0xC3
    longer = np.concatenate([[0], np.cumsum(two)])
    offsets = np.concatenate([[0], ends + longer[ends]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(out))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _values(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64) + np.uint64(1)


def _finished(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h + np.uint64(length * int(_SPREAD) & (1 << 64) - 1))


def shard_of(length: int) -> int:
    return min(length, LONG + 1)


def _n_probes(shard: int) -> int:
    return 4 if shard > LONG else 2


def _slice(g: np.ndarray, n_slices: int) -> np.ndarray:
    return ((g >> np.uint64(40)) * np.uint64(n_slices)) >> np.uint64(24)


def _probe(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block within a slice and bits of the k-th probe."""
    v = g * np.uint64(2 * k + 1) if k else g
    block = (v >> np.uint64(10)) & np.uint64(SLICE_BLOCKS - 1)
    return block, _PATTERNS[((g * _SPREAD) >> np.uint64(52 - 12 * k)) & np.uint64(4095)]


def _by_length(codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of code points of the words of each length."""
    lengths = np.diff(at)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield n, rows, codes[at[rows][:, None] + np.arange(n)]


def word_hashes(words: pa.Array) -> np.ndarray:
    codes, at = _codes(words)
    out = np.zeros(len(words), np.uint64)
    for n, rows, matrix in _by_length(codes, at):
        out[rows] = _finished((_values(matrix) * _powers(n)).sum(1, dtype=np.uint64), n)
    return out


def _placed(words: DataFrame, slices: dict[int, int]) -> DataFrame:
    """Words with their shard, slice and hash."""

    def place(values: pa.Array) -> pa.Array:
        g = word_hashes(values)
        lengths = np.diff(_codes(values)[1])
        shard = np.minimum(lengths, LONG + 1)
        n = np.array([slices.get(k, 1) for k in range(LONG + 2)])[shard]
        return pa.StructArray.from_arrays([pa.array(shard.astype(np.int32)), pa.array(_slice(g, n.astype(np.uint64)).astype(np.int32)), pa.array(g.view(np.int64))], names=["shard", "slice", "g"])

    return words.select(F.arrow_udf(place, "struct<shard:int,slice:int,g:bigint>")("word").alias("p")).select("p.*")


def _filter_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice; the rows of a slice come one after another."""
    now, bits = None, None
    for batch in batches:
        shard, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "slice"))
        g = batch.column("g").to_numpy(zero_copy_only=False).view(np.uint64)
        edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(g)]):
            if a == b:
                continue
            key = int(shard[a]), int(part[a])
            if key != now:
                if now is not None:
                    yield _slice_row(now, bits)
                now, bits = key, np.zeros(SLICE_BLOCKS, np.uint64)
            for k in range(_n_probes(key[0])):
                block, pattern = _probe(g[a:b], k)
                np.bitwise_or.at(bits, block, pattern)
    if now is not None:
        yield _slice_row(now, bits)


def _slice_row(key: tuple[int, int], bits: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["shard", "slice", "bits"])


class Filters:
    """Some slices of the filters: the numbers of slices of all shards, and where each held one lies."""

    def __init__(self, n_slices: dict[int, int], held: list[tuple[int, int, bytes]]):
        self.n_slices = n_slices
        self.bits = np.frombuffer(b"".join(bits for _, _, bits in held), np.uint64)
        self.place = {shard: np.full(n, -1, np.int64) for shard, n in n_slices.items()}
        for k, (shard, part, _) in enumerate(held):
            self.place[shard][part] = k

    def has(self, length: int) -> bool:
        return (self.place.get(shard_of(length), np.full(1, -1)) >= 0).any()

    def may_hold(self, g: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the hashes of words of `length` that the held slices let through."""
        shard = shard_of(length)
        held = self.place[shard][_slice(g, self.n_slices[shard]).astype(np.int64)] if self.n_slices[shard] > 1 else None
        if held is None:
            start, found = self.place[shard][0] * SLICE_BLOCKS, None
        else:
            found = np.flatnonzero(held >= 0)
            start, g = held[found] * SLICE_BLOCKS, g[found]
        for k in range(_n_probes(shard)):
            block, pattern = _probe(g, k)
            passed = np.flatnonzero((self.bits[block.astype(np.int64) + start] & pattern) == pattern)
            found = passed if found is None else found[passed]
            g = g[passed]
            start = start[passed] if isinstance(start, np.ndarray) else start
        return found


def _edits(matrix: np.ndarray, n: int, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, place, code) of the edits of words of length `n` that the filters let through; code -1 deletes."""
    values, powers = _values(matrix), _powers(n)
    terms = values * powers
    upto = np.cumsum(terms, 1, dtype=np.uint64)
    whole = upto[:, -1:]
    if filters.has(n - 1):
        gone = upto - terms + (whole - upto) * _INVERSE
        rows, places = np.nonzero(np.concatenate([np.ones((len(matrix), 1), bool), matrix[:, 1:] != matrix[:, :-1]], 1))
        passed = filters.may_hold(_finished(gone[rows, places], n - 1), n - 1)
        yield rows[passed], places[passed], -1
    if filters.has(n):
        for code in alphabet.tolist():
            less = matrix < code
            rows, places = np.nonzero(less)
            edited = whole[rows, 0] + (np.uint64(code) + np.uint64(1) - values[less]) * powers[places]
            passed = filters.may_hold(_finished(edited, n), n)
            yield rows[passed], places[passed], code


def _neighbours(held, alphabet: np.ndarray):
    """Per word, the edits of it that the filters let through."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word"), batch.column("n")
            codes, at = _codes(words)
            for n, rows, matrix in _by_length(codes, at):
                step = max(CHUNK // n, 1)
                for a in range(0, len(rows), step):
                    part = matrix[a : a + step]
                    for own, places, code in _edits(part, n, alphabet, held.value):
                        # long words take their room: some rows at a time
                        for b in range(0, len(own), step):
                            r, p = own[b : b + step], places[b : b + step]
                            near = part[r]
                            if code < 0:
                                keep = np.arange(n) != p[:, None]
                                near, ends = near[keep], np.arange(1, len(r) + 1) * (n - 1)
                            else:
                                near[np.arange(len(r)), p] = code
                                near, ends = near.ravel(), np.arange(1, len(r) + 1) * n
                            which = pa.array(rows[a + r])
                            yield pa.record_batch([words.take(which), counts.take(which), _texts(near, ends)], names=["a", "an", "b"])

    return task


def near_pairs(vocab: DataFrame, pass_slices: int = PASS_SLICES) -> DataFrame:
    """`a`, `an`, `b`, `bn`: each pair of words of `vocab` (`word`, `n`) one edit apart, once, with their counts.

    `vocab` is read several times: pass a table. The driver holds one count per word length up to
    LONG, at most 90 code points, and `pass_slices` slices of 256 KB at a time.
    """
    spark = vocab.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LONG + 1))
    sizes = {r[0]: r[1] for r in vocab.groupBy(shard.alias("shard")).count().collect()}
    slices = {k: ceil(n * (2 if k > LONG else 1) / SLICE_WORDS) for k, n in sizes.items()}
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r[0]) for r in letters), np.int64)
    placed = _placed(vocab, slices).repartition("shard", "slice").sortWithinPartitions("shard", "slice")
    filters = stored_tidily(placed.mapInArrow(_filter_slices, "shard int, slice int, bits binary"), "filters")
    every = [(k, s) for k, n in sorted(slices.items()) for s in range(n)]
    found = []
    for at in range(0, len(every), pass_slices):
        some = every[at : at + pass_slices]
        (k0, s0), (k1, s1) = some[0], some[-1]
        rows = filters.filter((F.struct("shard", "slice") >= F.struct(F.lit(k0), F.lit(s0))) & (F.struct("shard", "slice") <= F.struct(F.lit(k1), F.lit(s1)))).collect()
        held = spark.sparkContext.broadcast(Filters(slices, [tuple(r) for r in rows]))
        passed = vocab.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(_neighbours(held, alphabet), "a string, an bigint, b string")
        known = vocab.select(F.col("word").alias("b"), F.col("n").alias("bn"))
        found.append(stored_tidily(passed.join(known, "b").select("a", "an", "b", "bn"), "near"))
        held.destroy()
    if not found:
        return spark.createDataFrame([], "a string, an bigint, b string, bn bigint")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """`word`, `n`, `form`, `form_n`, `root`, `n_near` for each row of `vocab` (`word`, `n`; words are different).

    `n_near` counts the words one inserted, deleted or replaced code point away. A word's form is
    the commonest of them (ties: the smallest in code-point order) if it is `ratio` times as
    common, else null; the root is where following forms ends, the word itself if it has none.
    Forms grow `ratio`-fold, so their chains are short: the greatest count bounds the joins. An
    empty vocabulary gives no rows; words of letters up to U+00FF are expected, other words with
    null, spaces or nothing in them have no place here.
    """
    vocab = stored_tidily(vocab.select("word", "n"), "vocabulary")
    near = near_pairs(vocab)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n"))))
    sided = near.select(both.alias("p")).select("p.*")
    counts = sided.groupBy("word").agg(F.count("*").alias("n_near"))
    best = sided.filter(F.col("near_n") >= ratio * F.col("n")).groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("f"))
    forms = stored_tidily(best.select("word", F.col("f.near").alias("form"), (-F.col("f.m")).alias("form_n")), "forms")
    most = vocab.agg(F.max("n")).first()[0] or 1
    # a chain of d forms multiplies counts by ratio ** d; each join doubles the steps followed
    steps = max(log10(most) / log10(ratio), 1) if ratio > 1 else 64
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stored_tidily(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    out = vocab.join(counts, "word", "left").join(forms.join(roots, "word"), "word", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
