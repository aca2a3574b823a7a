"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

Each document becomes a short row of statistics (lengths, shares of kinds of characters and words,
repetition). Cosines of random projections of the standardised row approximate a Gaussian kernel,
so that a linear fit to them is a kernel fit whose size does not grow with the rows: tasks sum
z z' and z y over their rows, per fold, and Spark sums those sums row by row. Folds choose the
ridge and give scores that no label of their own has seen; isotonic regression turns these into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import stored
from flowtide.llm.sampling import fold
from flowtide.llm.textbytes import NOT_WHITE, Words, class_table, mix, words

#: random Fourier features
FEATURES = 256
#: width of the Gaussian kernel, in standard deviations of a statistic times the root of their number
WIDTH = 1.0
#: parts that the labelled rows are dealt into, by hash of the id
FOLDS = 5
#: ridges that the folds choose from
RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0)
#: standardised statistics are cut here
CUT = 4.0
#: bins of the scores that are calibrated, between SCORES
BINS = 2_000
SCORES = (-0.5, 1.5)

STATISTICS = [
    "log_words", "word_chars", "log_longest", "upper", "digits", "symbols", "stops", "marks", "other_chars", "lines",
    "different_words", "again", "repeated_threes", "commonest", "short_words", "capitals", "without_letters", "with_symbols", "repeated_lines",
]

_UPPER = class_table(bytes(range(0x41, 0x5B)))
_DIGIT = class_table(bytes(range(0x30, 0x3A)))
_STOP = class_table(b".!?")
_MARK = class_table(b",;:'\"-()")
_SYMBOL = class_table(b"#$%&*+/<=>@[\\]^_`{|}~")
_LETTER = class_table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LINE = class_table(b"\n", inverse=True)
_CONTINUED = class_table(bytes(range(0x80, 0xC0)))


def _repeats_of(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: different values of `h`, and how often the commonest occurs."""
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, t[first], np.diff(np.append(first, len(t))))
    return np.bincount(t[first], minlength=n), most


def _statistics(block: Words, lines: Words) -> np.ndarray:
    """One row of STATISTICS for each text of a block; `lines` are its lines as words."""
    n = len(block.first) - 1
    data, n_words = block.data, block.counts
    text_of = block.text_of_word()
    h, length = block.hashes(), block.end - block.start
    bounds = block.text_start

    def chars(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[bounds])

    def in_word(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[block.end] - sums[block.start]

    def by_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text_of, values, n)

    continued = in_word(_CONTINUED)
    size = length - continued
    total = np.maximum(np.diff(bounds) - chars(_CONTINUED), 1)
    some, longest = np.maximum(n_words, 1), np.zeros(n)
    np.maximum.at(longest, text_of, size)
    letters, symbols = in_word(_LETTER), in_word(_SYMBOL)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    different, most = _repeats_of(text_of, h, n)
    threes = np.flatnonzero(text_of[2:] == text_of[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        three = mix(h[threes] * np.uint64(3) + mix(h[threes + 1]) * np.uint64(5) + mix(mix(h[threes + 2]))) if len(threes) else np.zeros(0, np.uint64)
    n_threes = np.bincount(text_of[threes], minlength=n)
    other_threes, _ = _repeats_of(text_of[threes], three, n)
    line_text = lines.text_of_word()
    other_lines, _ = _repeats_of(line_text, lines.hashes(), n)
    n_lines = lines.counts
    share = lambda x, of: x / np.maximum(of, 1)
    columns = [
        np.log1p(n_words), share(by_text(size), some), np.log1p(longest), share(chars(_UPPER), total), share(chars(_DIGIT), total), share(chars(_SYMBOL), total),
        share(chars(_STOP), some), share(chars(_MARK), some), share(chars(class_table(bytes(range(0xC0, 0x100)))), total), share(n_lines, some),
        share(different, some), share(by_text(same), some), share(n_threes - other_threes, n_threes), share(most, some), share(by_text(size <= 3), some),
        share(by_text(_UPPER[data[block.start]] if len(h) else h), some), share(by_text(letters == 0), some), share(by_text(symbols > 0), some), share(n_lines - other_lines, n_lines),
    ]
    return np.stack(columns, 1).astype(np.float32) if n else np.zeros((0, len(STATISTICS)), np.float32)


def _rows(texts: pa.Array) -> pa.Array:
    parts = [_statistics(block, lines) for block, lines in zip(words(texts, NOT_WHITE), words(texts, _LINE))]
    flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
    ends = np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def statistics(text: Column) -> Column:
    """STATISTICS of a whole text, as an array of floats; all 0 for a text without characters, a null one too."""
    return F.arrow_udf(_rows, "array<float>")(text)


def _matrix(values: pa.Array) -> np.ndarray:
    """Rows of an array column; rows that are null or of another length are 0."""
    k = len(STATISTICS)
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(values), k))
    good = lengths == k
    if good.any():
        out[good] = values.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


@dataclass
class Kernel:
    """Standardised statistics to random Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int = 13

    def features(self, x: np.ndarray) -> np.ndarray:
        """sqrt(2 / FEATURES) cos(W x + b), and a 1."""
        rng = np.random.default_rng(self.seed)
        w = rng.standard_normal((x.shape[1], FEATURES)) / (WIDTH * np.sqrt(x.shape[1]))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -CUT, CUT)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


@dataclass
class QualityModel:
    kernel: Kernel
    weights: np.ndarray
    #: raw scores and the probabilities they stand for, both ascending
    at: np.ndarray
    probability: np.ndarray

    def scores(self, values: pa.Array) -> pa.Array:
        x = _matrix(values)
        out = np.empty(len(x))
        for k in range(0, len(x), 4096):
            raw = self.kernel.features(x[k : k + 4096]) @ self.weights
            # steps of the calibration stay in the order of the raw scores
            out[k : k + 4096] = 0.999 * np.interp(raw, self.at, self.probability) + 0.001 * np.clip(raw, 0, 1)
        return pa.array(out)


def _summed(kernel: Kernel):
    """Per task and fold, the rows of [z 1 y]' [z 1 y]."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                rows = np.hstack([kernel.features(x[at : at + 4096]), y[at : at + 4096, None]])
                for f in np.unique(folds[at : at + 4096]).tolist():
                    own = rows[folds[at : at + 4096] == f]
                    sums[f] = sums.get(f, 0) + own.T @ own
        for f, total in sums.items():
            yield _as_rows([(f, i, row) for i, row in enumerate(total)])

    return task


def _as_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["fold", "i", "row"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for f, i, row in zip(batch.column("fold").to_pylist(), batch.column("i").to_pylist(), batch.column("row").to_pylist()):
            sums[f, i] = sums.get((f, i), 0) + np.frombuffer(row)
    if sums:
        yield _as_rows([(f, i, row) for (f, i), row in sums.items()])


def _normal_equations(labelled: DataFrame, kernel: Kernel) -> dict[int, np.ndarray]:
    """[z 1 y]' [z 1 y] of each fold; FOLDS matrices of FEATURES + 2 rows, whatever the data."""
    form = "fold int, i int, row binary"
    out = {f: np.zeros((FEATURES + 2, FEATURES + 2)) for f in range(FOLDS)}
    for f, i, row in labelled.mapInArrow(_summed(kernel), form).repartition("fold", "i").mapInArrow(_added, form).collect():
        out[f][i] = np.frombuffer(row)
    return out


def _ridge(m: np.ndarray, ridge: float) -> np.ndarray:
    g, b = m[:-1, :-1], m[:-1, -1]
    penalty = np.full(len(b), ridge)
    penalty[-1] = 1e-9  # the constant is free
    return np.linalg.solve(g + np.diag(penalty), b)


def _squares(m: np.ndarray, w: np.ndarray) -> float:
    """Sum of squared errors of `w` on the rows behind `m`."""
    v = np.append(w, -1.0)
    return float(v @ m @ v)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of an ascending least-squares fit to the share of ones: their mean places and values."""
    blocks: list[list[float]] = []
    for place, count, one in zip(at.tolist(), n.tolist(), ones.tolist()):
        blocks.append([place * count, count, one])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 1], found[:, 2] / found[:, 1]


def labelled_rows(rows: DataFrame, labels: DataFrame, id_col: str, x_col: str, label_col: str, only: Column | None) -> DataFrame:
    """`x`, `y`, `fold` of the rows with a label. An id's labels count as one, the commoner; ids with a tie have none."""
    some = labels.filter(only) if only is not None else labels
    some = some.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_y")).filter("_key IS NOT NULL AND _y IN (0, 1)")
    one = some.groupBy("_key").agg(F.avg("_y").alias("_y")).filter("_y <> 0.5").select("_key", F.round("_y").alias("_y"))
    narrow = rows.select(F.col(id_col).alias("_id"), F.col(x_col).alias("x"))
    return narrow.join(one, F.col("_id") == F.col("_key")).select("x", F.col("_y").cast("double").alias("y"), F.pmod(F.xxhash64("_key"), F.lit(FOLDS)).cast("int").alias("fold"))


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", x_col: str = "x", label_col: str = "quality", only: Column | None = None) -> QualityModel:
    """Fit to all labelled rows; `rows` have STATISTICS in `x_col`, `only` limits `labels` to some rows.

    Labels that are neither 0 nor 1, null ids and labels without a row are left out; rows that
    share an id share its label. Without labels everything scores one half, with labels of one
    class that class.
    """
    labelled = stored(labelled_rows(rows, labels, id_col, x_col, label_col, only), "labelled")
    k = len(STATISTICS)
    sums = labelled.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*"), F.avg("v"), F.stddev_pop("v")).collect()
    mean, scale = np.zeros(k), np.ones(k)
    for i, _, m, s in sums:
        mean[i], scale[i] = m, s if s > 1e-6 else 1.0
    kernel = Kernel(mean, scale)
    parts = _normal_equations(labelled, kernel)
    whole = sum(parts.values())
    n, ones = whole[-2, -2], whole[-2, -1]
    if not 0 < ones < n:
        value = 0.5 if not n else float(ones > 0)
        return QualityModel(kernel, np.zeros(FEATURES + 1), np.array([0.0]), np.array([value]))
    errors = {r: sum(_squares(parts[f], _ridge(whole - parts[f], r)) for f in parts) for r in RIDGES}
    ridge = min(RIDGES, key=lambda r: errors[r])
    others = np.stack([_ridge(whole - parts[f], ridge) for f in range(FOLDS)])
    low, high = SCORES
    width = (high - low) / BINS

    def binned(values: pa.Array, folds: pa.Array) -> pa.Array:
        raw = np.einsum("ij,ij->i", kernel.features(_matrix(values)), others[folds.to_numpy(zero_copy_only=False)])
        return pa.array(np.clip(((raw - low) / width).astype(np.int64), 0, BINS - 1).astype(np.int32))

    bins = labelled.select(F.arrow_udf(binned, "int")("x", "fold").alias("bin"), "y").groupBy("bin").agg(F.count("*"), F.sum("y")).orderBy("bin").collect()
    at, count, one = (np.array(c, float) for c in zip(*bins))
    places, values = isotonic(low + (at + 0.5) * width, count, one)
    return QualityModel(kernel, _ridge(whole, ridge), places, values)


def quality(model: QualityModel, rows: DataFrame, x: Column) -> Column:
    """The probability of label 1, 0 to 1, from STATISTICS; null ones count as those of an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    return F.arrow_udf(lambda values: held.value.scores(values), "double")(x)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", only: Column | None = None) -> DataFrame:
    """`id_col` and `score` of every row of `docs`; the texts are read once, for their statistics."""
    rows = stored(docs.select(F.col(id_col), statistics(F.col(text_col)).alias("x")), "statistics")
    model = train(rows, labels, id_col, "x", label_col, only)
    return rows.select(id_col, quality(model, rows, F.col("x")).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether an id's labels are not learned from."""
    return fold(doc_id, 3) == 1
