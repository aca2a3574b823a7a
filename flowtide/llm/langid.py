"""Language identification of mixed text: word scores by language, and the best path through them.

A word's script, from the code point of its first letter, narrows the languages it can be in to
those in which that script was learned. Each word scores for a language by the learned log
probabilities of its letter runs. The Viterbi path with a penalty for each switch labels every
word; runs of one label are spans, and the language with most letters is the text's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.sampling import bounded_sample, fitted, sampled_texts
from flowtide.llm.textbytes import Words, class_table, words

#: documents of each language that a model is fitted to, about
SAMPLE = 1500
#: languages that a model can tell apart, at most: its table has a column for each
LANGUAGES = 64
#: what a change of language between two words costs, in log units
SWITCH = 6.0
#: share of a language's words in a script, at least, for the script to be one of its own
SCRIPT_SHARE = 0.02

BITS = 18
RUNS = (2, 3, 4)
SMOOTH = 0.5

#: fixed values: first code points of script ranges, and the script each begins
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other Indic"), (0x0E00, "Thai"),
    (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"),
    (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
]
_SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_FROM = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([_SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

_LETTERS = class_table(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))
_RESULT = "struct<lang:string,score:double,spans:array<struct<begin:bigint,end:bigint,lang:string>>>"


def word_scripts(block: Words) -> np.ndarray:
    """Script number of each word, by the code point of its first letter that is not ASCII, or Latin."""
    if not len(block.start):
        return np.zeros(0, np.int64)
    data = np.append(block.data, np.zeros(4, np.uint8)).astype(np.int64)
    first = block.start.copy()
    ascii_only = data[first] < 0x80
    high = np.flatnonzero((data >= 0xC0)[: len(block.data)])
    if len(high):
        nearest = np.searchsorted(high, block.start)
        nearest = high[np.minimum(nearest, len(high) - 1)]
        inside = (nearest >= block.start) & (nearest < block.end)
        first = np.where(inside, nearest, first)
        ascii_only &= ~inside
    b0, b1, b2, b3 = (data[first + k] for k in range(4))
    two = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
    three = ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
    four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
    point = np.select([ascii_only, b0 < 0xE0, b0 < 0xF0], [b0, two, three], four)
    return _SCRIPT[np.searchsorted(_FROM, point, side="right") - 1]


def _runs(block: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of run: feature number of all runs of that many bytes, and each run's word.

    A word counts with one blank before and after it.
    """
    length = block.end - block.start + 2
    begin = np.cumsum(length) - length
    total = int(length.sum())
    spaced = np.full(total + 4, 0x20, np.uint32)
    inside = np.arange(int((length - 2).sum())) - np.repeat(np.cumsum(length - 2) - (length - 2), length - 2)
    spaced[np.repeat(begin + 1, length - 2) + inside] = block.data[np.repeat(block.start, length - 2) + inside]
    out = []
    for n in RUNS:
        count = np.maximum(length - n + 1, 1)
        word = np.repeat(np.arange(len(length)), count)
        at = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        packed = spaced[at]
        for k in range(1, n):
            packed = (packed << np.uint32(8)) | spaced[at + k]
        with np.errstate(over="ignore"):
            number = ((packed.astype(np.uint64) * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        out.append((number.astype(np.int64), word))
    return out


def viterbi(emitted: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word: `emitted` has a row of scores for each, `first` the bounds of texts.

    All texts take their n-th step together, longest texts first.
    """
    n, k = emitted.shape
    out = np.zeros(n, np.int64)
    if not n or k == 1:
        return out
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    start, length = first[:-1][order], length[order]
    running = np.searchsorted(-length, -np.arange(int(length[0]) + 1), side="left")  # texts longer than each step
    best = emitted[start].astype(np.float64)
    came_from = np.zeros(n, np.int16)  # where a switch into this word comes from
    stays = np.zeros((n, k), bool)
    final = np.empty((len(start), k))
    for t in range(1, int(length[0])):
        m = int(running[t])
        final[m : len(best)] = best[m:]
        best = best[:m]
        at = start[:m] + t
        top = best.argmax(1)
        switched = best[np.arange(m), top] - penalty
        stay = best >= switched[:, None]
        stays[at], came_from[at] = stay, top
        best = np.where(stay, best, switched[:, None]) + emitted[at]
    final[: len(best)] = best
    label = final.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(running[t])
        at = start[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = np.where(stays[at, label[:m]], label[:m], came_from[at])
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # a row of log probabilities for each run, a column for each language
    scripts: np.ndarray  # whether each script (row) is one of each language's (column)

    def word_scores(self, block: Words) -> np.ndarray:
        """A row of scores for each word; languages not written in its script are out of reach."""
        scores = np.zeros((len(block.start), len(self.languages)), np.float32)
        if not len(scores):
            return scores
        for number, word in _runs(block):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            scores += np.add.reduceat(self.table[number], starts, axis=0)
        may = self.scripts[word_scripts(block)]
        may |= ~may.any(1, keepdims=True)
        return np.where(may, scores - scores.max(1, keepdims=True), np.float32(-1e4))

    def label(self, texts: pa.Array, penalty: float) -> pa.Array:
        rows: dict[str, list] = {"lang": [], "score": []}
        begin, end, lang, n_spans = [], [], [], []
        for block in words(texts, _LETTERS, lower=True):
            n = len(block.first) - 1
            best = viterbi(self.word_scores(block), block.first, penalty) if self.languages else np.zeros(len(block.start), np.int64)
            text = block.text_of_word()
            k = max(len(self.languages), 1)
            letters = np.bincount(text * k + best, (block.end - block.start).astype(float), n * k).reshape(n, k)
            total = letters.sum(1)
            spoken = self._has_letters(block, total)
            top = letters.argmax(1)
            named = spoken & bool(self.languages)
            rows["lang"] += [self.languages[j] if ok else "und" for j, ok in zip(top.tolist(), named.tolist())]
            rows["score"].append(np.where(named, letters[np.arange(n), top] / np.maximum(total, 1), 0.0))
            new = np.ones(len(best), bool)
            new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
            new &= named[text]
            at = np.flatnonzero(new)
            changes = np.append(np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (text[1:] != text[:-1]))) if len(best) else [], len(best)).astype(np.int64)
            last = changes[np.searchsorted(changes, at, side="right")] - 1 if len(at) else at
            origin = block.text_start[text[at]]
            begin.append(block.start[at] - origin)
            end.append(block.end[last] - origin)
            lang += [self.languages[j] for j in best[at].tolist()]
            n_spans.append(np.bincount(text[at], minlength=n))
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        spans = pa.StructArray.from_arrays([pa.array(joined(begin, np.int64)), pa.array(joined(end, np.int64)), pa.array(lang, pa.string())], names=["begin", "end", "lang"])
        offsets = np.concatenate([[0], np.cumsum(joined(n_spans, np.int64))]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(rows["lang"], pa.string()), pa.array(joined(rows["score"], np.float64)), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["lang", "score", "spans"])

    @staticmethod
    def _has_letters(block: Words, total: np.ndarray) -> np.ndarray:
        """Texts with a letter: an ASCII one, or a character beyond ASCII that is a letter."""
        plain = (block.data >= 0x61) & (block.data <= 0x7A)
        out = np.diff(np.concatenate([[0], np.cumsum(plain)])[block.text_start]) > 0
        for k in np.flatnonzero(~out & (total > 0)).tolist():
            out[k] = any(c.isalpha() for c in block.data[block.text_start[k] : block.text_start[k + 1]].tobytes().decode(errors="ignore"))
        return out


def fit(table: pa.Table | None) -> LanguageModel:
    """Fit to `text` and `lang` of a table; without rows, a model that names no language."""
    if table is None:
        return LanguageModel([], np.zeros((1 << BITS, 1), np.float32), np.zeros((len(_SCRIPTS), 1), bool))
    given = table.column("lang").to_pylist()
    languages = sorted(set(given))
    of = np.array([languages.index(x) for x in given])
    counts = np.zeros((1 << BITS, len(languages)))
    scripts = np.zeros((len(_SCRIPTS), len(languages)))
    for block in words(table.column("text").combine_chunks(), _LETTERS, lower=True):
        lang = of[block.row + block.text_of_word()]
        np.add.at(scripts, (word_scripts(block), lang), 1)
        for number, word in _runs(block):
            counts += np.bincount(number * len(languages) + lang[word], minlength=counts.size).reshape(counts.shape)
    total = counts.sum(0)
    table_ = np.log(counts + SMOOTH) - np.log(total + SMOOTH * len(counts))
    return LanguageModel(languages, table_.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", only: Column | None = None, sample: int = SAMPLE) -> LanguageModel:
    """Fit a model to documents with a language and a text, about `sample` of each language,
    by hashes of their ids and languages. `only` limits them further.

    Rows of one language that share an id count as one, with one of their texts. Of more than
    LANGUAGES different languages the commonest are learned.
    """
    rows = docs.filter(only) if only is not None else docs
    rows = rows.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.struct(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).alias("key"), F.col(text_col).alias("text"))
    keys = rows.groupBy("key").agg(F.lit(1).alias("one")).select("key", "key.lang")
    common = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    few = bounded_sample(keys.join(common, "lang", "left_semi"), "lang", "key", sample)
    return fitted(sampled_texts(few, rows, "key", "key", "text").filter("text IS NOT NULL"), "id", fit, F.col("key.id").alias("id"), "lang", "text")


def language(model: LanguageModel, docs: DataFrame, text: Column, penalty: float = SWITCH) -> Column:
    """`lang`, `score` (share of letters in it) and `spans` (byte ranges of one language) of a text.

    `lang` is `und`, with score 0 and no spans, if a text is null, has no letter, or no language
    was learned; equal shares go to the language that comes first by name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return F.arrow_udf(lambda texts: held.value.label(texts, penalty), _RESULT)(text)
