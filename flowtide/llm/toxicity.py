"""Toxicity by multiple-instance learning: documents are labelled, sentences are found.

A sentence scores by the sum of its words' weights; a word has weights for itself and for its
first and last bytes, so that inflected forms share what is learned. A document is toxic if any
sentence is: the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted to document
labels through the noisy-or; the sentences that make a document toxic then stand out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.sampling import bounded_sample, fitted, one_label, sampled_texts
from flowtide.llm.textbytes import ALPHANUMERIC, Words, class_table, segments_hash, words

#: labelled documents of each class that a model is fitted to, about
SAMPLE = 3000
#: words of a sentence, at most; longer runs without an end are cut
SENTENCE_WORDS = 32
#: sentences from here on are reported
OFFENDING = 0.5

BITS = 18
EPOCHS = 12
BATCH_DOCS = 64
RATE = 0.4
DECAY = 2e-4
#: words of documents that are counted at once, about
COUNTED_WORDS = 1 << 18
#: documents of the sample that have a feature, at least, for it to get a weight
MIN_DOCS = 5
PRIOR = -10.0
#: share of the features with weights on which labels do not depend, as expected
FALSE_FEATURES = 0.01

_AFFIXES = (4, 5, 6)
_ENDS = class_table(b".!?\n")
_RESULT = "struct<score:double,sentences:array<struct<begin:bigint,end:bigint,score:double>>>"


def _word_features(block: Words) -> np.ndarray:
    """A row of feature numbers for each word: itself, its first and its last 4, 5, 6 bytes."""
    kinds = [(block.start, block.end)]
    kinds += [(block.start, np.minimum(block.start + n, block.end)) for n in _AFFIXES]
    kinds += [(np.maximum(block.end - n, block.start), block.end) for n in _AFFIXES]
    out = np.empty((len(block.start), len(kinds)), np.int32)
    with np.errstate(over="ignore"):
        for k, (start, end) in enumerate(kinds):
            h = segments_hash(block.data, start, end) * np.uint64(2 * k + 1) + np.uint64(k)
            out[:, k] = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


def _sentences(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence, and the text it is in."""
    n = len(block.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = block.text_of_word()
    ends = np.cumsum(_ENDS[block.data])[block.start]
    new = np.ones(n, bool)
    new[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    first = np.flatnonzero(since % SENTENCE_WORDS == 0)
    return first, text[first]


def _repeats(block: Words) -> np.ndarray:
    """Whether each word is the one before it again: said many times is said once."""
    h = block.hashes()
    out = np.zeros(len(h), bool)
    out[1:] = h[1:] == h[:-1]
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, block: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, first word and text of each sentence."""
        first, text = _sentences(block)
        if not len(first):
            return np.zeros(0), first, text
        per_word = self.weights[_word_features(block)].sum(1, dtype=np.float64)
        per_word[_repeats(block)] = 0.0
        return self.bias + np.add.reduceat(per_word, first), first, text

    def scores(self, texts: pa.Array) -> pa.Array:
        """Score and offending sentences (byte ranges) of each text."""
        score, where, begin, end, p = [], [], [], [], []
        for block in words(texts, ALPHANUMERIC, lower=True):
            z, first, text = self.sentence_logits(block)
            n = len(block.first) - 1
            score.append(-np.expm1(-np.bincount(text, _softplus(z), n)))
            own = 1 / (1 + np.exp(-z))
            bad = np.flatnonzero(own >= OFFENDING)
            last = np.append(first, len(block.start))[bad + 1] - 1 if len(bad) else bad
            origin = block.text_start[text[bad]]
            begin.append(block.start[first[bad]] - origin)
            end.append(block.end[last] - origin)
            p.append(own[bad])
            where.append(np.bincount(text[bad], minlength=n))
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        inner = pa.StructArray.from_arrays([pa.array(flat(begin, np.int64)), pa.array(flat(end, np.int64)), pa.array(flat(p, np.float64))], names=["begin", "end", "score"])
        offsets = np.concatenate([[0], np.cumsum(flat(where, np.int64))]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(np.clip(flat(score, np.float64), 0, 1)), pa.ListArray.from_arrays(pa.array(offsets), inner)], names=["score", "sentences"])


def fit(table: pa.Table | None) -> ToxicityModel:
    """Fit to `text` and `toxic` (0 or 1) of a table; without both classes nothing is toxic."""
    model = ToxicityModel(np.zeros(1 << BITS, np.float32), PRIOR)
    labels = np.array(table.column("toxic").to_pylist(), float) if table is not None else np.zeros(0)
    if not 0 < labels.sum() < len(labels):
        return model
    # each different word once; sentences are runs of word numbers, documents runs of sentences;
    # features are made of words not met before only, and of a block four bytes a word stay
    known, seen, own, places, first, text, again, words_so_far = np.zeros(0, np.uint64), [], [], [], [], [], [], 0
    for block in words(table.column("text").combine_chunks(), ALPHANUMERIC, lower=True):
        f, t = _sentences(block)
        hashes, one, place = np.unique(block.hashes(), return_index=True, return_inverse=True)
        # in order of the text
        one = np.sort(one[~np.isin(hashes, known, assume_unique=True)])
        some = replace(block, start=block.start[one], end=block.end[one])
        known = np.concatenate([known, some.hashes()])
        seen.append(_word_features(some))
        own.append(hashes)
        places.append(place.astype(np.int32))
        again.append(_repeats(block))
        first.append(f + words_so_far)
        text.append(t + block.row)
        words_so_far += len(block.start)
    order = np.argsort(known)
    known, features = known[order], np.concatenate(seen)[order]
    numbers = np.concatenate([np.searchsorted(known, h).astype(np.int32)[p] for h, p in zip(own, places)])
    del seen, own, places, known
    numbers[np.concatenate(again)] = len(features)
    first, text = np.append(np.concatenate(first), words_so_far), np.concatenate(text)
    starts = np.searchsorted(text, np.arange(len(labels) + 1))  # first sentence of each document
    # features whose documents have one label oftener than chance explains get weights, and begin
    # at half their log odds; words without such features, and repeats, say nothing from here on
    proven, odds = _proven(features, numbers, first[starts], labels)
    usable = proven[features]
    says = np.append(usable.any(1), False)[numbers]
    first = np.searchsorted(np.flatnonzero(says), first)
    numbers = numbers[says]
    squares, bias_square = np.full(1 << BITS, 1e-6), 1e-6
    rng = np.random.default_rng(7)
    share = labels.mean()
    # both classes weigh the same in the fit
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    w = np.where(proven, 0.5 * odds, 0.0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH_DOCS):
            docs = np.sort(order[at : at + BATCH_DOCS])
            docs = docs[starts[docs] < starts[docs + 1]]
            if not len(docs):
                continue
            sentences = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs])
            length = first[sentences + 1] - first[sentences]
            inside = np.arange(int(length.sum())) + np.repeat(first[sentences] - (np.cumsum(length) - length), length)
            of_sentence = np.repeat(np.arange(len(sentences)), length)
            some, local = np.unique(numbers[inside], return_inverse=True)
            own = features[some]
            z = model.bias + np.bincount(of_sentence, (w[own] * usable[some]).sum(1)[local], len(sentences))
            total = np.bincount(owner, _softplus(z), len(docs))
            # of -log(noisy-or) for toxic documents, and of -log(1 - noisy-or) for the others
            slope = np.where(labels[docs] == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * weight[docs]
            by_sentence = slope[owner] / (1 + np.exp(-z)) / len(docs)
            by_word = np.bincount(local, by_sentence[of_sentence], len(some))
            counted = usable[some]
            touched, place = np.unique(own[counted], return_inverse=True)
            step = np.bincount(place.ravel(), np.broadcast_to(by_word[:, None], own.shape)[counted], len(touched)) + DECAY * w[touched]
            squares[touched] += step**2
            w[touched] -= RATE * step / np.sqrt(squares[touched])
            step = by_sentence.sum()
            bias_square += step**2
            model.bias -= RATE * step / np.sqrt(bias_square)
    model.weights = w.astype(np.float32)
    return model


def _proven(features: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that depend on the label, and their log odds: G test, false discoveries bounded.

    `bounds` has the first word of each document, with an end. Documents are counted some at a time.
    """
    n, at = len(labels), 0
    counts = np.zeros((2, 1 << BITS))
    while at < n:
        stop = max(int(np.searchsorted(bounds, bounds[at] + COUNTED_WORDS, side="right")) - 1, at + 1)
        part, label_of = numbers[bounds[at] : bounds[stop]], labels[at:stop]
        m = stop - at
        owner = np.repeat(np.arange(m), np.diff(bounds[at : stop + 1]))
        real = part < len(features)
        pairs = np.unique(part[real].astype(np.int64) * m + owner[real])
        word, doc = pairs // m, pairs % m
        for k in range(features.shape[1]):
            both = np.unique(features[word, k].astype(np.int64) * m + doc)
            for label in (0, 1):
                counts[label] += np.bincount((both // m)[label_of[both % m] == label], minlength=1 << BITS)
        at = stop
    size = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    g = np.zeros(1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        for having in (counts, size[:, None] - counts):
            expected = having.sum(0) * size[:, None] / n
            g += 2 * np.where(having > 0, having * np.log(having / expected), 0).sum(0)
    present = counts.sum(0) >= MIN_DOCS
    # the most features of which FALSE_FEATURES or less are expected to be chance (Benjamini-Hochberg)
    p = np.ones(1 << BITS)
    p[present] = [erfc(sqrt(max(x, 0.0) / 2)) for x in g[present].tolist()]
    ordered = np.sort(p[present])
    within = np.flatnonzero(ordered <= FALSE_FEATURES * np.arange(1, len(ordered) + 1) / max(len(ordered), 1))
    most = ordered[within[-1]] if len(within) else 0.0
    odds = np.log((counts[1] + 0.5) / (size[1] + 1)) - np.log((counts[0] + 0.5) / (size[0] + 1))
    return present & (p <= most), odds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", only: Column | None = None, sample: int = SAMPLE) -> ToxicityModel:
    """Fit a model to the labelled documents, about `sample` of each class, by hashes of their ids.

    `only` limits `labels` to some rows. Labels that are neither 0 nor 1, and labels without a
    document, are left out; an id's labels count as one, the commoner, and of its texts one is
    taken; a null text has no words.
    """
    rows = one_label(labels.filter(only) if only is not None else labels, id_col, label_col).withColumnRenamed("label", "toxic")
    few = bounded_sample(rows, "toxic", "key", sample)
    texts = sampled_texts(few, docs, "key", id_col, text_col).select("key", "toxic", "text")
    return fitted(texts, "key", fit)


def toxicity(model: ToxicityModel, docs: DataFrame, text: Column) -> Column:
    """`score` (0 to 1) and offending `sentences` (byte ranges and scores) of a text.

    A text without words, a null one too, scores 0. The model is some megabytes, whatever the data.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return F.arrow_udf(lambda texts: held.value.scores(texts), _RESULT)(text)


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """`docs` whose score is below the threshold; columns unchanged."""
    return docs.filter(toxicity(model, docs, F.col(text_col))["score"] < threshold)
