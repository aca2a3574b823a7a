"""Quality rules: decision lists learned by sequential covering, applied as Spark conditions.

A rule is a conjunction of thresholds on text statistics that says "drop". Rules are learned one
after the other on what the earlier ones leave: grown by the threshold with the best information
gain on one part of the labelled sample, pruned on the other part, kept while they are right
oftener than not. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.llm.common import fresh_name
from flowtide.llm.sampling import bounded_sample, fitted, one_label
from flowtide.llm.textbytes import NOT_WHITE, Words, class_table, mix, words

#: labelled rows of each class that rules are learned from, about
SAMPLE = 20_000
#: rules of a list, and thresholds of a rule, at most
MOST_RULES, MOST_TESTS = 16, 4
#: how often a rule has to be right on the part of the sample that it was not grown on
PRECISION = 0.8
#: candidate thresholds of a feature
CUTS = 32

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words"]
_RESULT = f"struct<{','.join(f'{c}:bigint' for c in STATISTICS)}>"
_SYMBOLS = class_table(b"#*$%&|<>")
_UPPER = class_table(bytes(range(0x41, 0x5B)))
_DIGITS = class_table(bytes(range(0x30, 0x3A)))
_MARKS = class_table(b"!?")
_STEP = np.uint64(0x9FB21C651E98DF25)


def _repeated_words(block: Words, h: np.ndarray) -> np.ndarray:
    """Whether each word is in a window of three words that its text has twice or more."""
    inside = np.zeros(len(h), bool)
    if len(h) < 3:
        return inside
    text = block.text_of_word()
    with np.errstate(over="ignore"):
        grams = mix((h[:-2] * _STEP + h[1:-1]) * _STEP + h[2:] + text[:-2].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    at = np.flatnonzero(text[2:] == text[:-2])
    order = at[np.argsort(grams[at], kind="stable")]
    same = grams[order][1:] == grams[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    if len(a) and not _equal_windows(block, a, b):
        return _repeated_words_exactly(block)
    hit = np.unique(np.concatenate([a, b]))
    for k in range(3):
        inside[hit + k] = True
    return inside


def _equal_windows(block: Words, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the windows of three words at a and b have equal bytes, each pair."""
    for k in range(3):
        la, lb = block.end[a + k] - block.start[a + k], block.end[b + k] - block.start[b + k]
        if (la != lb).any():
            return False
        inside = np.arange(int(la.sum())) - np.repeat(np.cumsum(la) - la, la)
        if (block.data[np.repeat(block.start[a + k], la) + inside] != block.data[np.repeat(block.start[b + k], la) + inside]).any():
            return False
    return True


def _repeated_words_exactly(block: Words) -> np.ndarray:
    """The same word by word, for a block in which two windows share a hash."""
    out = np.zeros(len(block.start), bool)
    for k in range(len(block.first) - 1):
        a, b = int(block.first[k]), int(block.first[k + 1])
        spelled = [block.word(i) for i in range(a, b)]
        places: dict[tuple[bytes, ...], list[int]] = {}
        for i in range(len(spelled) - 2):
            places.setdefault(tuple(spelled[i : i + 3]), []).append(a + i)
        for found in places.values():
            if len(found) > 1:
                for i in found:
                    out[i : i + 3] = True
    return out


def _block_statistics(block: Words) -> dict[str, np.ndarray]:
    n = len(block.first) - 1
    edges = block.text_start

    def per_text(members: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(members)])[edges])

    h = block.hashes()
    text = block.text_of_word()
    repeated = _repeated_words(block, h)
    different = np.unique(mix(h) + text.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), return_index=True)[1]
    lines, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    content = block.data.tobytes()
    for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        spoken = [line for line in content[a:b].split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
        lines[k], again[k] = len(spoken), len(spoken) - len(set(spoken))
    # a code point begins with a byte that goes on from no other
    begins = NOT_WHITE[block.data] & ((block.data & 0xC0) != 0x80)
    return {
        "n_words": block.counts,
        "word_chars": per_text(begins),
        "n_symbols": per_text(_SYMBOLS[block.data]),
        "n_dup_lines": again,
        "n_repeat_words": np.bincount(text[repeated], minlength=n),
        "n_lines": lines,
        "n_upper": per_text(_UPPER[block.data]),
        "n_digits": per_text(_DIGITS[block.data]),
        "n_marks": per_text(_MARKS[block.data]),
        "n_distinct_words": np.bincount(text[different], minlength=n),
    }


def _statistics(texts: pa.Array) -> pa.Array:
    found = [_block_statistics(block) for block in words(texts, NOT_WHITE)]
    columns = [pa.array(np.concatenate([f[c] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)) for c in STATISTICS]
    return pa.StructArray.from_arrays(columns, names=STATISTICS)


def statistics(text: Column) -> Column:
    """Counts of a whole text: STATISTICS. A null text counts as empty.

    Words are runs without ASCII white space. `word_chars` are code points in words, `n_symbols`
    characters of #*$%&|<>, `n_dup_lines` lines with a word that equal an earlier line,
    `n_repeat_words` words in three-word windows found twice or more, `n_marks` characters of !?.
    """
    return F.arrow_udf(_statistics, _RESULT)(text)


# -- features of the rules ------------------------------------------------------------------

#: what rules test, as SQL over the statistics; a text without words gets 0
FEATURES = {
    "words": "CAST({s}.n_words AS DOUBLE)",
    "mean_word_chars": "{s}.word_chars / greatest({s}.n_words, 1)",
    "symbols_per_word": "{s}.n_symbols / greatest({s}.n_words, 1)",
    "dup_line_share": "{s}.n_dup_lines / greatest({s}.n_lines, 1)",
    "repeat_share": "{s}.n_repeat_words / greatest({s}.n_words, 1)",
    "words_per_line": "{s}.n_words / greatest({s}.n_lines, 1)",
    "upper_share": "{s}.n_upper / greatest({s}.word_chars, 1)",
    "digit_share": "{s}.n_digits / greatest({s}.word_chars, 1)",
    "marks_per_word": "{s}.n_marks / greatest({s}.n_words, 1)",
    "distinct_share": "{s}.n_distinct_words / greatest({s}.n_words, 1)",
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def sql(self, statistics: str) -> str:
        return f"{FEATURES[self.feature].format(s=statistics)} {'>=' if self.above else '<'} {self.threshold!r}D"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    dropped: int
    covered: int

    def sql(self, statistics: str) -> str:
        return " AND ".join(t.sql(statistics) for t in self.tests)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.all([t.holds(x) for t in self.tests], axis=0)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def number(self, statistics: str) -> Column:
        """The first rule that holds, from 1; 0 if none does."""
        cases = "".join(f" WHEN {rule.sql(statistics)} THEN {k}" for k, rule in enumerate(self.rules, 1))
        return F.expr(f"CASE{cases} ELSE 0 END") if cases else F.lit(0)

    def text(self) -> str:
        return "\n".join(f"{k}. drop if {r.sql('s')} ({r.dropped} of {r.covered} labelled bad)" for k, r in enumerate(self.rules, 1))


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring quantiles, halfway between two values."""
    some = np.unique(values)
    if len(some) > CUTS:
        some = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1)))
    return (some[1:] + some[:-1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """Thresholds added one by one, each with the best information gain, until only bad rows are left."""
    inside, tests = np.ones(len(bad), bool), []
    while len(tests) < MOST_TESTS and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        base, best, chosen = np.log2(p / (p + n)) if p else -np.inf, 0.0, None
        if not p:
            break
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            for cut in _cuts(v).tolist():
                for above in (True, False):
                    holds = v >= cut if above else v < cut
                    hp = b[holds].sum()
                    if not hp:
                        continue
                    gain = hp * (np.log2(hp / holds.sum()) - base)
                    if gain > best + 1e-9:
                        best, chosen = gain, Test(name, above, cut)
        if chosen is None:
            break
        tests.append(chosen)
        inside &= chosen.holds(x)
    return tests


def _worth(tests: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    holds = Rule(tuple(tests), 0, 0).holds(x) if tests else np.ones(len(bad), bool)
    p, n = bad[holds].sum(), (~bad[holds]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(table: pa.Table | None) -> DecisionList:
    """A list from FEATURES columns, `bad` and `part` (0, 1 to grow, 2 to prune) of a table."""
    if table is None:
        return DecisionList(())
    x = {c: table.column(c).to_numpy() for c in FEATURES}
    bad, part = table.column("bad").to_numpy().astype(bool), table.column("part").to_numpy()
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MOST_RULES:
        grow, prune = left & (part < 2), left & (part == 2)
        if not bad[grow].any():
            break
        tests = _grow({c: v[grow] for c, v in x.items()}, bad[grow])
        some = {c: v[prune] for c, v in x.items()}
        while len(tests) > 1 and _worth(tests[:-1], some, bad[prune]) >= _worth(tests, some, bad[prune]):
            tests.pop()
        if not tests or _worth(tests, some, bad[prune]) < 2 * PRECISION - 1:
            break
        holds = left & Rule(tuple(tests), 0, 0).holds(x)
        rules.append(Rule(tuple(tests), int(bad[holds].sum()), int(holds.sum())))
        left &= ~holds
    return DecisionList(tuple(rules))


def train(counted: DataFrame, labels: DataFrame, statistics: str, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learn from the labelled rows of `counted`, which has a struct column `statistics`.

    About `sample` rows of each class (label 1 is good, 0 bad), by hashes of their ids, one row for
    each id, whose labels count as one, the commoner; other labels, and labels without a row, are
    left out. A list has MOST_RULES rules of MOST_TESTS tests at most; bad rows that more would
    cover are kept. Without bad rows the list is empty and drops
    nothing.
    """
    known = one_label(labels, id_col, label_col).select(F.col("key").alias("_key"), (F.col("label") == 0).cast("long").alias("bad"))
    features = [F.expr(sql.format(s=f"`{statistics}`")).cast("double").alias(name) for name, sql in FEATURES.items()]
    rows = counted.join(known, F.col(id_col) == F.col("_key")).select(F.col("_key").alias("key"), F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(3)).cast("long").alias("part"), "bad", *features)
    one = rows.groupBy("key", "part", "bad").agg(F.min(F.struct(*FEATURES)).alias("f")).select("key", "part", "bad", "f.*")
    return fitted(bounded_sample(one, "bad", "key", sample), "key", learn)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DecisionList]:
    """`docs` with a struct column `quality` (STATISTICS and `rule`, 0 if none drops the row), and the list.

    The struct gets underscores before its name if `docs` has that column.
    """
    name = fresh_name(docs, "quality")
    counted = docs.withColumn(name, statistics(F.col(text_col)))
    rules = train(counted.select(id_col, name), labels, name, id_col)
    return counted.withColumn(name, F.col(name).withField("rule", rules.number(f"`{name}`"))), rules
