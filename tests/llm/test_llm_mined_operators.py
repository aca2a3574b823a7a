"""Collocations, spelling variants, the kernel quality classifier; hot ids and large groups in earlier operators."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtide.llm import buckets, decontam, fourier, langid, mixing, overlaps, phrases, pii, rules, tokens, toxicity, variants
from flowtide.llm.queries import MIX_SQL, ORACLES, PHRASES_SQL, QUERIES, VARIANTS_SQL, tokenizer_file

from test_llm_text_operators import lower_ascii


def on_duck(sql, **tables):
    c = duckdb.connect()
    for name, table in tables.items():
        c.register(name, table)
    return c.sql(sql)


def rows_of(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", ["op2_mix_sources", "op11_collocations", "op12_spelling_variants"])
def test_query_against_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows_of(got, columns) == sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)


# -- buckets --------------------------------------------------------------------------------


def test_filters_let_all_frequent_hashes_pass(spark):
    rng = np.random.default_rng(3)
    some = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    hashes = np.concatenate([np.repeat(some[:200], 5), some])
    ranges = buckets.Ranges(3, {1: 64, 2: 64, 3: 64})
    classes_of = lambda g: (g >> np.uint64(13)).astype(np.uint16)

    def counted(batches):
        for batch in batches:
            g = batch.column(0).to_numpy().view(np.uint64)
            yield from buckets.bucket_rows(7, [g], ranges, [classes_of(g)])

    rows = spark.createDataFrame(pa.table({"h": hashes.view(np.int64)})).repartition(4)
    made = buckets.frequent(rows.mapInArrow(counted, buckets.PARTS), ranges, {7: [(1, 2), (2, 6)]}, "test", {2: 3})
    filters = buckets.Filters(ranges, [tuple(r) for r in made.collect()])
    assert filters.passes(1, some[:200]).all() and filters.passes(2, some[:200]).all()
    assert filters.passes(2, some[200:]).mean() < 0.05
    assert filters.passes(3, some[:200], False, classes_of(some[:200])).all()
    assert filters.passes(3, some[:200], False, classes_of(some[:200]) + np.uint16(1)).mean() < 0.05
    assert filters.passes(9, some[:3]).all() and not filters.passes(9, some[:3], unheld=False).any()
    assert buckets.Ranges.of(1 << 30, {1: 1 << 14, 2: 1 << 10}, 1 << 20).blocks == {1: 256, 2: 16}


# -- collocations ---------------------------------------------------------------------------


def phrase_table(seed=1, n=60):
    rng = random.Random(seed)
    words = ["new", "york", "city", "The", "of", "é", "日本", "x\x00y", "a", "b"]
    texts = []
    for _ in range(n):
        parts = [rng.choice(["new york city", "new york", "of the", rng.choice(words), "a b a b a"]) for _ in range(rng.randrange(0, 40))]
        texts.append(rng.choice([" ", "  ", "\t"]).join(parts + [rng.choice([".", "!", "\n", ","])] + parts[:5]))
    langs = [rng.choice(["en", "fr", None, "und", ""]) for _ in texts]
    rows = list(zip(range(n), langs, texts))
    return rows + [(1, "en", None), (2, None, None), (3, "en", ""), (4, "en", " .. ,"), (5, "solo", "one"), (6, "en", "new york city " * 3000)]


@pytest.mark.parametrize("limits", [{}, dict(shard_phrases=3, filter_bytes=1 << 14)])
def test_collocations_by_sql(spark, limits, monkeypatch):
    rows = phrase_table()
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    table = pa.table({"doc_id": [r[0] for r in rows], "lang": [r[1] for r in rows], "text": [r[2] for r in rows]})
    if limits:
        monkeypatch.setattr(buckets, "RANGE_BYTES", 1 << 12)  # many ranges, several passes
    got = phrases.collocations(docs.repartition(5), **limits)
    want = on_duck(PHRASES_SQL, documents=table)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == columns
    wanted = sorted(want.fetchall(), key=repr)
    assert rows_of(got, columns) == wanted and len(wanted) > 20
    assert {r[0] for r in wanted} >= {"und", "en", "fr"} and any(len(r[2].split(" ")) == 3 for r in wanted)


def test_collocations_of_few_or_no_texts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    one = spark.createDataFrame([("en", "a b " * 9)], "lang string, text string")
    assert phrases.collocations(one).count() == 0
    one = spark.createDataFrame([("en", "a b " * 11)], "lang string, text string")
    # b a has as many occurrences as a b a around it, and so has a b
    assert [(r.phrase, r.a) for r in phrases.collocations(one).collect()] == [("a b a", 10), ("b a b", 10)]


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**14 + 3, 10**13 + 1), (10, 10, 10), (10, 11, 10), (3 * 10**9, 3 * 10**9, 4 * 10**9)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", phrases._score("a", "l", "r"))
    assert [r.s for r in df.collect()] == [10**6 * a * a // (l * r) for a, l, r in rows]


def test_double_array_holds_all_families():
    rng = np.random.default_rng(4)
    n = 3000
    pairs = np.unique(np.concatenate([np.stack([np.ones(2500, np.int64), rng.permutation(n)[:2500] + 1], 1), rng.integers(1, n + 1, (4000, 2))]), axis=0)
    array = phrases.DoubleArray(n)
    states = array.add(pairs[:, 0], pairs[:, 1])
    assert len(np.unique(states)) == len(pairs)
    on, after = array.step(pairs[:, 0], pairs[:, 1])
    assert len(on) == len(pairs) and (after == states).all()
    known = {tuple(p) for p in pairs.tolist()}
    other = np.array([p for p in rng.integers(1, n + 1, (5000, 2)).tolist() if tuple(p) not in known])
    assert len(array.step(other[:, 0], other[:, 1])[0]) == 0
    assert len(array.check) < 40 * n


# -- spelling variants ----------------------------------------------------------------------


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower_ascii(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    vocab = {w: n for w, n in counts.items() if n >= 2}
    near = defaultdict(set)
    for w in vocab:
        for v in vocab:
            if w != v and abs(len(w) - len(v)) < 2:
                short, long = sorted((w, v), key=len)
                if len(w) == len(v) and sum(a != b for a, b in zip(w, v)) == 1 or len(w) != len(v) and any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
                    near[w].add(v)
    form = {}
    for w, n in vocab.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-vocab[v], v))
            form[w] = best if vocab[best] >= 10 * n else None

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), vocab[form[w]] if form.get(w) else None) for w, n in vocab.items())


def variant_docs(seed=2):
    rng = random.Random(seed)
    bases = ["possible", "possibly", "grössere", "straßen", "naïvetés", "abcdefg", "mississippi", "ÀÉÎÕÜßab", "×÷×÷×÷×"]
    docs = []
    for i in range(700):
        words = []
        for _ in range(12):
            w = bases[min(int(rng.expovariate(0.8)), len(bases) - 1)]
            if rng.random() < 0.08:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + rng.choice("aéz") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        docs.append((i if i % 50 else None, rng.choice([" ", ",", "1"]).join(words)))
    long = "q" * 300_000
    return docs + [(9, None), (10, ""), (11, "short"), (12, f"{long} {long} {long}x"), (13, f"{long} {long}x " + "ab" * 25 + " " + "ab" * 25 + " " + "ab" * 24 + "c ab")]


@pytest.mark.parametrize("pass_slices", [1, 1 << 10])
def test_variants_by_brute_force(spark, pass_slices, monkeypatch):
    rows = variant_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(variants, "SLICE_WORDS", 3)  # several slices of a shard
    monkeypatch.setattr(variants, "near_pairs", lambda vocab, f=variants.near_pairs: f(vocab, pass_slices))
    got = variants.variants(variants.vocabulary(variants.slipped_runs(docs)))
    want = plain_variants(rows)
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()) == want
    assert any(w[1] and w[2] != w[1] for w in want) or any(w[1] for w in want)
    assert max(len(w[0]) for w in want) > 100_000


def test_chains_of_forms_end_at_their_root(spark):
    words = [("aaaaaaa", 5_000_000), ("aaaaaab", 40_000), ("aaaaabb", 3_000), ("aaaabbb", 20), ("aaabbbb", 2), ("zzzzzzz", 2)]
    got = {r.word: (r.form, r.root, r.n_near) for r in variants.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaabbbb"] == ("aaaabbb", "aaaaaaa", 1) and got["aaaabbb"] == ("aaaaabb", "aaaaaaa", 2)
    assert got["aaaaaaa"] == (None, "aaaaaaa", 1) and got["zzzzzzz"] == (None, "zzzzzzz", 0)
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.variants(empty).count() == 0


# -- kernel classifier ----------------------------------------------------------------------


def test_statistics_of_texts(spark):
    texts = ["The cat sat. The cat sat.", "", None, "AAA!! BBB!!", "a\na\nb", "é ü 1234 #tag " * 50_000]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fourier.statistics(F.col("t")).alias("x")).collect()]
    named = [dict(zip(fourier.STATISTICS, x)) for x in got]
    assert not any(named[1].values()) and not any(named[2].values())
    assert named[0]["log_words"] == pytest.approx(np.log(7)) and named[0]["different_words"] == pytest.approx(0.5)
    assert named[0]["repeated_threes"] == pytest.approx(0.25) and named[3]["upper"] == pytest.approx(6 / 11)
    assert named[4]["repeated_lines"] == pytest.approx(1 / 3) and named[5]["with_symbols"] == pytest.approx(0.25)


def test_normal_equations_and_isotonic(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(fourier.STATISTICS)))
    y = (x[:, 0] > 0).astype(float)
    kernel = fourier.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rows = spark.createDataFrame(pa.table({"x": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), "y": y, "fold": pa.array(np.arange(400) % fourier.FOLDS, pa.int32())})).repartition(6)
    parts = fourier._normal_equations(rows, kernel)
    z = np.hstack([kernel.features(x.astype(np.float32).astype(float)), y[:, None]])
    for f, m in parts.items():
        own = z[np.arange(400) % fourier.FOLDS == f]
        assert np.allclose(m, own.T @ own)
    w = fourier._ridge(sum(parts.values()), 1.0)
    assert np.isclose(fourier._squares(sum(parts.values()), w), ((z[:, :-1] @ w - y) ** 2).sum())
    at, value = fourier.isotonic(np.arange(6.0), np.array([1, 1, 2, 1, 1, 1.0]), np.array([0, 1, 0, 1, 0, 1.0]))
    assert (np.diff(value) > 0).all() and value.tolist() == [0.0, pytest.approx(1 / 3), 0.5, 1.0]


def test_quality_held_out(spark, sf_dir):
    large = sf_dir.replace("0.001", "0.01")
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{large}/labels.parquet'").fetchall())
    rows = QUERIES["op13_kernel_quality"](spark, large).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{large}/documents.parquet'").fetchall()[0][0]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows} == {True}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.97


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, x string"
    docs = spark.createDataFrame([(1, None, "u"), (None, "", "u"), (1, "good text of words", "v"), (1, "good text of words", "v"), (2, "w " * 30_000, "w")], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (None, 1), (7, 1), (2, 5)], "doc_id long, quality int")
    got = fourier.scored(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = fourier.scored(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-3 for r in none)
    assert fourier.scored(docs.limit(0), labels).count() == 0
    assert min(r.score for r in fourier.scored(docs, spark.createDataFrame([(1, 1)], labels.schema)).collect()) > 0.99


# -- one id on many rows, large groups ------------------------------------------------------


def test_mix_takes_one_filler_row(spark):
    rows = [(7, "w " * 40, "a")] * 200 + [(i, "w " * 11, "b") for i in range(100, 160)] + [(i, "v " * 9, "c") for i in range(200, 240)] + [(None, "n " * 7, "c")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix_sources(docs).select("doc_id", "source", "mix.size", "mix.target", "mix.taken").collect()
    for source in "abc":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    got = sorted(((r.doc_id, r.size, r.taken) for r in found if r.doc_id is not None), key=repr)
    assert got == sorted(on_duck(f"SELECT doc_id, size, taken FROM ({MIX_SQL}) WHERE doc_id IS NOT NULL", documents=table).fetchall(), key=repr)


def test_items_without_an_id_still_hit(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(None, " ".join(words[:12])), ("b", " ".join(words[20:25])), ("b", None), (None, None), ("c", "")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:12]) + " y"), (2, " ".join(words[19:30])), (3, "none"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.hits.n_hit, r["hits"]["items"]) for r in decontam.find_contamination(docs, benchmark).collect()}
    assert got == {1: (12, []), 2: (5, ["b"]), 3: (0, []), 4: (0, [])}


def test_long_items_and_several_sets(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"t{rng.randrange(10**6)}" for _ in range(3000)]
    items = [("long", " ".join(words)), ("one", " ".join(words[100:110])), ("other", "p q r s t u v w x y z")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    texts = [" ".join(words[a : a + 25]) for a in range(0, 2975, 7)] + ["p q r s t u v w x y", "clean text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = rows_of(decontam.find_contamination(docs, benchmark).select("doc_id", "hits.*"), ["doc_id", "n_hit", "items"])
    monkeypatch.setattr(decontam, "PIECE_WORDS", 50)
    monkeypatch.setattr(decontam, "SET_BYTES", 4000)
    assert rows_of(decontam.find_contamination(docs, benchmark).select("doc_id", "hits.*"), ["doc_id", "n_hit", "items"]) == whole
    assert all(n == 25 for i, n, _ in whole if i < 425)


@pytest.mark.parametrize("kind", ["letters and digits", "words and an address"])
def test_long_texts_without_values(kind):
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=1 << 20))
    if kind != "letters and digits":
        text = "a." * (1 << 18) + "@ " + text
    worker = pii.Pseudonymiser(b"k" * 16, False)
    begun = time.perf_counter()
    found, counts = worker.replace(text + " amy.lee@mail.example.com")
    assert time.perf_counter() - begun < 4 and sum(counts) == 1
    assert found.startswith(text) and found.endswith("@mail.example.com") and "amy.lee" not in found


def test_one_id_on_a_third_of_the_rows(spark):
    """Samples for fitting take one row of an id; token files deal its rows over several shards."""
    rng = random.Random(3)
    names = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(names, k=20)) for _ in range(900)]
    ids = [5 if i % 3 == 0 else 1000 + i for i in range(900)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in zip(ids, texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, k % 2, int(k % 3 > 0)) for k, i in enumerate(ids)], "doc_id long, toxic int, quality int")
    seen = []
    for module, train in ((toxicity, lambda: toxicity.train(docs, labels, sample=100)), (langid, lambda: langid.train(docs, sample=100)), (rules, lambda: rules.train(docs.select("doc_id", rules.statistics(F.col("text")).alias("s")), labels, "s", sample=100))):
        keep = module.fitted

        def counting(sample, *a, keep=keep):
            seen.append(sample.count())
            return keep(sample, *a)

        module.fitted = counting
        try:
            train()
        finally:
            module.fitted = keep
    assert all(100 < n < 280 for n in seen) and len(seen) == 3
    hot = docs.withColumn("doc_id", F.lit(5).cast("long")).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = tokens.shared_path(spark, "hot")
        sizes = [r.n_docs for r in tokens.write_token_files(hot, folder, tokenizer_file()).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 900 and max(sizes) < 400


def test_five_thousand_near_copies(spark):
    """Copies of a text with 1 to 9 of 300 words replaced: links by brute force over all pairs, from the places replaced."""
    rng = np.random.default_rng(6)
    n, size = 5000, 300
    base = [f"base{i}" for i in range(size)]
    replaced = np.zeros((n, size), bool)
    texts = []
    for i in range(n):
        at = rng.choice(size, rng.integers(1, 10), replace=False)
        replaced[i, at] = True
        texts.append(" ".join(f"x{i}p{k}" if replaced[i, k] else w for k, w in enumerate(base)))
    kept = np.stack([~replaced[:, k : k + 5].any(1) for k in range(size - 4)], 1).astype(np.float32)
    common = kept @ kept.T
    linked = common >= 0.8 * (2 * (size - 4) - common) - 1e-6
    label = np.arange(n)
    while True:
        after = np.array([min(label[row].min(initial=n), label[i]) for i, row in enumerate(linked)])
        after = np.minimum(after, after[after])
        if (after == label).all():
            break
        label = after
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = sorted(r.doc_id for r in overlaps.without_near_duplicates(docs).collect())
    assert got == sorted(set(label.tolist())) and 100 < len(got) < n - 100


def test_collocations_over_several_shards_of_a_pass(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(["en", "de"][i % 2], " ".join(f"w{k}" for k in rng.integers(0, 6, 60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    whole = sorted(phrases.phrase_counts(docs, 3)[0].collect())
    reads, plain = [], phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda held: (reads.append(sorted(held)), plain(held))[1])
    monkeypatch.setattr(phrases, "SUMMED", 1)  # sums are sent in parts
    assert sorted(phrases.phrase_counts(docs, 3, shard_phrases=100)[0].collect()) == whole
    assert len(reads[0]) == 4 and len(reads) * 4 >= max(max(r) for r in reads) + 1 > 4
