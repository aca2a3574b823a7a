"""Operators across texts: SimHash links, mixing, repeated strings, token files, URL filters, pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from datetime import date, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from flowtide.llm import anchors, mixing, overlaps, simhash, suffixes, tokens, urls
from flowtide.llm.common import fresh_name, shared_path, shared_root
from flowtide.llm.components import components
from flowtide.llm.queries import MIX_SQL, ORACLES, QUERIES, tokenizer_file

from test_llm_text_operators import lower_ascii


def groups_of(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_shared_root_is_the_session_setting(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert fresh_name(spark.range(1).toDF("X"), "x") == "_x"


# -- components and SimHash -----------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    edges = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    label = groups_of(600, links)
    assert got == {i: label[i] for i in range(600) if any(i in (a, b) and a != b for a, b in links)}
    assert components(edges.limit(0)).count() == 0


def plain_fingerprint(text, n=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_shingles(text, n=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_near_duplicates(rows, similarity=0.8):
    """The smallest id of each group of texts whose shingle sets have that Jaccard similarity; all pairs that share a shingle."""
    rows = sorted(rows)
    sets = [plain_shingles(text) for _, text in rows]
    groups, having = {}, {}
    for i, s in enumerate(sets):
        groups.setdefault(s, []).append(i)
        for x in s:
            having.setdefault(x, []).append(i)
    links = [(g[0], i) for g in groups.values() for i in g]
    for i, j in {(i, j) for x in having.values() for i in x for j in x if i < j}:
        both = len(sets[i] & sets[j])
        if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links.append((i, j))
    label = groups_of(len(rows), links)
    return [row[0] for k, row in enumerate(rows) if label[k] == k]


TEXTS = ["The cat sat on the mat", "the  CAT\tsat on\nthe mat", "", None, "two words", "é 日 word", "a " * 3000, "Z" * 200_000, "the cat sat on the mat"]


def test_fingerprints(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = docs.select("text", simhash.fingerprint(F.col("text")).alias("f"), simhash.hex_text(simhash.fingerprint(F.col("text"))).alias("h")).collect()
    for r in rows:
        assert r.h == f"{plain_fingerprint(r.text):016x}"


@pytest.mark.parametrize("block, radius", [(2048, 3), (16, 3), (64, 2)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, block, radius):
    monkeypatch.setattr(simhash, "BLOCK", block)  # small blocks meet pairwise
    rng = np.random.default_rng(block)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, int(rng.integers(1, 6))).astype(np.uint64)) for s in seeds for _ in range(12)]
    # one half shared by many, as a long group of near copies would
    hot = (rng.integers(0, 1 << 32, 150, dtype=np.uint64)) | (np.uint64(0xABCDEF01) << np.uint64(32))
    fps = np.unique(np.concatenate([seeds, near, hot, rng.integers(0, 1 << 63, 200, dtype=np.uint64), [np.uint64(0)]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.near_links(df, radius).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    want = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius]
    assert groups_of(len(fps), [(at[r.a], at[r.b]) for r in links]) == groups_of(len(fps), want)
    assert len(links) < max(4 * len(fps), 10)


def test_thresholds_cover_and_cost_least():
    bits = simhash.group_bits(np.eye(64), 10, 4)
    assert sorted(sum(bits, [])) == list(range(64)) and [len(b) for b in bits] == [16] * 4
    plan = simhash.Parts(bits, 3, 1000, [(np.array([5], np.uint64), np.array([900.0]))] + [(np.zeros(0, np.uint64), np.zeros(0))] * 3, [1.0] * 4, [0.01] * 4)
    values = [np.array([5, 6], np.uint64)] + [np.array([1, 2], np.uint64)] * 3
    got = plan.thresholds(values)
    assert (got.sum(1) == 3 - 4 + 1).all() and got[0, 0] == -1  # the frequent value is not probed


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64))
    x[:, 40] = x[:, 0]
    x[:, 63] = x[:, 0]
    parts = simhash.group_bits((x.T @ x).astype(float), 500, 4)
    assert {0, 40, 63} <= set(parts[0])


def test_near_duplicates_of_rows(spark):
    docs = spark.createDataFrame([(10 - i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "lonely words here", "c"), (4, "clashing id", "c")], "doc_id long, text string, component string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r.doc_id: r.component for r in rows if r.doc_id not in (None, 4)}
    assert by[10] == by[9] == by[2] == 2 and by[8] == by[7] == 7
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(-1, "lonely words here"), (2, TEXTS[8]), (7, ""), (6, TEXTS[4]), (5, TEXTS[5]), (4, TEXTS[6]), (4, "clashing id"), (3, TEXTS[7])])
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0


# -- similar sets of shingles ---------------------------------------------------------------


@pytest.mark.parametrize("block, filters", [(1024, 1 << 25), (3, 64)])
def test_stage_links_all_similar_texts(spark, monkeypatch, block, filters):
    import corpus_pipeline as cp

    monkeypatch.setattr(overlaps, "BLOCK", block)  # small blocks meet pairwise
    monkeypatch.setattr(overlaps, "FILTER_BYTES", filters)  # filters that let all through lose nothing
    rng = random.Random(3)
    seeds = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 14, 60, 130]))] for _ in range(25)]
    texts = []
    for k, seed in enumerate(seeds):
        # the first is a large group of near copies around the limit
        for _ in range(60 if k == 0 else 8):
            w = list(seed)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w if rng.random() < 0.8 else w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)]))
    texts += ["", None, " ", "one two", "ONE  two", "one two three"]
    rng.shuffle(texts)
    sets = []
    for text in texts:
        w = lower_ascii(text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or (a & b and len(a & b) / len(a | b) >= 0.8)]
    label = groups_of(len(texts), links)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = cp.drop_near_duplicates(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert cp.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


# -- mixing ---------------------------------------------------------------------------------


def filled(sizes, weights, share=1.0):
    """Targets by resharing what is above three times a source until nothing is."""
    words = sum(sizes) * share
    target, capped = {}, set()
    while True:
        left = words - sum(3 * sizes[i] for i in capped)
        total = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = {i: 3 * sizes[i] if i in capped else left * weights[i] / total for i in range(len(sizes))}
        above = {i for i in target if target[i] > 3 * sizes[i] + 1e-9}
        if not above:
            return target
        capped |= above


def test_mix_reaches_targets_and_repeats(spark):
    rng = np.random.default_rng(2)
    sources = ["a", "b", "é", "日", None, "tiny"]
    rows = [(i, "w " * int(rng.integers(0, 30)), sources[int(rng.integers(0, 5))], "x") for i in range(600)] + [(900, "w w", "tiny", "x"), (901, None, "a", "x"), (5, "twin twin", "a", "x"), (5, "twin twin", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix string")
    got = mixing.mix_sources(docs)
    assert got.columns == [*docs.columns, "_mix"] and got.count() == len(rows)
    found = [(r.doc_id, r.source, r["_mix"]) for r in got.collect()]
    order = sorted([s for s in set(sources) if s is not None]) + [None]
    sizes = [sum(m["size"] for _, s, m in found if s == o) for o in order]
    want = filled(sizes, [k % 3 + 1 for k in range(len(order))])
    for k, s in enumerate(order):
        some = [m for _, o, m in found if o == s]
        assert some[0].target == pytest.approx(want[k]) and some[0].source_size == sizes[k]
        assert abs(sum(m.taken for m in some) - want[k]) <= 3
        assert all(m.taken == m["size"] * m.copies and m.copies <= 3 for m in some)
        assert len({m.copies for m in some}) <= 3
    again = {(r.doc_id, r.text, r["_mix"]) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r["_mix"]) for r in got.collect()}
    assert mixing.mixed(docs).count() == sum(m.copies for *_, m in found)


def test_likelier_documents_are_taken_oftener(spark):
    rows = [(i, "w " * 10, "a" if i < 1000 else "b", 3.0 if i % 2 else 1.0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    found = mixing.mix_sources(docs, weights=weights, share=0.2, relative_weight="q").filter("source = 'b'").groupBy("q").agg(F.sum("mix.taken").alias("t")).collect()
    taken = {r.q: r.t for r in found}
    assert taken[3.0] > 1.8 * taken[1.0] and sum(taken.values()) == pytest.approx(3000, abs=10)


@pytest.mark.parametrize("module, write, step", [
    (mixing, "stored", lambda docs: mixing.mixed(docs)),
    (overlaps, "stored_tidily", lambda docs: overlaps.without_near_duplicates(docs)),
])
def test_tables_between_steps_keep_plans_small(spark, monkeypatch, module, write, step):
    """The driver holds each plan, and again at every update of it: none repeats the steps before."""
    sizes, plain = [], getattr(module, write)

    def counted(df, purpose):
        sizes.append((len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()), purpose))
        return plain(df, purpose)

    monkeypatch.setattr(module, write, counted)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(30))) for _ in range(40)]
    docs = spark.createDataFrame([(k, rng.choice([None, "x", "y"]), t) for k, t in enumerate(texts + texts[:5])], "doc_id long, source string, text string")
    assert step(docs).count()
    assert max(sizes)[0] <= 40, max(sizes)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, None)], empty.schema)).select("mix.taken", "mix.target").collect() == [(0, 0.0)]


# -- repeated strings -----------------------------------------------------------------------


def plain_repeats(rows, window):
    """(id, text) in order: removed flags of each text."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(w)
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_anchors_are_the_least_grams(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        data = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(90, 700))).astype(np.uint8)
        if rng.random() < 0.3:
            data = np.tile(data[:7], 60)
        at, gram, first, last = anchors.anchors(data, 100)
        if len(data) < 100:
            assert not len(at)
            continue
        h = anchors.rolling_hash(data, anchors.GRAM)
        want = [p + int(np.argmin(h[p : p + 101 - anchors.GRAM])) for p in range(len(data) - 99)]
        assert [a for a, s, e in zip(at, first, last) for _ in range(s, e + 1)] == want and (h[at] == gram).all()


def test_pieces_of_a_long_text_agree(monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    whole = anchors.anchors(data, 100)
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 130)
    assert all(np.array_equal(a, b) for a, b in zip(whole, anchors.anchors(data, 100)))


def repeat_corpus(seed, clash):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, short, long = line(260), line(99), line(6000)
    rows = [line(300), passage, line(150) + passage + line(80), passage[:130] + line(50) + passage[100:], "ab" * 400, "ab" * 300, None, "", short, short, long, line(40) + long[700:5200] + line(30), long]
    rows += [line(rng.randrange(60)) + passage[rng.randrange(60) :] + line(rng.randrange(60)) for _ in range(25)]
    rows += [passage[rng.randrange(40) : 160 + rng.randrange(100)] for _ in range(10)]
    ids = [rng.randrange(12) if clash else 3 * i + 1 for i in range(len(rows))]
    if not clash:
        rng.shuffle(ids)
    pairs = list(zip(ids, rows))
    return pairs + [pairs[2], (None, rows[1])] if clash else pairs


@pytest.mark.parametrize("seed, clash", [(1, False), (2, True), (3, False)])
def test_repeats_as_plain_search(spark, seed, clash):
    rows = repeat_corpus(seed, clash)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, u string").repartition(5)
    got = suffixes.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "u", "repeats"]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for (i, t), gone in zip(order, plain_repeats(order, 100)):
        data = (t or "").encode()
        want.append((i, len(data), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(b for b, g in zip(data, gone) if not g)))
    found = [(r.doc_id, r.repeats.n_bytes, r.repeats.n_removed, len(r.repeats.spans), bytes(r.repeats.kept)) for r in got.collect()]
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_no_repeats_in_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty).count() == 0
    one = spark.createDataFrame([(1, "short")], empty.schema)
    assert suffixes.without_repeats(one).select("repeats.n_bytes", "repeats.n_removed").collect() == [(5, 0)]


# -- token files ----------------------------------------------------------------------------

ODD = ["a  b", "a \nb", "a\n\n b", "a \n", "  x ", "\n\n", "don't 'tis it's\n's", "a\tb \t c", "x y", "", " ", "日本 語。\n 12 3a", "<|endoftext|> a", "The cat. Sat!! on,the mat", "a'll !x", "wordé日 é.", " x  y "]


def test_units_do_not_change_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    plain.encode_special_tokens = True
    encoder = tokens.Encoder(tokenizer_file(), True)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\n  abS'st.,1é日\t😀-!x") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    got = encoder.encode(texts) + encoder.encode(texts[:40])
    for text, ids in zip(texts + texts[:40], got):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = random.Random(2)
    pieces = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", " word", "\t", ".", "é"]
    texts = ODD + ["a <|endoftext|> b", "x<|endoftext|>y", "<|ENDOFTEXT|>"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    encoder = tokens.Encoder.of(tokenizer_file(), True)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    for r in tokens.token_table(docs, tokenizer_file()).collect():
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_cache_starts_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 3)
    encoder = tokens.Encoder(tokenizer_file(), True)
    for text in ("one two three four five", "six seven one", "one two"):
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    rows = [(2 * i, "word number %d " % i * (i % 40)) for i in range(300)] + [(7, None), (9, ""), (8, "same id"), (8, "again"), (None, "no id"), (11, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(4)
    folder = shared_path(spark, "test-tokens")
    shards = tokens.write_token_files(docs, folder, tokenizer_file(), sequence=64)
    got = tokens.read_token_files(shards, folder, tokens.ids_crc32).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    start, everything = 0, []
    for (i, text), r in zip(order, sorted(got, key=lambda r: r.start)):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.digest) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        everything += ids
    # equal-length sequences, mapped one by one, with a mask of what is padding
    read = []
    for s in shards.orderBy("shard").collect():
        reader = tokens.ShardReader(folder, s.shard)
        for k in range(-(-s.n_tokens // 64)):
            ids, mask = reader.sequence_at(k)
            assert len(ids) == len(mask) == 64 and ids.base is not None
            read += ids[mask].tolist()
    assert read == everything
    names = os.listdir(folder.removeprefix("file://"))
    assert all(n.startswith(("ids-", "docs-", "shards")) for n in names)
    assert tokens.token_table(docs.limit(0), tokenizer_file()).count() == 0


# -- URL filters ----------------------------------------------------------------------------


def plain_reasons(url, day, entries):
    import re

    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", (url or "").lower())
    if not m or day is None:
        return []
    host = m[1].rstrip(".")
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*).*$", r"\1", url, flags=re.S)
    segments = [s for s in path.split("/") if s]
    cover = {host} | {host.split(".", k)[-1] for k in range(host.count(".") + 1)} | {host + "/" + "/".join(segments[:k]) for k in range(1, len(segments) + 1)}
    out = []
    for key in {(e[0], e[1]) for e in entries if None not in e}:
        own = sorted(((e[2], not e[3]) for e in entries if None not in e and (e[0], e[1]) == key and e[2] <= day))
        if own and key[1] in cover and not own[-1][1]:
            out.append(":".join(key))
    return sorted(out)


def test_captures_meet_the_entries_of_their_day(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "example.org", "x.example.org"]
    d0 = date(2023, 11, 20)
    pattern = lambda: rng.choice([*hosts, "example.com", "com", "a.example.com/p", "a.example.com/p/q", "example.org/p"])
    entries = [(rng.choice("mn"), pattern(), d0 + timedelta(rng.randrange(150)), rng.random() < 0.6) for _ in range(120)] + [(None, "com", d0, True), ("m", None, d0, True), ("m", "com", None, True)]
    url = lambda: rng.choice(["http://", "HTTPS://u:p@"]) + rng.choice([*hosts, "A.Example.com.", "other.net"]) + rng.choice(["", ":80", "/"]) + rng.choice(["", "/p", "/p/q/r?x=/z", "/P#p", "//p//q"])
    captures = [(i, url(), d0 + timedelta(rng.randrange(-20, 200))) for i in range(300)] + [(300, None, d0), (301, "not a url", d0), (302, "http://a.example.com/", None), (303, "http://", d0), (5, "http://example.org/p", d0)]
    captures.append(captures[0])
    got = urls.filter_captures(spark.createDataFrame(captures, "key long, url string, day date"), spark.createDataFrame(entries, "list string, pattern string, noted date, added boolean"))
    rows = sorted((r.key, r.url or "", str(r.day), r.reasons, r.blocked) for r in got.collect())
    want = sorted((k, u or "", str(d), r := plain_reasons(u, d, entries), bool(r)) for k, u, d in captures)
    assert rows == want and any(len(r[3]) > 1 for r in rows)
    none = spark.createDataFrame([], "list string, pattern string, noted date, added boolean")
    assert urls.filter_captures(got.select("key", "url", "day"), none).filter("blocked").count() == 0
    assert urls.filter_captures(got.select("key", "url", "day").limit(0), none).count() == 0


# -- registered queries ---------------------------------------------------------------------


def in_duckdb(sf_dir, sql):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.sql(sql).df()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), in_duckdb(sf_dir, ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert key(got).equals(key(want))
    assert "WITH sized" in MIX_SQL


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


def test_repeat_query_by_plain_search(spark, sf_dir):
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in QUERIES["op4_repeated_strings"](spark, sf_dir).collect()}
    for (i, text), gone in zip(rows, plain_repeats(rows, 100)):
        data = (text or "").encode()
        kept = bytes(b for b, g in zip(data, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())


def test_held_out_languages_and_toxicity(spark, sf_dir):
    large = sf_dir.replace("0.001", "0.01")
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{large}/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op6_language"](spark, large).collect()]
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows} == {True}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{large}/labels.parquet'").fetchall())
    scored = [r for r in QUERIES["op5_toxicity"](spark, large).collect() if r.held_out and r.doc_id in toxic]
    assert not [r for r in scored if r.predicted and not toxic[r.doc_id]]
    assert np.mean([r.predicted for r in scored if toxic[r.doc_id]]) > 0.6


def test_pipeline_by_plain_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = before.collect(), docs.collect()
    # near-duplicates: one document of each group of texts with similar sets of five-word shingles
    before, after = rows["near_duplicates"]
    assert sorted(r.doc_id for r in after) == plain_near_duplicates([(r.doc_id, r.text) for r in before])
    # decontamination: rows without a hit by plain search
    from test_llm_text_operators import plain_hits

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = rows["decontamination"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not plain_hits(r.text, items, 10)[1])
    # the mix, by its SQL over what came before it
    before, after = rows["mixing"]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": [r.doc_id for r in before], "text": [r.text for r in before], "source": [r.source for r in before]}))
    taken = c.sql(f"SELECT doc_id, taken // greatest(size, 1) AS n FROM ({MIX_SQL})").fetchall()
    assert sorted(r.doc_id for r in after) == sorted(i for i, n in taken for _ in range(int(n)))
    # tokens of every row of the mix
    assert len(rows["tokens"][1]) == len(after) and min(r.start for r in rows["tokens"][1]) == 0
    # with some tens of labels few toxic documents are sure enough to go, and no other does
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    before, after = rows["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(toxic.get(i, 1) for i in gone)
    whole = cp.run(spark, sf_dir)
    assert sorted(whole.collect()) == sorted(rows["tokens"][1])
