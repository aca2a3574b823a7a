"""The registered queries of this subpackage, and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.llm import decontam, fourier, langid, mixing, phrases, pii, rules, sampling, simhash, suffixes, tokens, toxicity, urls, variants
from flowtide.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_simhash_duplicates")
def op1_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_text(F.col("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


# No table has list entries or fetch days, so both are worked out from the pages: a capture's day
# from its id, and for every host, its parent domain and each host's leading path segment dated
# additions and removals from the letters of the pattern. Statements both engines accept.
CAPTURES = """
SELECT page_id, url, CAST('2024-01-01' AS DATE) + CAST((page_id * 7919) % 366 AS INT) AS day FROM {pages}
"""
ENTRIES = """
SELECT list, pattern, CAST('2024-01-01' AS DATE) + CAST(s AS INT) AS noted, added FROM (
  SELECT 'hosts' AS list, pattern, n % 300 AS s, true AS added FROM {patterns} WHERE kind = 'host' AND n % 3 <> 0
  UNION ALL
  SELECT 'hosts' AS list, pattern, n % 300 + 20 + n % 60 AS s, false AS added FROM {patterns} WHERE kind = 'host' AND n % 3 = 1
  UNION ALL
  SELECT 'hosts' AS list, pattern, n % 300 + 90 + n % 80 AS s, true AS added FROM {patterns} WHERE kind = 'host' AND n % 6 = 1
  UNION ALL
  SELECT 'domains' AS list, pattern, n % 250 AS s, true AS added FROM {patterns} WHERE kind = 'domain' AND n % 4 = 0
  UNION ALL
  SELECT 'domains' AS list, pattern, n % 250 + 40 AS s, false AS added FROM {patterns} WHERE kind = 'domain' AND n % 8 = 0
  UNION ALL
  SELECT 'paths' AS list, pattern, n % 200 AS s, true AS added FROM {patterns} WHERE kind = 'path' AND n % 5 <> 4) e
"""
PATTERNS = """
SELECT kind, pattern, ascii(substr(pattern, 1, 1)) * 31 + ascii(substr(pattern, 4, 1)) * 17 + ascii(substr(pattern, 6, 1)) * 13 + length(pattern) * 7 AS n
FROM (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM {hosts}
  UNION ALL
  SELECT DISTINCT 'domain' AS kind, substr(host, instr(host, '.') + 1) AS pattern FROM {hosts}
  UNION ALL
  SELECT DISTINCT 'path' AS kind, host || '/' || segment AS pattern FROM {hosts} WHERE segment <> '') p
"""
HOSTS = "SELECT split_part(url, '/', 3) AS host, split_part(split_part(split_part(url, '/', 4), '?', 1), '#', 1) AS segment FROM {pages} WHERE url IS NOT NULL"

URL_SQL = f"""
WITH hosts AS ({HOSTS.format(pages='pages')}),
patterns AS ({PATTERNS.format(hosts='hosts')}),
captures AS ({CAPTURES.format(pages='pages')}),
entries AS (SELECT list, pattern, noted, min(added) AS added FROM ({ENTRIES.format(patterns='patterns')}) x GROUP BY 1, 2, 3),
states AS (
  SELECT c.page_id, e.list, e.pattern, arg_max(e.added, e.noted) AS added
  FROM captures c
  JOIN entries e ON e.noted <= c.day AND (
    (e.list <> 'paths' AND (split_part(c.url, '/', 3) = e.pattern OR split_part(c.url, '/', 3) LIKE '%.' || e.pattern))
    OR (e.list = 'paths' AND split_part(c.url, '/', 3) || '/' || split_part(split_part(split_part(c.url, '/', 4), '?', 1), '#', 1) = e.pattern))
  GROUP BY ALL),
reasons AS (SELECT page_id, list_sort(list(list || ':' || pattern)) AS r FROM states WHERE added GROUP BY 1)
SELECT c.page_id, c.url, split_part(c.url, '/', 3) AS host, r.r IS NOT NULL AS blocked, coalesce(len(r.r), 0)::INT AS n_active, coalesce(array_to_string(r.r, ','), '') AS reasons
FROM captures c LEFT JOIN reasons r USING (page_id)
"""


@query("op10_url_filter", URL_SQL)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = spark.sql(CAPTURES, pages=pages).withColumnRenamed("page_id", "key")
    hosts = spark.sql(HOSTS, pages=pages).distinct()
    entries = spark.sql(ENTRIES, patterns=spark.sql(PATTERNS, hosts=hosts))
    found = urls.filter_captures(captures, entries)
    return found.select(F.col("key").alias("page_id"), "url", "host", "blocked", F.size("reasons").alias("n_active"), F.array_join("reasons", ",").alias("reasons"))


# Words, targets by filling up to three times a source, then the order of random odds over
# inclusion odds, its longest run that fits, and the document that fits the rest best.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         sum(source_size) OVER () * 1.0::DOUBLE AS words FROM sums),
levels AS (
  SELECT *, 3 * source_size / weight AS fill,
         (words - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         least(CASE WHEN fill < level THEN 3.0::DOUBLE * source_size ELSE weight * (SELECT arg_min(level, fill) FROM levels WHERE NOT fill < level) END, 3.0::DOUBLE * source_size) AS target
  FROM levels),
expected AS (
  SELECT doc_id, size, t.source, text, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS e,
         (('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (
  SELECT *, floor(e)::BIGINT AS whole,
         CASE WHEN e - floor(e) > 0 AND size > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS key
  FROM expected),
ranked AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS missing,
         sum(CASE WHEN key IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM drawn),
gaps AS (
  SELECT *, key IS NOT NULL AND upto <= missing AS sampled,
         missing - coalesce(max(CASE WHEN key IS NOT NULL AND upto <= missing THEN upto END) OVER (PARTITION BY source), 0) AS gap
  FROM ranked),
fillers AS (
  SELECT *, key IS NOT NULL AND NOT sampled AND abs(size - gap) < gap
            AND row_number() OVER (PARTITION BY source, key IS NOT NULL AND NOT sampled AND abs(size - gap) < gap ORDER BY abs(size - gap), key, doc_id, text) = 1 AS filler
  FROM gaps)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN sampled OR filler THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM fillers
"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        decontam.items_digest(F.col("hits.items")).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


@query("op4_repeated_strings")
def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "repeats.n_bytes",
        "repeats.n_removed",
        F.size("repeats.spans").cast("long").alias("n_spans"),
        F.sha2(F.col("repeats.kept"), 256).alias("kept_sha256"),
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Fitted to the labels outside the held-out third."""
    return toxicity.train(docs, table(spark, sf_dir, "labels"), only=sampling.fold(F.col("doc_id"), 3) != 1)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    scored = docs.select("doc_id", toxicity.toxicity(model, docs, F.col("text")).alias("toxicity"))
    score = F.col("toxicity.score")
    return scored.select(
        "doc_id",
        (sampling.fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("toxicity.sentences").alias("n_offending"),
    )


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = sampling.fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, only=~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), langid.language(model, docs, F.col("text")).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.size("l.spans").alias("n_spans"))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # counted once: the rules are learned from what is written here, and applied to it
    counted = stored(docs.select("doc_id", rules.statistics(F.col("text")).alias("s")), "statistics")
    learned = rules.train(counted, table(spark, sf_dir, "labels"), "s")
    failed = (F.col("s.n_words") < 50) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))
    rule = learned.number("s")
    return counted.select(
        "doc_id",
        *[F.col(f"s.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & (rule == 0)).alias("kept"),
        rule.alias("rule"),
    )


#: for the registered query only; real use passes a secret of its own
EXAMPLE_KEY = b"registered query, not a secret"


@query("op8_pseudonyms")
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.pseudonyms(F.col("text"), EXAMPLE_KEY).alias("p"))
    counts = [F.col(f"p.n_{k}") for k in pii.KINDS]
    return found.select("doc_id", sum(counts[1:], counts[0]).alias("n_replaced"), *counts, "p.text")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_table(docs, tokenizer_file())


# words in pieces, counts of one to three of them, the lowest-scoring cut, and what longer candidates take away
PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM pieces) x GROUP BY 1, 2),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1),
f2 AS (
  SELECT lang, w1, w2, count(*) AS f
  FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces) x) y GROUP BY 1, 2, 3),
f3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f
  FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM pieces) x) y GROUP BY 1, 2, 3, 4),
c2 AS (SELECT * FROM f2 WHERE f >= 10),
c3 AS (SELECT * FROM f3 WHERE f >= 10),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM c2 c JOIN f1 x ON c.lang = x.lang AND c.w1 = x.w JOIN f1 y ON c.lang = y.lang AND c.w2 = y.w
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
  FROM c3 c JOIN f1 x ON c.lang = x.lang AND c.w1 = x.w JOIN f2 y ON c.lang = y.lang AND c.w2 = y.w1 AND c.w3 = y.w2
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
  FROM c3 c JOIN f2 x ON c.lang = x.lang AND c.w1 = x.w1 AND c.w2 = x.w2 JOIN f1 y ON c.lang = y.lang AND c.w3 = y.w),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place
                 FROM (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts) s) t WHERE place = 1),
around AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM c3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM c3) x GROUP BY 1, 2),
ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest p LEFT JOIN around o USING (lang, phrase) WHERE o.longer IS NULL OR 100 * o.longer < 50 * p.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", PHRASES_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


# crc32 byte by byte over a table; pairs one edit apart share what is left of them without a code point
VARIANTS_SQL = """
WITH RECURSIVE lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (
  SELECT i, run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]{7,}')) AS run FROM lowered) r
  GROUP BY 1, 2),
crc_table AS (
  SELECT list(c ORDER BY k) AS t
  FROM (SELECT k, list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, k) AS c FROM range(256) r(k)) x),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(1, 2 * octet_length(encode(i || ':' || run)), 2), lambda b: ('0x' || substr(hex(encode(i || ':' || run)), b, 2))::BIGINT),
         lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1]), 4294967295)) AS h
  FROM runs, crc_table),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, k, left(word, k::INT) || substr(word, (k + 2)::INT) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM vocab) v),
pairs AS (
  SELECT DISTINCT c.word, c.n, v.word AS near, v.n AS near_n FROM cut c JOIN vocab v ON c.rest = v.word
  UNION ALL
  SELECT DISTINCT v.word, v.n, c.word AS near, c.n AS near_n FROM cut c JOIN vocab v ON c.rest = v.word
  UNION ALL
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word),
nears AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
forms AS (
  SELECT word, near AS form, near_n AS form_n
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs) p WHERE place = 1 AND near_n >= 10 * n),
roots AS (
  SELECT word, form AS root, 1 AS step FROM forms
  UNION ALL
  SELECT r.word, f.form AS root, r.step + 1 AS step FROM roots r JOIN forms f ON r.root = f.word)
SELECT v.word, v.n, f.form, f.form_n, coalesce(r.root, v.word) AS root, coalesce(e.n_near, 0)::BIGINT AS n_near
FROM vocab v LEFT JOIN forms f USING (word) LEFT JOIN nears e USING (word)
LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM roots GROUP BY word) r USING (word)
"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = variants.variants(variants.vocabulary(variants.slipped_runs(docs)))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_kernel_quality")
def op13_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fourier.held_out(F.col("doc_id"))
    found = fourier.scored(docs, table(spark, sf_dir, "labels"), only=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
