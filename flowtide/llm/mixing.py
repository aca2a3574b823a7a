"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document's expected copies are target / source size times
its relative weight; the whole part of that is taken for certain, the fraction is its inclusion
probability in a sample. The sample orders documents by random odds divided by inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and takes them in that order until the words still missing are
taken: a sample of fixed size in words, with unequal probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.llm.common import fresh_name, numbered, stored

#: slices of a source's order; only the one in which its words are reached is ranked row by row
SLICES = 4_096
#: tasks over which the documents of one source are dealt
SALTS = 32
#: most copies of a document, and of a source
MOST = 3

_WORD = r"[^\\x20\\x09-\\x0D]+"


def n_words(text: str) -> Column:
    """Words of a text column, as long; 0 for null."""
    return F.coalesce(F.expr(f"regexp_count(`{text}`, '{_WORD}')"), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that a key always gets: 52 bits of its md5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def cycle_weight(rank: Column) -> Column:
    """1, 2, 3, 1, ... for ranks 1, 2, 3, 4, ..."""
    return ((rank - 1) % 3 + 1).cast("double")


def source_targets(sized: DataFrame, source: str, size: str, weights: DataFrame | None = None, share: float = 1.0) -> DataFrame:
    """`source`, `source_size`, `target` of every source; all targets add up to `share` of all words.

    A target stops at MOST times its source's size; what is above goes to the other sources by
    weight, until none is above. With sources in order of MOST * size / weight those that stop
    come first, so running sums find them. `weights` has `source`, `weight`; without it sources
    in code point order, null last, weigh 1, 2, 3 and so on again. The table has one row per
    source; its running sums are one task over such rows, never over documents.
    """
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    if weights is None:
        sums = sums.withColumn("weight", cycle_weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sums = sums.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.lit(MOST) * F.col("source_size")
    cut = (
        sums.withColumn("fill", F.when(F.col("weight") > 0, most / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("words", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("words") - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("stops", F.coalesce(F.col("fill") < F.col("level"), F.lit(False)))
    )
    # those after the last that stops share what is left
    return (
        cut.withColumn("first_free", F.min(F.when(~F.col("stops"), F.struct("fill", F.struct(F.col("source").isNull(), "source"), "level"))).over(everything))
        .withColumn("target", F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("stops"), most.cast("double")).otherwise(F.col("first_free.level") * F.col("weight")))
        .select("source", "source_size", F.least("target", most.cast("double")).alias("target"))
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: DataFrame | None = None, share: float = 1.0, relative_weight: str | None = None) -> DataFrame:
    """All rows of `docs` with a struct column `mix`: `size`, `source_size`, `target`, `copies`, `taken`.

    The struct gets underscores before its name if `docs` has a column `mix`. `relative_weight`
    names a column that makes documents of a source likelier by that factor (null counts as 1);
    expected copies stop at MOST. Null texts have no words and are never taken; null is a source
    of its own; rows of a source that share an id share their random number and come in order of
    their texts; an empty table gives an empty one. The last document of a source is the one row
    not yet taken whose size comes nearest to the words still missing (ties: by order, id, then
    text), if taking it comes nearer to the target than not.

    Sizes are counted once into a narrow table in the shared folder. Sums over slices of each
    source's order find the slice in which its words are reached, then the id in it, the block of
    that id's rows and the row, so no task sees all of a source, nor all rows of an id. What has
    one row per source is written as soon as it is known, so that no plan holds the one before.
    """
    given = docs
    docs, u = numbered(docs, id_col, text_col)
    name, f = fresh_name(docs, "mix"), fresh_name(docs, "_f")
    relative = F.coalesce(F.col(relative_weight).cast("double"), F.lit(1.0)) if relative_weight else F.lit(1.0)
    facts = docs.withColumn(f, F.struct(F.col(u).alias("u"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), relative.alias("relative")))
    narrow = stored(facts.select(f"{f}.*"), "sizes")
    plan = stored(_borders(narrow, source_targets(narrow, "source", "size", weights, share), seed), "borders")
    p = fresh_name(docs, "_p")
    plan = plan.select(F.struct(*plan.columns).alias(p))
    matched = facts.join(plan, F.col(f"{f}.source").eqNullSafe(F.col(f"{p}.source")), "left")
    size, whole, key = (_drawn(f"{f}.", f"{p}.", seed)[k] for k in ("size", "whole", "key"))
    here = F.struct(key.alias("key"), F.col(f"{f}.id").alias("id"), F.col(f"{f}.u").alias("u"))
    border = F.col(f"{p}.border")
    extra = (key.isNotNull() & (border.isNull() | (here < border))) | (F.col(f"{f}.u") == F.col(f"{p}.filler"))
    copies = whole + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    mix = F.struct(size.alias("size"), F.col(f"{p}.source_size").alias("source_size"), F.col(f"{p}.target").alias("target"), copies.cast("int").alias("copies"), (copies * size).cast("long").alias("taken"))
    return matched.withColumn(name, mix).select(*[F.col(f"`{c}`") for c in given.columns], F.col(name).alias(fresh_name(given, "mix")))


def _drawn(row: str, source: str, seed: str) -> dict[str, Column]:
    """Size, certain copies and order key of a document; the key is null where nothing is left to chance."""
    size, target, total = F.col(f"{row}size"), F.col(f"{source}target"), F.col(f"{source}source_size")
    expected = F.when(total > 0, F.least(target / total * F.col(f"{row}relative"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    whole = F.floor(expected).cast("long")
    p, u = expected - whole, uniform(F.col(f"{row}id"), seed)
    return {"size": size, "whole": whole, "key": F.when((p > 0) & (size > 0), (u / (1 - u)) / (p / (1 - p)))}


def _borders(narrow: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Per source: `source_size`, `target`, `border` (key, id and row number of the first document in the order that is not taken) and `filler` (the row number of one more)."""
    t = stored(targets.select(F.struct("source", "source_size", "target").alias("t")), "targets")
    parts = _drawn("", "t.", seed)
    drawn = narrow.join(t, F.col("source").eqNullSafe(F.col("t.source"))).select(
        "t", F.col("u"), F.col("id"), F.col("size"), parts["whole"].alias("whole"), parts["key"].alias("key")
    )
    drawn = drawn.withColumn("slice", F.floor(F.col("key") / (1 + F.col("key")) * SLICES).cast("long"))
    certain = drawn.groupBy("t").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    start = certain.select("t", (F.col("t.target") - F.col("certain")).alias("missing"), F.lit(0).cast("long").alias("before"))
    ranked = drawn.filter(F.col("key").isNotNull()).drop("whole")
    # the slice in which the words are reached, the id in it, the block of that id's rows, the row
    cut, rows = stored(start, "border-levels"), ranked
    for level in (F.col("slice"), F.struct("key", "id"), F.shiftright("u", 33), F.col("u")):
        # a row for each source, and the rows of one slice, id or block
        cut = stored(_reached(rows, cut, level), "border-levels")
        here = cut.filter("at IS NOT NULL").select("t", F.col("at").alias("_level"))
        rows = stored(rows.withColumn("_level", level).join(here, ["t", "_level"], "left_semi").drop("_level"), "border-rows")
    border = rows.select("t", F.struct("key", "id", "u").alias("border"))
    ends = stored(cut.join(border, "t", "left").select("t", "border", (F.col("missing") - F.col("before")).alias("gap")), "border-ends")
    # documents of a source meet its row in several tasks
    salted = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    here, off = F.struct("key", "id", "u"), F.abs(F.col("size") - F.col("gap"))
    fillers = (
        ranked.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        .join(salted, ["t", "salt"])
        .filter((here >= F.col("border")) & (off < F.col("gap")))
        .groupBy("t")
        .agg(F.min(F.struct(off.alias("off"), here.alias("row"))).alias("best"))
    )
    return ends.join(fillers, "t", "left").select("t.source", "t.source_size", "t.target", "border", F.col("best.row.u").alias("filler"))


def _reached(rows: DataFrame, cut: DataFrame, level: Column) -> DataFrame:
    """`cut` with `at`, where in the order of `level` the words of a source pass what is `missing`, having `before`.

    `at` is null where they don't: `before` has all words then, or what it had where no rows are left.
    """
    cut = cut.select("t", "missing", "before")
    sums = rows.groupBy("t", level.alias("at")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("t").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.join(cut, "t").withColumn("upto", F.col("before") + F.sum("words").over(order))
    over = F.when(F.col("upto") > F.col("missing"), F.struct("at", (F.col("upto") - F.col("words")).alias("before")))
    found = upto.groupBy("t").agg(F.min(over).alias("c"), F.max("upto").alias("all"))
    return cut.join(found, "t", "left").select("t", "missing", F.coalesce("c.before", "all", "before").alias("before"), F.col("c.at").alias("at"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as many times as it is taken; columns unchanged."""
    found = mix_sources(docs, **options)
    name = found.columns[-1]
    times = F.sequence(F.lit(1), F.col(f"`{name}`.copies"))
    copy = fresh_name(found, "_copy")
    return found.filter(F.col(f"`{name}`.copies") > 0).withColumn(copy, F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])
