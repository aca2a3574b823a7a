"""URL filters in time: list entries become validity intervals, captures meet those of their day.

A list says of a pattern, on a date, that it is added or removed. A pattern is a domain (it
covers its subdomains) or a host with leading path segments. A capture is blocked if, on the day
it was fetched, some pattern that covers its URL was on a list. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment, without slashes around it; as written otherwise."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")


def covering_patterns(host: Column, path: Column, depth: int) -> Column:
    """All patterns that cover a URL: its host and parent domains, and its host with up to `depth` path segments."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    segments = F.filter(F.split(path, "/+"), lambda s: s != "")
    length = F.least(F.size(segments), F.lit(depth))
    paths = F.when(length > 0, F.transform(F.sequence(F.lit(1), length), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """`list`, `pattern`, `valid_from`, `valid_to` (exclusive, null if open) from dated entries.

    `entries` has `list`, `pattern`, `noted` (date) and `added` (true, or false for a removal). The
    last word of a day counts: a removal, if a day has both. Entries that change nothing do not
    cut an interval. Entries with a null in any of these are left out. A day's entries are
    combined before any order is made, so a pattern has one row per day at most.
    """
    days = entries.dropna(subset=["list", "pattern", "noted", "added"]).groupBy("list", "pattern", "noted").agg(F.min("added").alias("added"))
    by = Window.partitionBy("list", "pattern").orderBy("noted")
    changes = days.withColumn("before", F.coalesce(F.lag("added").over(by), F.lit(False))).filter(F.col("added") != F.col("before"))
    return changes.withColumn("valid_to", F.lead("noted").over(by)).filter("added").select("list", "pattern", F.col("noted").alias("valid_from"), "valid_to")


def _months(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def active_entries(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """`key`, `list`, `pattern`: intervals active when each capture was fetched.

    `captures` has `key`, `url`, `day`. The join is on pattern and month; an interval is in every
    month it touches until the last capture's. A host with any share of the captures is split by
    adaptive execution: the other side has at most the days of a month for a pattern.
    """
    last, depth = captures.agg(F.max("day")).first()[0], intervals.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0]
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    asked = captures.filter(F.col("day").isNotNull()).select("key", "day", _months(F.col("day")).alias("month"), F.explode(covering_patterns(host, path, depth or 0)).alias("pattern"))
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    dealt = intervals.filter(F.col("valid_from") <= F.lit(last).cast("date")).withColumn("month", F.explode(F.sequence(_months(F.col("valid_from")), _months(end))))
    on = (asked["pattern"] == dealt["pattern"]) & (asked["month"] == dealt["month"]) & (asked["day"] >= dealt["valid_from"]) & (F.col("valid_to").isNull() | (asked["day"] < F.col("valid_to")))
    return asked.join(dealt, on).select("key", "list", dealt["pattern"])


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of `captures`: `key`, `url`, `day`, `host`, `blocked`, `reasons` (sorted list:pattern).

    Null and malformed URLs have no host and are not blocked, nor is a capture without a day.
    Rows that share a key share what is found for any of them only if url and day are equal too.
    Empty captures or entries are fine.
    """
    numbered = captures.select("key", "url", "day")
    found = active_entries(numbered.select(F.struct("key", "url", "day").alias("key"), "url", "day").distinct(), validity_intervals(entries))
    reasons = found.groupBy("key").agg(F.array_sort(F.collect_set(F.concat_ws(":", "list", "pattern"))).alias("reasons")).select(F.col("key").alias("_k"), "reasons")
    same = F.struct("key", "url", "day").eqNullSafe(F.col("_k"))
    joined = numbered.join(reasons, same, "left")
    return joined.select("key", "url", "day", url_host(F.col("url")).alias("host"), F.col("reasons").isNotNull().alias("blocked"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
