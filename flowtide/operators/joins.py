"""Lookups joined to flows, and membership in long network lists."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtide.functions import addresses as A, names as N
from flowtide.plans import ordered
from flowtide.schema import ADDRESS_COLUMNS


def name_services(flows: DataFrame, port: str = "dst_port", out: str = "service") -> DataFrame:
    """Attach the service of (port, protocol); an exact transport wins over `*`.

    The table has 19 fixed rows, so both joins broadcast it.
    """
    table = N.service_table(flows.sparkSession)
    exact = table.filter("prot IS NOT NULL").select(
        F.col("port").alias("_p"), F.col("prot").alias("_t"), F.col("service").alias("_exact")
    )
    wild = table.filter("prot IS NULL").select(
        F.col("port").alias("_wp"), F.col("service").alias("_wild")
    )
    return (
        flows.join(F.broadcast(exact), (F.col(port) == F.col("_p")) & (F.col("prot") == F.col("_t")), "left")
        .join(F.broadcast(wild), (F.col(port) == F.col("_wp")) & F.col("prot").isin(6, 17), "left")
        .withColumn(out, F.coalesce("_exact", "_wild"))
        .drop("_p", "_t", "_exact", "_wp", "_wild")
    )


def network_table(spark: SparkSession, networks: list[str]) -> DataFrame:
    """A network list given as text, as (bits, net, net_hi, net_lo) rows.

    An IPv4 row has `net`, an IPv6 row has the pair.
    """
    nets = sorted({ipaddress.ip_network(n, strict=False) for n in networks}, key=str)
    v6 = [A.split_v6(int(n.network_address)) if n.version == 6 else (None, None) for n in nets]
    table = pa.table(
        {
            "bits": pa.array([n.prefixlen for n in nets], pa.int32()),
            "net": pa.array([int(n.network_address) if n.version == 4 else None for n in nets], pa.int64()),
            "net_hi": pa.array([hi for hi, _ in v6], pa.int64()),
            "net_lo": pa.array([lo for _, lo in v6], pa.int64()),
        }
    )
    return spark.createDataFrame(table)


#: addresses and network starts of a block, when they are put in order
ADDRESS_BLOCK = 1 << 20

_LOWEST = -(1 << 63)


def _unsigned(word: Column) -> Column:
    """A word whose signed order is the order of its 64 bits read as unsigned."""
    return word.bitwiseXOR(F.lit(_LOWEST).cast("bigint"))


def _low_ones(bits: Column) -> Column:
    """A word of `bits` (0 to 64) ones at its low end."""
    return F.when(bits >= 64, F.lit(-1).cast("bigint")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits)))


def network_ranges(networks: DataFrame) -> DataFrame:
    """A network list as ranges: `kind`, `grp`, `at`, `upto`.

    Kind 4 are IPv4 addresses, 6 the high words of IPv6 addresses, for networks of 64 bits or
    fewer, 7 the low words under the high word `grp`, for longer ones. Words are in unsigned order.
    """
    bits, v4, hi, lo = F.col("bits"), F.col("net"), F.col("net_hi"), F.col("net_lo")
    null = F.lit(None).cast("bigint")
    end4 = v4.bitwiseOR(_low_ones(F.lit(32) - bits))
    end6, end7 = hi.bitwiseOR(_low_ones(F.lit(64) - bits)), lo.bitwiseOR(_low_ones(F.lit(128) - bits))

    def row(kind: int, grp: Column, at: Column, upto: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), grp.alias("grp"), at.alias("at"), upto.alias("upto"))

    range_ = (
        F.when(v4.isNotNull(), row(4, null, v4, end4))
        .when(bits <= 64, row(6, null, _unsigned(hi), _unsigned(end6)))
        .otherwise(row(7, hi, _unsigned(lo), _unsigned(end7)))
    )
    return networks.select(range_.alias("r")).select("r.*")


def addresses_in_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """The rows of `addresses` (`v4`, `hi`, `lo`, all different) that lie in a network of `networks` (as of `network_table`).

    Ranges and addresses are put in one order. An address lies in a range if the greatest end of
    all ranges that begin at or before it is not before it: a running maximum, whatever the
    ranges' number and however they nest. It runs in blocks by rank, so no task sees all.
    """
    null = F.lit(None).cast("bigint")

    def place(kind: int, grp: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), grp.alias("grp"), at.alias("at"))

    places = F.when(F.col("v4").isNotNull(), F.array(place(4, null, F.col("v4")))).otherwise(
        F.array(place(6, null, _unsigned(F.col("hi"))), place(7, F.col("hi"), _unsigned(F.col("lo"))))
    )
    placed = addresses.filter("v4 IS NOT NULL OR hi IS NOT NULL").select("v4", "hi", "lo", F.explode(places).alias("p")).select("v4", "hi", "lo", "p.*")
    asked = placed.select("kind", "grp", "at", null.alias("upto"), F.lit(True).alias("asked"))
    marks = asked.union(network_ranges(networks).withColumn("asked", F.lit(False))).groupBy("kind", "grp", "at").agg(F.max("upto").alias("upto"), F.max("asked").alias("asked"))
    reached = ordered.running(marks, "at", {"reach": ("max", F.col("upto"))}, by=("kind", "grp"), block=ordered.ByRank(ADDRESS_BLOCK))
    inside = reached.filter(F.col("asked") & (F.col("reach") >= F.col("at"))).select("kind", "grp", "at")
    same = (placed["kind"] == inside["kind"]) & placed["grp"].eqNullSafe(inside["grp"]) & (placed["at"] == inside["at"])
    return placed.join(inside, same, "left_semi").select("v4", "hi", "lo").distinct()


def in_networks(flows: DataFrame, networks: DataFrame, side: str = "src") -> DataFrame:
    """Flows whose `side` ("src", "dst", "either", "both") address lies in a listed network.

    `networks` has the columns of `network_table`, and any length. The distinct addresses of all
    sides are matched once (see `addresses_in_networks`); flows then meet the addresses found by
    equality, and each flow comes out once. No side is hinted: adaptive execution broadcasts what
    it measures to be small and splits frequent addresses.
    """
    sides = ["src", "dst"] if side in ("either", "both") else [side]
    every = F.array(*[F.struct(*[F.col(c).alias(k) for c, k in zip(ADDRESS_COLUMNS[s], ("v4", "hi", "lo"))]) for s in sides])
    found = addresses_in_networks(flows.select(F.explode(every).alias("a")).select("a.*").distinct(), networks)
    for s in sides:
        names = [f"_{s}_{k}" for k in found.columns]
        hits = found.toDF(*names).withColumn(f"_in_{s}", F.lit(True))
        on = [F.col(c).eqNullSafe(F.col(h)) for c, h in zip(ADDRESS_COLUMNS[s], names)]
        flows = flows.join(hits, reduce(lambda a, b: a & b, on), "left").drop(*names)
    hits = [F.coalesce(f"_in_{s}", F.lit(False)) for s in sides]
    keep = hits[0] if len(hits) == 1 else (hits[0] | hits[1] if side == "either" else hits[0] & hits[1])
    return flows.filter(keep).drop(*[f"_in_{s}" for s in sides])
