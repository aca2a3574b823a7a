"""Jobs: anonymisation, sequence checks, retention, feature preparation, clustering."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from flowtide.catalog.base import query, r6, table_query, ts
from flowtide.jobs import anonymise as AN, features as FE, upkeep
from flowtide.plans import ordered

KEY = "0x" + "".join(f"{i:02x}" for i in range(21, 53))


# --- anonymisation ------------------------------------------------------------------


@query("anonymised_flows")
def _(flows):
    out = AN.anonymise(flows, KEY)
    return out.select("flow_id", "src_addr", "dst_addr", "next_hop", "bgp_next_hop", "router", "src_as", "dst_as")


# The sixteen addresses of the flows and what the scheme makes of them under KEY
# (checked bit by bit in the tests).
_KNOWN = """(VALUES (167772160, 1776553926), (167772161, 1776553927), (167772162, 1776553925), (167772163, 1776553924),
       (167772164, 1776553920), (167772165, 1776553921), (167772166, 1776553922), (167772167, 1776553923),
       (167772168, 1776553929), (167772169, 1776553928), (167772170, 1776553930), (167772171, 1776553931),
       (167772172, 1776553934), (167772173, 1776553935), (167772174, 1776553933), (167772175, 1776553932)) k(src_addr, anonymised)"""


@query("anonymised_known_addresses", f"SELECT flow_id, anonymised AS src_addr FROM flows JOIN {_KNOWN} USING (src_addr)")
def _(flows):
    return AN.anonymise(flows, KEY).select("flow_id", "src_addr")


def _shared_bits(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 32 ELSE 31 - CAST(floor(log2(xor({a}, {b}))) AS INT) END"


@query(
    "anonymised_prefix_lengths",
    f"""SELECT flow_id, {_shared_bits('src_addr', 'dst_addr')} AS src_dst, {_shared_bits('src_addr', 'next_hop')} AS src_next,
               {_shared_bits('next_hop', 'bgp_next_hop')} AS next_bgp FROM flows""",
)
def _(flows):
    """Shared leading bits are the same before (SQL) and after (here) anonymisation."""

    def shared(a: str, b: str):
        x = F.col(a).bitwiseXOR(F.col(b))
        return F.when(x == 0, 32).otherwise(F.lit(31) - F.floor(F.log2(x)).cast("int"))

    out = AN.anonymise(flows, KEY)
    return out.select(
        "flow_id", shared("src_addr", "dst_addr").alias("src_dst"), shared("src_addr", "next_hop").alias("src_next"),
        shared("next_hop", "bgp_next_hop").alias("next_bgp"),
    )


_HI = 2306139568115548160


@query(
    "anonymised_v6_prefix_lengths",
    f"SELECT flow_id, 32 + {_shared_bits('src_addr', 'dst_addr')} AS shared FROM flows",
)
def _(flows):
    """The same over 128 bits, for IPv6 networks that carry the v4 address in bits 32-63."""
    v6 = flows.withColumns(
        {
            "is_v6": F.lit(True),
            "src_hi": F.lit(_HI) + F.col("src_addr"),
            "src_lo": F.col("src_port").cast("bigint"),
            "dst_hi": F.lit(_HI) + F.col("dst_addr"),
            "dst_lo": F.col("src_port").cast("bigint"),
        }
    ).withColumns({"src_addr": F.lit(None).cast("bigint"), "dst_addr": F.lit(None).cast("bigint")})
    out = AN.anonymise(v6, KEY)
    x = F.col("src_hi").bitwiseXOR(F.col("dst_hi"))
    same = F.when(x == 0, 64).otherwise(F.lit(63) - F.floor(F.log2(x)).cast("int"))
    return out.select("flow_id", same.alias("shared"))


# --- exporters and retention ---------------------------------------------------------

_WRAP = 4294960000


def _headers(flows):
    """Export headers derived from the flows: every 97th one jumps ahead by 7."""
    base = flows.select(
        "ident",
        F.col("flow_id").alias("arrival"),
        (F.lit(1) + (F.col("out_dst_mac") - F.lit(2482300000000)) % 30).alias("flow_count"),
    )
    step = F.col("flow_count") + F.when(F.col("arrival") % 97 == 0, 7).otherwise(0)
    run = ordered.running(base, "arrival", {"total": ("sum", step)}, by=("ident",), block=ordered.ByRank(upkeep.HEADER_BLOCK))
    start = F.col("total") - F.col("flow_count") + F.lit(_WRAP)
    return run.select("ident", "arrival", "flow_count", F.pmod(start, F.lit(1 << 32)).alias("flow_sequence"))


_HEADERS = f"""h AS (SELECT ident, flow_id AS arrival, 1 + (out_dst_mac - 2482300000000) % 30 AS flow_count,
         CASE WHEN flow_id % 97 = 0 THEN 7 ELSE 0 END AS jump FROM flows),
q AS (SELECT ident, arrival, flow_count,
        (CAST(sum(flow_count + jump) OVER (PARTITION BY ident ORDER BY arrival) AS BIGINT) - flow_count + {_WRAP}) % 4294967296 AS flow_sequence FROM h),
p AS (SELECT *, lag(flow_sequence) OVER o AS ps, lag(flow_count) OVER o AS pc FROM q WINDOW o AS (PARTITION BY ident ORDER BY arrival))"""


@query(
    "sequence_gaps",
    f"""WITH {_HEADERS} SELECT ident, count(*) AS headers,
        count(*) FILTER ((flow_sequence - ps + 4294967296) % 4294967296 <> pc) AS failures FROM p GROUP BY ident""",
)
def _(flows):
    return upkeep.sequence_gaps(_headers(flows))


@query(
    "sequence_gaps_sparse_arrivals",
    f"""WITH {_HEADERS}, o AS (SELECT ident, flow_sequence, flow_count, CASE WHEN arrival % 5003 = 0 THEN 4000000000000000000 + arrival ELSE arrival * 1000003 END AS arrival FROM q),
        s AS (SELECT *, lag(flow_sequence) OVER w AS ps, lag(flow_count) OVER w AS pc FROM o WINDOW w AS (PARTITION BY ident ORDER BY arrival))
        SELECT ident, count(*) AS headers, count(*) FILTER ((flow_sequence - ps + 4294967296) % 4294967296 <> pc) AS failures FROM s GROUP BY ident""",
)
def _(flows):
    # a million units between arrivals, and some far beyond all others
    arrival = F.col("arrival")
    sparse = F.when(arrival % 5003 == 0, F.lit(4 * 10**18) + arrival).otherwise(arrival * 1_000_003)
    return upkeep.sequence_gaps(_headers(flows).withColumn("arrival", sparse))


@query(
    "sequence_failures",
    f"""WITH {_HEADERS} SELECT ident, arrival, flow_sequence, (flow_sequence - ps + 4294967296) % 4294967296 AS distance
        FROM p WHERE (flow_sequence - ps + 4294967296) % 4294967296 <> pc""",
)
def _(flows):
    return (
        upkeep.sequence_steps(_headers(flows))
        .filter("failure")
        .select("ident", "arrival", "flow_sequence", "distance")
    )


def _partitions(spark, table_dir):
    orders = spark.read.parquet(f"{table_dir}/orders.parquet")
    return orders.groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(
        F.sum(F.round("o_totalprice").cast("bigint")).alias("size")
    )


_PARTITIONS = """parts AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS size
         FROM orders GROUP BY 1),
kept AS (SELECT *, sum(size) OVER (ORDER BY day DESC) AS kept FROM parts)"""


@table_query(
    "retention_plan_by_size",
    f"""WITH {_PARTITIONS} SELECT {ts('day')} AS at, size,
          CASE WHEN (SELECT sum(size) FROM parts) >= 1000000 AND kept > 950000 THEN 'size' END AS reason
        FROM kept WHERE (SELECT sum(size) FROM parts) >= 1000000 AND kept > 950000""",
)
def _(spark, table_dir):
    return upkeep.retention_plan(_partitions(spark, table_dir), datetime(2002, 1, 1), 0, 1_000_000)


@table_query(
    "retention_plan_both_limits",
    f"""WITH {_PARTITIONS}, t AS (SELECT min(day) AS first, sum(size) AS total FROM parts),
        j AS (SELECT day, size, total >= 900000000 AND kept > 810000000 AS s,
                     epoch(TIMESTAMP '2002-01-01') - epoch(first) >= 63072000 AND epoch(day) < epoch(TIMESTAMP '2002-01-01') - 56764800 AS a
              FROM kept, t)
        SELECT {ts('day')} AS at, size, CASE WHEN s THEN 'size' ELSE 'age' END AS reason FROM j WHERE s OR a""",
)
def _(spark, table_dir):
    return upkeep.retention_plan(
        _partitions(spark, table_dir), datetime(2002, 1, 1), 2 * 365 * 86400, 900_000_000, low_water=90
    )


# --- feature rows -------------------------------------------------------------------


def _rows(spark, table_dir):
    rows = spark.read.parquet(f"{table_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def _long(df, features: str = "features", *by: str):
    """Compared in long form, one value per row."""
    return df.select(*(by or ("vec_id",)), F.posexplode(features).alias("dim", "value")).filter("value IS NOT NULL")


_V = "v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@table_query("feature_log2", f"WITH {_V} SELECT vec_id, CAST(dim AS INT) AS dim, {r6('log2(x)')} AS value FROM v WHERE x > 0")
def _(spark, table_dir):
    return _long(_rows(spark, table_dir).withColumn("features", FE.log2_transform("features")))


for _method, _fn in (("mean", "avg"), ("median", "median")):

    @table_query(
        f"feature_center_rows_{_method}",
        f"""WITH {_V}, m AS (SELECT vec_id, {_fn}(x) AS m FROM v GROUP BY vec_id)
            SELECT vec_id, CAST(dim AS INT) AS dim, {r6('x - m')} AS value FROM v JOIN m USING (vec_id)""",
    )
    def _(spark, table_dir, method=_method):
        return _long(_rows(spark, table_dir).withColumn("features", FE.center_row("features", method)))

    @table_query(
        f"feature_center_columns_{_method}",
        f"""WITH {_V}, m AS (SELECT dim, {_fn}(x) AS m FROM v GROUP BY dim)
            SELECT vec_id, CAST(dim AS INT) AS dim, {r6('x - m')} AS value FROM v JOIN m USING (dim)""",
    )
    def _(spark, table_dir, method=_method):
        return _long(FE.center_columns(_rows(spark, table_dir), method=method))

    @table_query(
        f"cluster_centres_{_method}",
        f"WITH {_V} SELECT label, CAST(dim AS INT) AS dim, {r6(f'{_fn}(x)')} AS centre FROM v GROUP BY label, dim",
    )
    def _(spark, table_dir, method=_method):
        return FE.cluster_centres(_rows(spark, table_dir), cluster="label", method=method)


@table_query(
    "feature_normalize_rows",
    f"""WITH {_V}, m AS (SELECT vec_id, sqrt(sum(x * x)) AS m FROM v GROUP BY vec_id)
        SELECT vec_id, CAST(dim AS INT) AS dim, {r6('x / m')} AS value FROM v JOIN m USING (vec_id)""",
)
def _(spark, table_dir):
    return _long(_rows(spark, table_dir).withColumn("features", FE.normalize_row("features")))


@table_query(
    "feature_normalize_columns",
    f"""WITH {_V}, m AS (SELECT dim, sqrt(sum(x * x)) AS m FROM v GROUP BY dim)
        SELECT vec_id, CAST(dim AS INT) AS dim, {r6('x / m')} AS value FROM v JOIN m USING (dim)""",
)
def _(spark, table_dir):
    return _long(FE.normalize_columns(_rows(spark, table_dir)))


@table_query(
    "feature_row_filter",
    f"""WITH {_V}, p AS (SELECT vec_id, log2(x) AS x FROM v WHERE x > 0)
        SELECT vec_id FROM p GROUP BY vec_id
        HAVING count(*) >= ceil(45 * 64 / 100.0) AND stddev_samp(x) >= 1.5
           AND count(*) FILTER (abs(x) >= 4) >= 8 AND max(x) - min(x) >= 5""",
)
def _(spark, table_dir):
    logs = _rows(spark, table_dir).withColumn("features", FE.log2_transform("features"))
    return logs.filter(FE.row_filter("features", 45, 1.5, 4.0, 8, 5.0)).select("vec_id")


_D = f"""WITH {_V}, c AS (SELECT label, dim, avg(x) AS y FROM v GROUP BY label, dim),
s AS (SELECT vec_id, label, count(*) AS w, sum((x - y) * (x - y)) AS sq, sum(abs(x - y)) AS ab, sum(x) AS sx, sum(y) AS sy,
             sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM v JOIN c USING (label, dim) GROUP BY vec_id, label),
r AS (SELECT *, (xy - sx * sy / w) / sqrt((xx - sx * sx / w) * (yy - sy * sy / w)) AS cr, xy / sqrt(xx * yy) AS ur FROM s)"""
_DISTANCES = {
    "euclid": "sq / w", "cityblock": "ab / w", "correlation": "1 - cr", "abs_correlation": "1 - abs(cr)",
    "uncentered": "1 - ur", "abs_uncentered": "1 - abs(ur)",
}


@table_query(
    "row_to_centre_distances",
    f"{_D} SELECT vec_id, label, {', '.join(f'{r6(e)} AS {n}' for n, e in _DISTANCES.items())} FROM r",
)
def _(spark, table_dir):
    rows = _rows(spark, table_dir)
    centres = FE.centre_vectors(FE.cluster_centres(rows, cluster="label"), "label")
    joined = rows.join(centres, "label")
    return joined.select(
        "vec_id", "label",
        *[FE.distance(F.col("features"), F.col("centre"), m).alias(m) for m in FE.METRICS],
    )


@table_query("kmeans_clusters")
def _(spark, table_dir):
    scored = FE.kmeans(_rows(spark, table_dir), k=4, restarts=2)
    centres = FE.centre_vectors(FE.cluster_centres(scored))
    return FE.row_to_centre(scored, centres).select("vec_id", "cluster", "within_cost", "distance")


@table_query("principal_components")
def _(spark, table_dir):
    pcs = FE.principal_components(_rows(spark, table_dir), 3)
    return pcs.select("component", "explained_variance", F.posexplode("loadings").alias("dim", "loading"))


# What must hold of any result: every row is nearest to its own centre, no cluster is empty,
# the cost is the sum of the distances, and the run ended by itself.
_HOLDS = "SELECT CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS n_rows, 4 AS clusters, true AS nearest, true AS cost_adds_up, true AS converged"


def _invariants(scored: DataFrame, method: str, metric: str) -> DataFrame:
    centres = FE.centre_vectors(FE.cluster_centres(scored, method=method))
    table = centres.agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "centre"))), lambda e: e["centre"]).alias("c")).scalar()
    own = FE.row_to_centre(scored, centres, metric).withColumn("_all", table)
    own = own.withColumn("least", F.array_min(F.transform("_all", lambda c: FE.distance(F.col("features"), c, metric))))
    # the cost of a k-means summary counts squares, euclid is their mean over the columns
    scale = F.size("features") if method == "mean" else F.lit(1)
    return own.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("cluster").cast("int").alias("clusters"),
        F.bool_and(F.col("distance") <= F.col("least") + 1e-9).alias("nearest"),
        (F.abs(F.sum(F.col("distance") * scale) / F.max("within_cost") - 1) < 1e-6).alias("cost_adds_up"),
        F.bool_and("converged").alias("converged"),
    )


@table_query("kmeans_invariants", _HOLDS)
def _(spark, table_dir):
    return _invariants(FE.kmeans(_rows(spark, table_dir), k=4, restarts=2), "mean", "euclid")


@table_query("kmedians_invariants", _HOLDS)
def _(spark, table_dir):
    return _invariants(FE.k_clusters(_rows(spark, table_dir), 4, "median", "cityblock"), "median", "cityblock")
