"""Feature rows: transforms, filters, clustering, distances, principal components.

A feature row is an ARRAY<DOUBLE>; a NULL element is a missing value.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from flowtide.jobs.centres import Blocks
from flowtide.jobs.quantiles import exact_median


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(values: dict[str, Column], body) -> Column:
    """Evaluate `values` once per row and hand them to `body` as a struct.

    Inside a lambda an outer expression would be computed again for every element.
    """
    row = F.struct(*[e.alias(n) for n, e in values.items()])
    return F.get(F.transform(F.array(row), body), F.lit(0))


def present(x) -> Column:
    return F.filter(_col(x), lambda v: v.isNotNull())


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def row_mean(x) -> Column:
    return _let(
        {"v": present(x)}, lambda s: F.when(F.size(s["v"]) > 0, _total(s["v"]) / F.size(s["v"]))
    )


def row_median(x) -> Column:
    def middle(s):
        n = F.size(s["v"])
        low = F.get(s["v"], F.floor((n - 1) / 2).cast("int"))
        high = F.get(s["v"], F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    return _let({"v": F.sort_array(present(x))}, middle)


# --- rows -----------------------------------------------------------------------


def log2_transform(x) -> Column:
    """log2 of each value; values at or below 0 become missing."""
    return F.transform(_col(x), lambda v: F.when(v > 0, F.log2(v)))


def center_row(x, method: str = "mean") -> Column:
    def centred(s):
        middle = {"mean": row_mean, "median": row_median}[method](s["x"])
        return _let({"m": middle}, lambda t: F.transform(s["x"], lambda v: v - t["m"]))

    return _let({"x": _col(x)}, centred)


def normalize_row(x) -> Column:
    """Scale to a unit sum of squares; rows of zeros stay."""

    def scaled(s):
        norm = F.sqrt(_total(F.transform(present(s["x"]), lambda v: v * v)))
        return _let(
            {"n": norm},
            lambda t: F.when(t["n"] > 0, F.transform(s["x"], lambda v: v / t["n"])).otherwise(s["x"]),
        )

    return _let({"x": _col(x)}, scaled)


def row_filter(
    x,
    percent: float | None = None,
    std: float | None = None,
    abs_value: float | None = None,
    abs_count: int = 1,
    max_min: float | None = None,
) -> Column:
    """Keep rows with enough present values, spread, large values and range.

    percent: at least this share of the values is present (rounded up).
    std: sample standard deviation at least this; rows with one value or none go.
    abs_value, abs_count: at least `abs_count` values with an absolute value of `abs_value`.
    max_min: maximum minus minimum at least this.
    """

    def test(s) -> Column:
        v, n = s["v"], F.size(s["v"])
        keep = F.lit(True)
        if percent is not None:
            keep = keep & (n >= F.ceil(F.lit(float(percent)) * s["width"] / 100))
        if std is not None:
            squares = _total(F.transform(v, lambda e: (e - s["mean"]) * (e - s["mean"])))
            spread = F.sqrt(F.try_divide(squares, n - 1))
            keep = keep & F.coalesce((n > 1) & (spread >= std), F.lit(False))
        if abs_value is not None:
            keep = keep & (F.size(F.filter(v, lambda e: F.abs(e) >= abs_value)) >= abs_count)
        if max_min is not None:
            keep = keep & F.coalesce(F.array_max(v) - F.array_min(v) >= max_min, F.lit(False))
        return keep

    return _let({"v": present(x), "mean": row_mean(x), "width": F.size(_col(x))}, test)


# --- columns --------------------------------------------------------------------


def column_values(rows: DataFrame, features: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Long form (…by, dim, value) without missing values."""
    return rows.select(*by, F.posexplode(features).alias("dim", "value")).filter("value IS NOT NULL")


def column_middles(rows: DataFrame, features: str, method: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """(…by, dim, middle): mean or exact median of every column."""
    long = column_values(rows, features, by)
    if method == "mean":
        return long.groupBy(*by, "dim").agg(F.avg("value").alias("middle"))
    if method == "median":
        return exact_median(long, [*by, "dim"], "value", "middle")
    raise ValueError(f"unknown method: {method}")


def _per_column(stats: DataFrame, value: str) -> Column:
    """One value per column as an array in column order, as a scalar subquery."""
    as_map = F.map_from_entries(F.collect_list(F.struct("dim", value)))
    table = stats.agg(as_map.alias("m"), F.max("dim").alias("top"))
    aligned = table.select(F.transform(F.sequence(F.lit(0), F.col("top")), lambda i: F.col("m")[i]))
    return aligned.scalar()


def center_columns(rows: DataFrame, features: str = "features", method: str = "mean") -> DataFrame:
    middles = _per_column(column_middles(rows, features, method), "middle")
    centred = F.transform(features, lambda v, i: v - F.get("_m", i))
    return rows.withColumn("_m", middles).withColumn(features, centred).drop("_m")


def normalize_columns(rows: DataFrame, features: str = "features") -> DataFrame:
    """Scale every column to a unit sum of squares; columns of zeros stay."""
    norms = column_values(rows, features).groupBy("dim").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    )
    scaled = F.transform(
        features, lambda v, i: F.when(F.get("_n", i) > 0, v / F.get("_n", i)).otherwise(v)
    )
    return rows.withColumn("_n", _per_column(norms, "norm")).withColumn(features, scaled).drop("_n")


# --- clusters -------------------------------------------------------------------


def kmeans(rows: DataFrame, k: int, restarts: int = 1, seed: int = 1, features: str = "features", max_iter: int = 1000) -> DataFrame:
    """Rows with their cluster from the best of several k-means runs (mean centres).

    Adds `cluster`, `within_cost` (the sum of squared distances of the best run), `iterations`
    and `converged`. A run goes on until its centres rest; one that `max_iter` ends raises.
    Rows with missing values go to `k_clusters`, which leaves them out of sums one by one.
    """
    missing = rows.filter(F.exists(features, lambda v: v.isNull()) | F.col(features).isNull()).limit(1)
    if not missing.isEmpty():
        return k_clusters(rows, k, "mean", restarts=restarts, seed=seed, features=features, max_iter=max_iter)
    # steps over blocks of rows, which a run caches for itself, are matrix products
    data = rows.select(array_to_vector(features).alias("_vec"))
    models = [
        KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=0.0, solver="block", featuresCol="_vec", predictionCol="cluster").fit(data)
        for i in range(restarts)
    ]
    best = min(models, key=lambda m: m.summary.trainingCost)
    cost, steps = best.summary.trainingCost, best.summary.numIter
    if steps >= max_iter:
        raise RuntimeError(f"k-means has not converged in {max_iter} iterations")
    scored = best.transform(rows.withColumn("_vec", array_to_vector(features)))
    return scored.drop("_vec").withColumns({"within_cost": F.lit(float(cost)), "iterations": F.lit(steps), "converged": F.lit(True)})


def _assigned(rows: DataFrame, centres: list[list[float | None]], metric: str, features: str) -> DataFrame:
    """Rows with the nearest of a few centres, and the distance to it."""
    listed = F.array(*[F.array(*[F.lit(v).cast("double") for v in c]) for c in centres])
    far = F.transform(listed, lambda c, i: F.struct(distance(F.col(features), c, metric).alias("d"), i.alias("cluster")))
    best = F.array_min(far)
    return rows.withColumn("_near", best).withColumn("cluster", F.col("_near.cluster")).withColumn("_d", F.col("_near.d")).drop("_near")


def _converged(blocks: Blocks, centres: list[list[float | None]], method: str, metric: str, max_iter: int) -> tuple[float, list[list[float | None]], int]:
    """Cost, centres and steps of a run from the given centres."""
    if not centres:
        return 0.0, centres, 1
    now = np.full((len(centres), blocks.width), np.nan)
    for row, centre in zip(now, centres):
        row[: len(centre)] = [np.nan if v is None else v for v in centre]
    if method == "median":
        extent = blocks.extent()
        low, high = (np.tile(e, (len(now), 1)) for e in extent)
    cost = float("inf")
    for step in range(1, max_iter + 1):
        if method == "mean":
            least, new = blocks.means(now, metric)
        else:
            least, new = blocks.medians(now, metric, low, high, extent)
        if least >= cost:
            break
        cost, kept = least, now
        lost = np.isnan(new).all(1)
        now = np.where(lost[:, None], now, new)
        if np.array_equal(now, kept, equal_nan=True):
            break
        if method == "median":
            # the next medians are looked for about these
            reach = np.nan_to_num(np.maximum(4 * np.abs(now - kept), (extent[1] - extent[0]) / 4096))
            middle = np.nan_to_num(now)
            low, high = middle - reach, middle + reach
    else:
        raise RuntimeError(f"{method} centres have not converged in {max_iter} iterations")
    return cost, [[None if np.isnan(v) else float(v) for v in c] for c in kept], step


def k_clusters(rows: DataFrame, k: int, method: str = "mean", metric: str = "euclid", restarts: int = 1, seed: int = 1, features: str = "features", max_iter: int = 1000) -> DataFrame:
    """Rows with their cluster: mean or median centres, any of METRICS, NULL values left out.

    Adds the columns of `kmeans`; `within_cost` is the sum of distances to the own centre. Every
    run starts from k different vectors with the least hashes (all of them where there are fewer),
    and goes on until the cost stops falling or the centres rest. Steps read the features alone,
    packed into blocks that are deleted at the end. The driver holds k centres, and for medians a
    bounded list of values about them, never rows. A cluster that loses all rows keeps its centre.
    """
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method: {method}")
    best, blocks = None, Blocks(rows, features)
    for run in range(restarts):
        order = F.xxhash64(F.lit(seed + run), F.to_json(F.struct(F.transform(features, lambda v: v + F.lit(0.0)).alias("f"))))  # -0.0 is 0.0
        hashed = rows.filter(F.col(features).isNotNull()).select(F.col(features).alias("_f"), order.alias("_o"))
        # copies of a row have one hash; as centres they would leave clusters without rows. Hashes
        # are compared alone, and of the vectors only those with the least ones move
        least = [r[0] for r in hashed.select("_o").distinct().orderBy("_o").limit(k).collect()]
        chosen = hashed.filter(F.col("_o").isin(least)).groupBy("_o").agg(F.first("_f").alias("_f")).orderBy("_o")
        centres = [list(r[0]) for r in chosen.select("_f").collect()]
        found = _converged(blocks, centres, method, metric, max_iter)
        if best is None or found[0] < best[0]:
            best = found
    blocks.drop()
    cost, centres, steps = best
    out = _assigned(rows, centres, metric, features).drop("_d")
    return out.withColumns({"within_cost": F.lit(float(cost)), "iterations": F.lit(steps), "converged": F.lit(True)})


def cluster_centres(rows: DataFrame, features: str = "features", cluster: str = "cluster", method: str = "mean") -> DataFrame:
    """(cluster, dim, centre): mean or exact median of every column of a cluster."""
    return column_middles(rows, features, method, (cluster,)).withColumnRenamed("middle", "centre")


def centre_vectors(centres: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, centre): one array per cluster, in column order."""
    entries = F.sort_array(F.collect_list(F.struct("dim", "centre")))
    return centres.groupBy(cluster).agg(F.transform(entries, lambda e: e["centre"]).alias("centre"))


METRICS = (
    "euclid", "cityblock", "correlation", "abs_correlation", "uncentered", "abs_uncentered",
)


def distance(x: Column, y: Column, metric: str = "euclid", weights: list[float] | None = None) -> Column:
    """Weighted distance over the columns present in both arrays; 0 when there are none.

    euclid is sum(w d^2) / sum(w), without a root; cityblock is sum(w |d|) / sum(w). The
    correlation forms are 1 - r, 1 - |r|, centred or not; 1 when a side has no spread.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown distance: {metric}")
    if not weights and metric in ("euclid", "cityblock"):
        # one term, NULL where a side is missing: no list of triples is built
        term = (lambda a, b: (a - b) * (a - b)) if metric == "euclid" else (lambda a, b: F.abs(a - b))
        given = F.filter(F.zip_with(x, y, lambda a, b: term(a, b).cast("double")), lambda v: v.isNotNull())
        return _let({"v": given}, lambda s: F.when(F.size(s["v"]) == 0, 0.0).otherwise(_total(s["v"]) / F.size(s["v"])))
    w = F.array(*[F.lit(float(v)) for v in weights]) if weights else F.transform(x, lambda v: F.lit(1.0))
    zipped = F.filter(
        F.arrays_zip(x.alias("x"), y.alias("y"), w.alias("w")),
        lambda e: e["x"].isNotNull() & e["y"].isNotNull(),
    )
    terms = {
        "w": lambda a, b: F.lit(1.0),
        "x": lambda a, b: a,
        "y": lambda a, b: b,
        "xy": lambda a, b: a * b,
        "xx": lambda a, b: a * a,
        "yy": lambda a, b: b * b,
        "square": lambda a, b: (a - b) * (a - b),
        "abs": lambda a, b: F.abs(a - b),
    }
    needed = {
        "euclid": ["w", "square"],
        "cityblock": ["w", "abs"],
        "uncentered": ["w", "xy", "xx", "yy"],
        "correlation": ["w", "x", "y", "xy", "xx", "yy"],
    }[metric.removeprefix("abs_")]

    def sums(s) -> Column:
        def total(term) -> Column:
            return _total(F.transform(s["z"], lambda e: (e["w"] * term(e["x"], e["y"])).cast("double")))

        return F.struct(*[total(terms[t]).alias(t) for t in needed])

    def value(s) -> Column:
        t = s["t"]
        if metric == "euclid":
            return t["square"] / t["w"]
        if metric == "cityblock":
            return t["abs"] / t["w"]
        xy, xx, yy = t["xy"], t["xx"], t["yy"]
        if metric.endswith("correlation"):
            sx, sy = t["x"], t["y"]
            xy, xx, yy = xy - sx * sy / t["w"], xx - sx * sx / t["w"], yy - sy * sy / t["w"]
        r = xy / F.sqrt(xx * yy)
        r = F.abs(r) if metric.startswith("abs_") else r
        return F.when((xx <= 0) | (yy <= 0), 1.0).otherwise(1.0 - r)

    totals = _let({"z": zipped}, sums)
    return _let({"t": totals}, lambda s: F.when(s["t"]["w"] == 0, 0.0).otherwise(value(s)))


def row_to_centre(
    rows: DataFrame,
    centres: DataFrame,
    metric: str = "euclid",
    features: str = "features",
    cluster: str = "cluster",
    weights: list[float] | None = None,
) -> DataFrame:
    """Distance of each row to the centre of its cluster.

    Centres are one row per cluster, so the join is a broadcast as soon as their size says so.
    """
    joined = rows.join(centres, cluster)
    return joined.withColumn("distance", distance(F.col(features), F.col("centre"), metric, weights)).drop("centre")


def principal_components(rows: DataFrame, k: int, features: str = "features") -> DataFrame:
    """(component, explained_variance, loadings); the sign of a component is free."""
    model = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(rows.select(array_to_vector(features).alias("_vec")))
    # k times dimension numbers: the model itself
    matrix = model.pc.toArray()
    out = [
        (i, float(model.explainedVariance[i]), [float(v) for v in matrix[:, i]]) for i in range(k)
    ]
    return rows.sparkSession.createDataFrame(out, "component int, explained_variance double, loadings array<double>")


def project_components(rows: DataFrame, k: int, features: str = "features") -> DataFrame:
    """Rows with their coordinates on the first k principal components."""
    from pyspark.ml.functions import vector_to_array

    data = rows.withColumn("_vec", array_to_vector(features))
    model = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(data)
    return model.transform(data).withColumn("coordinates", vector_to_array("_pc")).drop("_vec", "_pc")
