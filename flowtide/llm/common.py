"""Helpers the operators of this subpackage share: shared folders, lineage cuts, free names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share: `spark.checkpoint.dir` of the session.

    Where it is unset, the directory given to `SparkContext.setCheckpointDir` counts; without
    either there is no place that every executor can read, and this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/llm-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read back: a lineage cut that outlives executors."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove what `stored` wrote for `df`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        if path.getName().startswith("llm-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """`base`, with underscores added until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """`docs` with a number that is different for each row and in order of ids, and its column's name.

    Whole-number ids that are all different are these numbers themselves. Else rows are put in
    order of id, null first, then text, and numbered, in a table in the shared folder.
    """
    name = fresh_name(docs, "u")
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    ids = docs.groupBy(F.col(id_col).alias("i")).count()
    if whole and not ids.filter((F.col("count") > 1) | F.col("i").isNull()).limit(1).count():
        return docs.withColumn(name, F.col(id_col).cast("long")), name
    order = [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()]
    # equal rows may be dealt over several partitions
    rows = docs.repartitionByRange(*order, F.rand(3)).sortWithinPartitions(*order)
    return stored(rows.withColumn(name, F.monotonically_increasing_id()), "ordered"), name
