"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings the plans of this library are made for; any session can take them at run time.
SETTINGS = {
    # slots and times are UTC
    "spark.sql.session.timeZone": "UTC",
    # join strategy and partition sizes from measured sizes, skewed joins split
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # wide text projections exceed what the JVM compiles as one method; beyond this size
    # Spark generates them in pieces that it does compile
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "flowtide") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # without call sites in error messages, plans are built several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    tune(spark)
    share_below_warehouse(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share: below `spark.checkpoint.dir`.

    Where that setting is missing, the directory given to `SparkContext.setCheckpointDir`
    counts. Without either there is no place every executor can read, and this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/flowtide-{purpose}-{uuid.uuid4().hex}"


def share_below_warehouse(spark: SparkSession) -> None:
    """Where a session names no shared folder, share one below its warehouse, which is shared too."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")


def hold(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, and nothing to release on executors.

    The files go when the application ends, or before with `drop_held`.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop_held(df: DataFrame) -> None:
    """Delete what `hold` wrote for `df`, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("flowtide-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
