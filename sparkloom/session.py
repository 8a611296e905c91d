"""Session helpers shared by every operator: table access, lineage cuts and small-side checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "sparkloom") -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own (tests);
    on a cluster that is an error, as executors can't share a machine's folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sparkloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffle files, and checkpoints where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, stay on disk until it does, and a driver with a free heap seldom does. For loops that shuffle over and over."""
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Spread a computed frame over all cores before CPU-heavy work; by hash of ``cols`` if given."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *cols) if cols else df.repartition(n)


def widen(scan: DataFrame) -> DataFrame:
    """A scan (filters and projections at most) with work for every core.

    A scan of as many splits as there are cores stays as it is and is never shuffled; one of fewer is small by the split size
    (``spark.sql.files.maxPartitionBytes``) and is spread. A frame that shuffles is left to adaptive execution.
    """
    run = scan._jdf.queryExecution()
    if run.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return scan
    splits = run.toRdd().getNumPartitions()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if splits >= cores else scan.repartition(cores)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone (UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def salt_of(key: Column, buckets: int) -> Column:
    """A stable salt in [0, buckets) taken from a row key, so that retries of a task see the same value."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    The optimiser inlines a projected column into every later use, even into each step of a lambda; a generator of one row
    keeps it from doing so, without leaving the JVM.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(*columns)
    return df.select("*", made)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no shared file system or installation."""
    import os
    import shutil

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    work = tempfile.mkdtemp(prefix="sparkloom-ship-")
    shutil.copytree(os.path.join(root, "sparkloom"), os.path.join(work, "src", "sparkloom"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(work, "sparkloom_pkg"), "zip", os.path.join(work, "src")))
    _shipped.add(app)
