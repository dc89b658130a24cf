"""Session helpers: a local session for tests/bench and the checkpoint folder lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scriptorium") -> SparkSession:
    """A local session for tests and the bench. On a cluster, build your own session;
    the library only reads settings from it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is used as is; without it a
    cluster session raises, because executors would write to their own disks. Only a local
    master (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scriptorium`` importable in the Python workers (model calls, pandas UDFs)
    when the job was not submitted with it on the path: zip the package once and hand it
    to ``SparkContext.addPyFile``, which distributes it to every executor."""
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="scriptorium-pkg-"), "scriptorium.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_parallelism(df, min_partitions: int | None = None):
    """Spread a CPU-heavy per-row stage over at least ``min_partitions`` tasks (default:
    the cluster's default parallelism). A scan of a few large row groups can yield fewer
    partitions than cores; only then is the input round-robin repartitioned (one shuffle
    of the rows). With many input splits, as on a cluster, the frame is returned as is."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    # Only a scan tells its partitions without running anything: counting those of a plan
    # with a shuffle would execute the shuffle. Such plans are partitioned already.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Aggregate", "Join", "Repartition", "Sort", "Window", "Generate")) or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
