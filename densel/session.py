"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "densel", shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one with sane defaults.

    On a cluster the session already exists and nothing here overrides it.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_shipped(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DENSEL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shipped(spark)
    return spark


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The cluster names its shared folder in ``spark.checkpoint.dir``; it is read
    from the session and only set here when it is unset (local tests).
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        ensure_checkpoint_dir(spark)
        base = sc.getCheckpointDir()
    sub = f"{name or 'scratch'}-{uuid.uuid4().hex[:12]}"
    return base.rstrip("/") + "/" + sub


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable: keep the cluster's setting, set one only if unset.

    Only a local master may go without ``spark.checkpoint.dir``: on a cluster a folder of one
    machine is not seen by the others, so there this fails.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = os.path.join(tempfile.gettempdir(), "densel-checkpoints")
        sc.setCheckpointDir(base)


def remove_scratch(spark: SparkSession) -> None:
    """Delete everything this session wrote below the shared folder (call when its results are no longer read)."""
    base = spark.sparkContext.getCheckpointDir()
    if base:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ensure_shipped(spark: SparkSession) -> None:
    """Ship this package to the Python workers once per SparkContext (like ``--py-files``).

    The archive is built in memory and written through the Hadoop FileSystem API into the
    shared scratch folder (``spark.checkpoint.dir``), then added with ``addPyFile``; no
    machine-local temporary folder is involved.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_densel_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    target = scratch_dir(spark, "pyfiles") + "/densel.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    sc._densel_shipped = True


def materialise(df):
    """Cut lineage of an expensive intermediate that several jobs reuse (e.g. the kNN density table).

    A reliable ``checkpoint()`` writes it once into the shared ``spark.checkpoint.dir``, so
    later jobs (and re-tried tasks after a lost executor) read the written table instead of
    recomputing the distance blocks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, key: str):
    """Give row-heavy work (whole-text scans) every core when the source has fewer splits than cores.

    A no-op once the input already has at least ``defaultParallelism`` partitions, as any large
    input does; a single-row-group file otherwise runs its per-row work in one task. Call it on
    a scan only: asking a plan with exchanges for its partition count would run those stages.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)
