"""Session construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "textlake",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session tuned for the engine; on a cluster pass ``master=None``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Arrow batches that feed the Python operators: bounded memory per batch.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        # checkpoint files of intermediates that are no longer referenced are
        # removed from the shared folder
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        # local mode runs every task inside the driver JVM: give it real heap
        # (only effective when this call starts the JVM)
        conf["spark.driver.memory"] = "12g"
        # the session catalog's default database folder: not the working dir
        conf["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="textlake-warehouse-", dir="/tmp")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only a local master
    may go without: it gets a scratch folder (local runs and tests). On a
    cluster a machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf:
        conf = tempfile.mkdtemp(prefix="textlake-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables.

    The application's scratch tables are dropped by :func:`drop_scratch`, at
    the latest when the driver's Python ends.
    """
    base = os.path.join(ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        atexit.register(drop_scratch, spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


_SCRATCH: set[str] = set()


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application (none may be in use any more)."""
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended
        return
    base = os.path.join(sc.getCheckpointDir() or "", "tables", sc.applicationId)
    if base in _SCRATCH:
        path = sc._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.discard(base)


def materialize(df):
    """Reliable checkpoint into the shared folder (lineage is cut there).

    Used for small or reused intermediates; never ``localCheckpoint``,
    which would lose the data with its executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textlake`` importable in the Python workers.

    Arrow UDFs and ``mapInArrow`` kernels refer to textlake functions by
    module, so the workers must be able to import the package even when the
    caller's working directory or PYTHONPATH does not contain it. A zip of
    the package is built once per application and shipped by Spark itself
    (``addPyFile``), which also reaches executors on a cluster.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="textlake-py-"), "textlake.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, dirnames, filenames in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in filenames:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
