"""Session helpers: a local session for tests and a reliable checkpoint folder.

On a cluster the operator never invents a checkpoint folder: it reads
``spark.checkpoint.dir`` (the shared folder the cluster names).  Only a
``local[...]`` session without that setting gets a scratch folder under /tmp.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "corpusforge") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


#: Most bytes of an Arrow batch that a Python worker gets; a lower bound of the session's stays.
BATCH_BYTES = 4 << 20

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusforge`` importable in the Python workers (once per SparkContext).

    Task-side functions (Arrow UDFs, grouped maps, the archive source) import the
    package on executors; the driver's ``sys.path`` does not reach them, so the
    package is zipped from its source files and added with ``addPyFile``.  The zip
    on the driver is only the source Spark's file server ships; no job reads or
    writes shared state there.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="corpusforge-py-"), "corpusforge.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(key)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches have at most ``BATCH_BYTES``.

    With Spark's own bound (10,000 rows, 64 MB) a worker's memory grows with the rows of its task until a batch is full.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = int(spark.conf.get(key).rstrip("bB"))
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def prepare(spark: SparkSession) -> str:
    """Ship the package to the workers, bound their batches and make sure a reliable checkpoint folder is set."""
    ship_package(spark)
    bound_batches(spark)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only for local sessions."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="corpusforge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
