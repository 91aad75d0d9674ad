"""Session helpers.

``get_session`` is for tests and local runs only; on a cluster the caller owns
the session and its settings.  ``checkpoint_dir`` reads the shared folder the
cluster names in ``spark.checkpoint.dir`` and only sets a scratch folder when
none is configured (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Reliable checkpoints (greedy rounds, sequential ids) are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # JVM default zone = session zone: interpreted fallbacks of oversized generated
    # code must not see a different clock than generated code does.
    "spark.driver.extraJavaOptions": "-Duser.timezone=UTC",
    "spark.executor.extraJavaOptions": "-Duser.timezone=UTC",
}


# Recommended settings for a large cluster (~100 TB input, ~1000 executors).  Not applied by
# the library: the cluster owns its session.  AQE re-plans every shuffle at run time.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",          # initial; AQE coalesces to ~256 MB partitions
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",   # long texts per Arrow batch
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.extraJavaOptions": "-Duser.timezone=UTC",
    "spark.executor.extraJavaOptions": "-Duser.timezone=UTC",
    # spark.checkpoint.dir: a shared, durable folder (set by the cluster)
}


def get_session(master: str | None = None, app: str = "newsloom", **conf: str) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a scratch one only if unset.

    A scratch folder of this machine is only seen by executors that run on it, so it is made for local
    masters alone; on a cluster the shared folder has to be named in ``spark.checkpoint.dir``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="newsloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Rows of an Arrow batch at most: texts and pages are long, and a worker holds a batch several times over
# (as Arrow, as Python strings, as results), so its memory must not grow with the rows of a task.
ARROW_ROWS = 500
_ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_arrow_batches(spark: SparkSession) -> None:
    """At most ``ARROW_ROWS`` rows per Arrow batch (a smaller setting of the session stays)."""
    rows = int(spark.conf.get(_ARROW_ROWS_KEY, "0"))
    if not 0 < rows <= ARROW_ROWS:
        spark.conf.set(_ARROW_ROWS_KEY, str(ARROW_ROWS))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``newsloom`` importable in Python workers (pandas UDFs, mapInPandas).

    Zips the package's sources once per application and adds the zip with
    ``addPyFile``, which distributes it to every executor.  Harmless when the
    package is already installed on the workers.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import newsloom

    pkg_dir = os.path.dirname(os.path.abspath(newsloom.__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="newsloom-", suffix=".zip")
    with zipfile.ZipFile(os.fdopen(fd, "wb"), "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg_dir):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def pin_utc(spark: SparkSession) -> None:
    """Session and driver-JVM default time zone to UTC (executors: ``-Duser.timezone=UTC``)."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    jvm = spark.sparkContext._jvm
    if jvm.java.util.TimeZone.getDefault().getID() != "UTC":
        jvm.java.util.TimeZone.setDefault(jvm.java.util.TimeZone.getTimeZone("UTC"))
