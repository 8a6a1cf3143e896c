"""Session helpers: a local session for tests/bench and the checkpoint folder rule.

On a cluster the session is built by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A folder of our own is set only when that
setting is absent (local tests), never a machine-local folder on a cluster.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession

# Settings that matter for the plans this library builds.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # month partitions such as 202601 must stay strings when read back
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Set only when a session is built here: a running stream's checkpoint is tied to its
# state-store provider, so this is never changed on a caller's session.
BUILD_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # reliable checkpoints of finished plans (ordered scans, intake ledger keys) are removed
    # once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "intakeflow") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("INTAKEFLOW_DRIVER_MEM", "8g")))
    for k, v in {**SCALE_CONF, **BUILD_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_scale_conf(spark: SparkSession) -> None:
    """Runtime SQL settings the library relies on (safe to set on any session)."""
    for k, v in SCALE_CONF.items():
        if k == "spark.sql.execution.arrow.pyspark.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - conf may be locked by a platform
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a scratch one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a shared folder is required on a cluster")
        configured = tempfile.mkdtemp(prefix="intakeflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a dataset folder exists (Hadoop FileSystem of the path; works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in place of one that is there."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.writeUTF(text)
    finally:
        out.close()


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of ``write_note``; None if there is none."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    try:
        f = fs.open(p)
        try:
            return f.readUTF()
        finally:
            f.close()
    except Exception:  # noqa: BLE001 - cut short
        return None


def folder_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files and bytes under a folder."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return 0, 0
    found = fs.getContentSummary(p)
    return int(found.getFileCount()), int(found.getLength())


class Beside:
    """Work of small jobs done beside this thread's, with its local properties (job group, micro-batch); ``result`` waits
    for its end and returns or raises what it did."""

    def __init__(self, work: Callable):
        self._out = self._error = None

        def run():
            try:
                self._out = work()
            except BaseException as exc:  # noqa: BLE001 - raised by ``result``
                self._error = exc

        self._thread = InheritableThread(target=run)
        self._thread.start()

    def wait(self) -> None:
        self._thread.join()

    def result(self):
        self.wait()
        if self._error is not None:
            raise self._error
        return self._out
