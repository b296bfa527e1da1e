"""Session defaults, code shipping and the shared scratch folder."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(cores: int = 8, app: str = "wordloom", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows in an Arrow batch. Spark's default, 10,000, makes batches of texts too large for an executor's free memory.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that Arrow functions find it, and keep Arrow
    batches small where the session has Spark's default."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_wordloom_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, f"{PACKAGE.name}/{path.relative_to(PACKAGE)}")
    folder = os.path.realpath(tempfile.mkdtemp(prefix="wordloom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"wordloom_{uuid.uuid4().hex[:8]}.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    sc._wordloom_shipped = True


#: Bytes of files in a partition of documents whose tokens become rows of their own, about twenty times as large.
DEALT_BYTES = 8 << 20
#: The most partitions that a size alone asks for, as sizes of joins are guesses.
MOST_DEALT = 2000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by their keys into partitions of about ``DEALT_BYTES`` of the files that are read, and no fewer than the
    session's; that number alone where the size is not known.

    Token rows of dealt documents lie by document already: windows, groups and joins by document exchange none of them, only
    the texts were. The number is fixed, as Spark would join partitions by the size of the texts, not of their tokens.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(least, min(size // DEALT_BYTES, MOST_DEALT)) if size < 1 << 40 else least, *keys)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else one of our own.

    The fallback is for local sessions, where driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "wordloom-scratch")
    return root.rstrip("/")


#: Whether Spark removes the shuffle files of a query at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A written table cuts the lineage: after the loss of an executor its rows are read again, not
    recomputed. ``drop`` removes a table whose readers have all been written themselves.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/wordloom/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written and read again. What was shuffled for them is removed, as nobody reads it any more."""
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Remove the whole folder: for runs whose result has been written elsewhere."""
        self._delete(self.root)

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write what a run returns and remove all its other tables."""
        out = Scratch(self.spark, name)
        kept = out.keep(df, "rows")
        self.close()
        return kept

    def _delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
