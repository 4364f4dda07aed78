"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}  # application id -> name of the archive it has


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duochron")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Only one JVM on one machine
    (local mode, as in tests) may do without the setting and gets a temporary folder."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="duochron-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def _archive() -> bytes:
    """This package's modules as a zip."""
    top = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for n in sorted(n for n in names if n.endswith(".py")):
                whole = os.path.join(folder, n)
                with open(whole, "rb") as f:
                    z.writestr(zipfile.ZipInfo(os.path.relpath(whole, os.path.dirname(top))), f.read())
    return out.getvalue()


def shipped(df: DataFrame) -> DataFrame:
    """`df`, after executors were given this package, which need not be installed there.

    Every operator that runs Python in tasks calls this first. The archive goes to the shared folder once
    an application. Workers import the modules from it like any others, so what a module keeps (compiled
    tables, caches) lives as long as the worker process and not only for one task.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        data = _archive()
        name = f"duochron-{hashlib.sha256(data).hexdigest()[:16]}.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark).rstrip('/')}/{sc.applicationId}/{name}")
        out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path, True)
        out.write(data)
        out.close()
        where = path.toString()
        sc.addPyFile(where if ":" in where else f"file:{where}")
        _SHIPPED[sc.applicationId] = name
    return df


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage.

    Lost executors then re-read the files instead of recomputing, so values that depend on
    where a row landed (range-partition numbers) can never change between two readers. Spark
    removes the files when the DataFrame is gone, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as `local_session` does.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
