"""Sessions, tables and the shared folder that cut lineage is written to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "evalmill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the operators are tuned for.

    On a cluster the caller brings its own session; nothing here is needed then.
    """
    cores = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` of the session names; one of our own only where it is unset and the master is local."""
    sc = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return given
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="evalmill-checkpoint-")
    sc.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once as Parquet into the shared checkpoint folder and read from there.

    It cuts lineage as a checkpoint does, but is compressed and read by column, and executors that are lost take
    nothing with them. Its folder is that of the application, which the driver removes when it ends.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/evalmill-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that executors need no install."""
    sc = spark.sparkContext
    if sc.applicationId == _shipped.get("to"):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="evalmill-")) / "evalmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped["to"] = sc.applicationId


_shipped: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder (a file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
