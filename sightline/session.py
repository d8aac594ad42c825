"""Session construction and shipping of this package to Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sightline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver was started.

    Workers see it already when the repository is on PYTHONPATH or is the working folder;
    otherwise the sources go to the executors as a zip through ``addPyFile``."""
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in seen or os.path.realpath(os.getcwd()) == str(ROOT):
        return
    shipped = getattr(sys.modules[__name__], "_shipped", None)
    if shipped == spark.sparkContext.applicationId:
        return
    out = Path(tempfile.mkdtemp()) / "sightline_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in ROOT.joinpath("sightline").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
        for p in ROOT.glob("*.py"):
            z.write(p, p.name)
    spark.sparkContext.addPyFile(str(out))
    sys.modules[__name__]._shipped = spark.sparkContext.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir. Only a local session may do without one, and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sightline-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors. Nothing deletes it: the folder's owner clears it between jobs."""
    path = f"{shared_folder(df.sparkSession)}/sightline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
