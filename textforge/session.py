"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library's results rely on (UTC) and those for its plans (adaptive execution)."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context; its Python functions run there, on batches of 2,000 rows and 4 MB."""
    context = spark.sparkContext
    if getattr(context, "_textforge_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="textforge-")
    path = os.path.join(folder, "textforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(HERE.rglob("*.py")):
            z.write(file, f"textforge/{file.relative_to(HERE)}")
    context.addPyFile(path)
    context._textforge_shipped = True
    # Rows are whole documents here, and documents beside parts of others: the defaults would make batches of tens of megabytes,
    # which a task holds in the JVM and in Python, each at up to twice its size.
    for key, default, less in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, less)


def checkpointed(df: DataFrame) -> DataFrame:
    """The table cut off from its plan, in the folder that the cluster names in ``spark.checkpoint.dir``; only where that's unset and
    all runs on one machine, in a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="textforge-"))
    return df.checkpoint()
