"""Session helpers: a session with the engine's settings, and shipping the package to executors."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "sparkseek", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` override, with ``_`` for ``.`` in names."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in ``spark.checkpoint.dir``; of this machine only in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sparkseek.scratch", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkseek-")
        spark.conf.set("spark.sparkseek.scratch", at)
    return f"{at.rstrip('/')}/sparkseek/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not again when executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Size up to which :func:`spread` moves a table.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A table of few files dealt over all cores; one that gives each core a task, or is over ``SPREAD_BYTES``, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once a session, so that Python workers anywhere can import it."""
    context = spark.sparkContext
    if getattr(context, "_sparkseek_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.writestr(str(path.relative_to(root.parent)), path.read_bytes())
    at = os.path.join(tempfile.mkdtemp(prefix="sparkseek-"), "sparkseek_sources.zip")
    Path(at).write_bytes(data.getvalue())
    context.addPyFile(at)
    context._sparkseek_shipped = True
