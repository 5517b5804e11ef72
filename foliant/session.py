"""Session defaults and shipping of this package's code to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build(app: str = "foliant", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; other settings are left to the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once an application. Spark's file server carries the archive."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.join("foliant", os.path.relpath(os.path.join(folder, name), root)))
    path = os.path.join(tempfile.mkdtemp(), f"foliant-{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets its own under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
        os.makedirs("/tmp/checkpoints", exist_ok=True)
    return base.rstrip("/")


def forget(spark: SparkSession) -> None:
    """Removes this application's working tables; what is lazily read from them is lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/foliant/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
