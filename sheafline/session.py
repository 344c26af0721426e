"""Session settings, and this package on the executors."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def create(app: str = "sheafline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are left to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors by way of the shared folder, once an application."""
    from sheafline.plans.tables import shared_dir

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(str(f.relative_to(top.parent)), f.read_bytes())
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sheafline/core-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)
