"""What a session needs before its Python workers can run this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name in the one for checkpoints, which the driver and all executors share; only a session in one process gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='framelog-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark, once for each application, so that they need neither its folder nor a path to it."""
    context = spark.sparkContext
    if getattr(context, "_framelog_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="framelog-")) / "framelog_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    context.addPyFile(str(archive))
    context._framelog_shipped = True
