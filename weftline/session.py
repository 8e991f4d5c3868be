"""Sessions for tests and benchmarks, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("weftline")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
    }
    return builder.config(map=settings | conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir; only where that is unset and Spark runs in one process, as in tests, a new one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not (context.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="weftline-"))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/weftline-{tag}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package (a few small source files), once for each Spark application."""
    checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
