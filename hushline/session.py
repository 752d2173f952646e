"""Session helpers: local sessions, and shipping this package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch between the JVM and Python, so that long texts don't make it large; a session's own setting goes before.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def local_session(cpus: int = 8, partitions: int = 8, name: str = "hushline") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("HUSHLINE_DRIVER_MEMORY", "8g")).getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once per application, as a zip served by the driver, and bounds the session's batches."""
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        path = Path(tempfile.mkdtemp(prefix="ship-")) / "hushline_code.zip"
        path.write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder that the cluster names. One of our own only where none is set and all runs on this machine; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
