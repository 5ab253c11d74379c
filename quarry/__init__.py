"""A PySpark-native engine for evidence, graph and explanation analytics, with operators for training data."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def shared_base(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine (tests) a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "base" not in _OWN:
        _OWN["base"] = tempfile.mkdtemp(prefix="quarry-")
    return _OWN["base"]


def cut(df):
    """Materialise in the shared folder: later reads survive lost executors and don't recompute."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df):
    """As cut(), by a table in the shared folder: written in one pass, and read by column."""
    path = f"{shared_base(df.sparkSession)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark) -> None:
    """Send this package to the executors' Python, once per application; the same as --py-files with a zip of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quarry-ship-")) / "quarry.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
