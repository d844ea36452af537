"""What a session needs before Python functions of this package run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their PYTHONPATH already has it."""
    context = spark.sparkContext
    on_path = [os.path.realpath(x) for x in os.environ.get("PYTHONPATH", "").split(":") if x]
    if str(ROOT.parent) in on_path or getattr(context, "_labelwright_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="labelwright-ship-"), "labelwright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in ROOT.rglob("*.py"):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(path)
    context._labelwright_shipped = True
