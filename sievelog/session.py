"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_sent: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files once, unless its folder already is on the workers' path."""
    context = spark.sparkContext
    if context in _sent:
        return spark
    if str(ROOT.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        to = Path(tempfile.mkdtemp(prefix="sievelog-code-")) / "sievelog.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in ROOT.rglob("*.py"):
                z.write(f, f.relative_to(ROOT.parent))
        context.addPyFile(str(to))
    _sent.add(context)
    return spark
