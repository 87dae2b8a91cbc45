"""Making the package known to the Python workers of a session that was started elsewhere."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application; Spark's file server hands it to later ones too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder) / "tree"
        shutil.copytree(root / "quillgraph", copy / "quillgraph", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quillgraph-')}/quillgraph", "zip", copy)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
