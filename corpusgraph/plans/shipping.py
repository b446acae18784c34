"""Getting this package to the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark once a session, unless the workers' PYTHONPATH has it."""
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(ROOT.parent) in paths or getattr(context, "_corpusgraph_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "corpusgraph.zip")
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(ROOT.rglob("*.py")):
            out.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(target)
    context._corpusgraph_shipped = True
