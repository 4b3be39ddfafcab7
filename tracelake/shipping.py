"""Makes the package importable by Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the workers once a session, unless PYTHONPATH has them already."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if any("tracelake-sources" in f for f in context._python_includes):
        return
    path = Path(tempfile.mkdtemp(prefix="tracelake-"), "tracelake-sources.zip")  # the driver serves it as long as it runs
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.glob("tracelake/**/*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(str(path))
