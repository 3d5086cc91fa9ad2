"""Making the package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
NAME = "ledgerloom-src.zip"


def _inherited(master: str) -> bool:
    """Whether workers on this machine find the package by a path they inherit from the driver."""
    if not master.startswith("local"):
        return False
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not master.startswith("local-cluster"):
        paths.append(os.getcwd())
    return any(p and Path(p, "ledgerloom", "functions", "shipping.py").is_file() for p in paths)


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once a session, unless they find it anyway."""
    sc = spark.sparkContext
    if _inherited(sc.master) or any(NAME in str(x) for x in sc.listFiles):
        return
    target = Path(tempfile.mkdtemp(prefix="ledgerloom-"), NAME)
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "ledgerloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
