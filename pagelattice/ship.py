"""The package's code sent to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session once, so that Python workers can import it
    wherever they run; where it is installed already, that changes nothing."""
    sc = spark.sparkContext
    if getattr(sc, "_pagelattice_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pagelattice-code-")) / "pagelattice.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("pagelattice") / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._pagelattice_shipped = True
