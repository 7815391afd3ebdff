"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default suits numbers, not texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="corpusloom-src-")) / "corpusloom_src.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
