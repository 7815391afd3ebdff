"""Tables that cut lineage, as the library stores them, and the width of keyed Python groups."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.tables import forget, shared_dir
from ..operators.tables import stored as written

__all__ = ["forget", "shared_dir", "width", "written"]


def width(spark: SparkSession) -> int:
    """Tasks to deal keyed Python groups to: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
