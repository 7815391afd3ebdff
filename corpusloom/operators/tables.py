"""Small helpers of the operators: checked broadcasts, and steps stored in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the running session. Only a local session may do without:
a folder of this process is made and set. A stored step is read again, never computed again, so it
outlives lost executors; ``forget`` removes one that nothing reads any more, ``clear`` all of them.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BROADCAST_ROWS

_kept: dict[str, SparkSession] = {}


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if the side has been counted and is small enough."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str = "step") -> DataFrame:
    """``df`` written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def blocks(df: DataFrame, size: int) -> list[DataFrame]:
    """``df`` in blocks of exactly ``size`` rows, the last less; stored and numbered where it is more than one."""
    if df.count() <= size:
        return [df]
    numbered = stored(df.withColumn("at", F.monotonically_increasing_id()))  # the partition's number above 33 bits of place
    sizes = numbered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    cuts, before = [], 0
    for part, n in sizes:
        cuts += [(part << 33) + place - before for place in range(-(-before // size) * size, before + n, size)]
        before += n
    return [numbered.filter((F.col("at") >= low) & (F.col("at") < high)).drop("at") for low, high in zip(cuts, [*cuts[1:], 2**62], strict=True)]


def _remove(path: str) -> None:
    spark = _kept.pop(path, None)
    if spark is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that no DataFrame reads any more."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            _remove(path)


def clear() -> None:
    """Remove all that this process has stored: for the end of a job, when its results are read or written."""
    for path in list(_kept):
        _remove(path)


def ordered(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ``ids``, equal ones for equal ids."""
    return ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1].reshape(ids.shape)


def column_array(column: pa.Array) -> np.ndarray:
    """Ids as NumPy has them: integers, else objects."""
    out = column.to_numpy(zero_copy_only=False)
    return out if out.dtype.kind in "iu" else out.astype(object)
