"""Tables written to the shared folder for reuse in a plan, or kept by the content they were built from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what the context was given.

    Where neither is set in local mode a temporary folder is made on this machine; on a cluster that is an error, as no
    folder is known that all executors see.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = _made.get(sc.applicationId)
    if not root:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _made[sc.applicationId] = tempfile.mkdtemp(prefix="costloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/costloom-{sc.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone when Python exits
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    root = work_dir(spark)
    if root not in _made:
        _made[root] = root
        atexit.register(_remove, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def content_signature(rows: DataFrame, *cols: str) -> str:
    """16 hex digits of the rows' content, whatever their order; repeated rows count."""
    h = F.xxhash64(*cols)
    n, total, mixed = rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first()
    one = rows.sparkSession.range(1).select(F.md5(F.lit(f"{n}:{total}:{mixed}").cast("binary")))
    return one.first()[0][:16]


def written(spark: SparkSession, path: str) -> bool:
    """Whether a complete table is at path."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def load_or_build(spark: SparkSession, folder: str, name: str, signature: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, whether it was there): Parquet under folder/name-signature, complete tables only."""
    path = f"{folder.rstrip('/')}/{name}-{signature}"
    there = written(spark, path)
    if not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there
