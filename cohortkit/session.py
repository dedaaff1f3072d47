"""Session settings the operators count on, and lineage cutting."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Person, concept and site keys are skewed in real event tables.  AQE splits a
# hot join partition by its measured size; the force flag lets it do so even
# where a grouping on the same key follows (one more shuffle, only when skewed).
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes (memory, shuffle partitions) stay the caller's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; our own only for a local master."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        # with a local master every task sees the same disk; elsewhere it would not
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="cohortkit-checkpoint-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared checkpoint folder and cut its lineage.

    A written table rather than DataFrame.checkpoint(): the plan runs once, not
    twice, and later reads prune columns.  A lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cohortkit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def drop_checkpoint(*tables: DataFrame) -> None:
    """Delete tables of ``checkpoint`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers of the session, once.

    Needed where it is not installed on the executors; they fetch the archive from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_cohortkit_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(here.rglob("*.py")):
            archive.write(path, path.relative_to(here.parent))
    name = Path(tempfile.mkdtemp(prefix="cohortkit-ship-")) / "cohortkit.zip"
    name.write_bytes(packed.getvalue())
    context.addPyFile(str(name.resolve()))
    context._cohortkit_shipped = True
    return spark
