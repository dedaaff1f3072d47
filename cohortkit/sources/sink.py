"""Datasets stored as tables bucketed by person, so that joins between them need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame

from cohortkit.session import checkpoint, shared_folder

#: Buckets of a stored table; all tables that are to be joined need the same number.
BUCKETS = 64


def store(df: DataFrame, name: str, key: str = "person_id", buckets: int = BUCKETS,
          folder: str | None = None) -> DataFrame:
    """Write ``df`` as the table ``name``, bucketed and sorted by ``key``, and read it back.

    A later join or grouping on the key reads bucket by bucket, without an exchange.  Rows are
    rebalanced by the key before they are written: small buckets come in one file, and one that
    a hot key fills is written by several tasks.  The table's files go to ``folder`` (default: the
    warehouse); a table of that name is replaced.
    """
    writer = (df.hint("rebalance", buckets, key).write.mode("overwrite").format("parquet")
              .bucketBy(buckets, key).sortBy(key))
    if folder is not None:
        writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_keep(key: str = "person_id", buckets: int = BUCKETS) -> Callable[[DataFrame], DataFrame]:
    """A ``keep`` for a study: datasets that have the key become bucketed tables in the shared
    checkpoint folder, others plain ones."""
    def keep(df: DataFrame) -> DataFrame:
        if key not in df.columns:
            return checkpoint(df)
        return store(df, f"kept_{uuid.uuid4().hex}", key, buckets, shared_folder(df.sparkSession))
    return keep


def write_datasets(study: object, names: Iterable[str], prefix: str = "", key: str = "person_id",
                   buckets: int = BUCKETS, folder: str | None = None) -> Mapping[str, DataFrame]:
    """Store the named datasets of a study, one table each, and return them as stored.

    Datasets without the key are written as tables without buckets."""
    out = {}
    for name in names:
        df = getattr(study, name)
        if key in df.columns:
            out[name] = store(df, prefix + name, key, buckets, folder)
            continue
        writer = df.write.mode("overwrite").format("parquet")
        if folder is not None:
            writer = writer.option("path", f"{folder.rstrip('/')}/{prefix}{name}")
        writer.saveAsTable(prefix + name)
        out[name] = df.sparkSession.table(prefix + name)
    return out
