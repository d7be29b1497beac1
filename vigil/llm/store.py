"""Tables that cut lineage, as everywhere in the library, and how many rows at a time go to Python."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from vigil.store import new_path, scope, shared_folder, written

__all__ = ["arrow_rows", "new_path", "scope", "shared_folder", "written"]


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs that run inside hand at most n rows at a time to Python; the session's setting, if less, stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)
