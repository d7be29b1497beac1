"""Tables that cut lineage, kept where every executor can read them.

An operator writes its intermediate tables inside a ``scope``. When the scope ends, the
tables that its result does not read are deleted; those marked ``keep`` are handed to
the scope around it or, if there is none, stay until the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[tuple]] = []  # of each open scope its tables: (delete, keep)
_left: list = []  # functions that delete what has outlived its scope
_folders: dict[str, str] = {}  # a local application's own folder


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _folders:
        _folders[name] = f"file://{tempfile.mkdtemp(prefix='vigil-')}"
        _left.append(_deleter(spark, _folders[name]))
    return _folders[name]


def _deleter(spark: SparkSession, path: str):
    """A function that deletes the path, also after the session has stopped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete() -> None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    return delete


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those to keep."""
    own: list[tuple] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.pop()
        for delete, keep in own:
            if not keep:
                delete()
            elif _scopes:
                _scopes[-1].append((delete, False))
            else:
                _left.append(delete)


def new_path(spark: SparkSession, name: str, keep: bool = True) -> str:
    """A path for a table or archive, which belongs to the open scope."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete = _deleter(spark, path)
    if _scopes:
        _scopes[-1].append((delete, keep))
    else:
        _left.append(delete)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and a lost
    executor costs no more than reading it again. keep: the scope's result reads it."""
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for delete in reversed(_left):
        try:
            delete()
        except Exception:  # the engine has ended before us; the folder's owner cleans up
            return
