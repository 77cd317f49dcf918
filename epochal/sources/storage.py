"""Where the engine keeps intermediate tables: the shared folder that the cluster names in spark.checkpoint.dir.

All tables of an application lie below one folder, which the file system deletes
when the driver's JVM ends. ``owned`` deletes earlier: what is written inside its
block goes at the end of it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)
#: Folders of applications that go with the driver's JVM.
_LEAVING: set[str] = set()


def base_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="epochal-")
        _at_exit(spark, base)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _at_exit(spark: SparkSession, path: str) -> None:
    if path not in _LEAVING:
        at, store = _fs(spark, path)
        store.mkdirs(at)
        store.deleteOnExit(at)
        _LEAVING.add(path)


def shared_dir(spark: SparkSession) -> str:
    """A new folder path below the owner's folder, or else the application's."""
    above = _OWNER.get()
    if above is None:
        above = f"{base_dir(spark)}/epochal-{spark.sparkContext.applicationId}"
        _at_exit(spark, above)
    return f"{above}/{uuid.uuid4().hex}"


@contextmanager
def owned(spark: SparkSession) -> Iterator[str]:
    """What is written inside goes at the end; frames that read it can't be read afterwards."""
    path = shared_dir(spark)
    before = _OWNER.set(path)
    try:
        yield path
    finally:
        _OWNER.reset(before)
        removed(spark, path)


def written(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and lost executors cost nothing twice."""
    path = path or shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Delete a shared folder that is no longer read."""
    at, store = _fs(spark, path)
    store.delete(at, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the target must not exist."""
    at, store = _fs(spark, source)
    to, _ = _fs(spark, target)
    store.mkdirs(to.getParent())
    if store.exists(to) or not store.rename(at, to):
        raise FileExistsError(target)


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _fs(spark, path)
    return store.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; empty if there is no such folder."""
    at, store = _fs(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def said(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    at, store = _fs(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put(store, at, text: str, overwrite: bool) -> None:
    stream = store.create(at, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def noted(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over an older one."""
    at, store = _fs(spark, path)
    _put(store, at, text, True)


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, unless there is one; whether this call made it.

    Of several writers just one succeeds: by a hard link on local file systems,
    by creation without overwriting on object stores (which make a file visible
    when it is closed, and need conditional writes for this), by renaming on
    others, such as HDFS, which never rename onto a file.
    """
    at, store = _fs(spark, path)
    store.mkdirs(at.getParent())
    if store.exists(at):
        return False
    scheme = store.getUri().getScheme()
    if scheme in ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs", "oss"):
        try:
            _put(store, at, text, False)
        except Exception as e:
            if store.exists(at):
                return False
            raise e
        return True
    draft, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    _put(store, draft, text, False)
    try:
        if scheme != "file":
            return bool(store.rename(draft, at))
        jvm = spark.sparkContext._jvm
        of = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(of(at), of(draft))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        store.delete(draft, False)
