"""Files of any Hadoop file system: what exists, rows written aside, exclusive use of a folder, and tables that are replaced whole, version by version."""

from __future__ import annotations

import contextlib
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Seconds to wait for a lock, and the age from which a lock is taken for one of a dead process.
WAIT, STALE = 3600.0, 6 * 3600.0


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists; any other failure to find out is raised."""
    return _system(spark, path).exists(_path(spark, path))


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob matches, in order; none if its beginning doesn't exist."""
    return sorted(s.getPath().toString() for s in _system(spark, pattern).globStatus(_path(spark, pattern)) or [])


def make(spark: SparkSession, path: str) -> None:
    _system(spark, path).mkdirs(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all that it holds, if it is there."""
    _system(spark, path).delete(_path(spark, path), True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file; done already if only the target is there."""
    if not exists(spark, source) and exists(spark, target):
        return
    if not _system(spark, source).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _system(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; on one machine our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="airq-checkpoint-"))
    return found or context.getCheckpointDir()


#: The scratch paths of the ``cleaned`` block that the caller is in.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; within ``cleaned`` it is deleted at the end, else it is the caller's."""
    path = f"{shared_dir(spark)}/airq-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is written aside within; nothing that reads it may leave the block."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            remove(spark, path)


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder; a cached plan would be computed anew once a table that it reads changes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _claim(spark: SparkSession, path: str) -> bool:
    """Create a file that must not exist yet, in one step; whether it was created."""
    system = _system(spark, path)
    if system.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates afterwards
        try:
            os.close(os.open(_path(spark, path).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    if system.exists(_path(spark, path)):
        return False
    try:
        system.create(_path(spark, path), False).close()
    except Py4JJavaError:
        if system.exists(_path(spark, path)):  # another writer was first
            return False
        raise
    return True


@contextlib.contextmanager
def locked(spark: SparkSession, root: str, wait: float = WAIT, stale: float = STALE) -> Iterator[None]:
    """Exclusive use of ``root`` among all writers that ask for it, by a file that only one of them can create.

    The file system must refuse to create a file twice, as HDFS and local ones do. A lock older than ``stale`` seconds is broken;
    ``TimeoutError`` after ``wait`` seconds.
    """
    path, until = f"{root}/_lock", time.monotonic() + wait
    system = _system(spark, root)
    make(spark, root)
    while not _claim(spark, path):
        with contextlib.suppress(Exception):  # the owner may delete it between both calls
            if time.time() - system.getFileStatus(_path(spark, path)).getModificationTime() / 1000 > stale:
                remove(spark, path)
                continue
        if time.monotonic() > until:
            raise TimeoutError(f"{path} is held by another writer")
        time.sleep(0.2)
    try:
        yield
    finally:
        remove(spark, path)


def publish(df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Write ``df`` aside and make it the newest version of the table at ``path`` by one rename; the newest ``keep`` versions stay.

    Readers of ``current`` see the old version or the new one, whole, at any time, as no name is ever used again; one that
    began with the old version can end with it. ``df`` may read the table itself.
    """
    spark = df.sparkSession
    with locked(spark, path):
        versions = folders(spark, f"{path}/versions/*")
        number = int(versions[-1].rsplit("/", 1)[1]) + 1 if versions else 0
        fresh, target = f"{path}/_writing/{uuid.uuid4().hex}", f"{path}/versions/{number:012d}"
        df.write.parquet(fresh)
        make(spark, f"{path}/versions")
        move(spark, fresh, target)
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            remove(spark, old)
    return spark.read.schema(df.schema).parquet(target)


def current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The newest version of a published table."""
    versions = folders(spark, f"{path}/versions/*")
    if not versions:
        raise FileNotFoundError(f"nothing was published at {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(versions[-1])
