"""Helpers shared by the corpus operators: table reading, shared scratch tables, size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows up to which a small side (a few dozen bytes a row) may be broadcast.
BROADCAST_ROWS = 50_000

#: Folders of the tables written so far.
_written: ContextVar[list[str]] = ContextVar("written", default=[])  # noqa: B039  one list for all that open none of their own

#: Salts used to spread a hot key when the small side is too large to broadcast.
SALTS = 32


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table, read by Spark alone so that any store works."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="airq-checkpoint-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, whoever is lost."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/airq-{uuid.uuid4().hex}"
    _written.get().append(folder)
    df.write.option("compression", "zstd").parquet(f"{folder}/{tag}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{tag}")


@contextlib.contextmanager
def own_tables() -> Iterator[list[str]]:
    """Collect the folders of the tables that are written within, apart from those of other callers."""
    token = _written.set([])
    try:
        yield _written.get()
    finally:
        _written.reset(token)


def discard(spark: SparkSession, folders: list[str] | None = None, keep: int = 0) -> None:
    """Delete the tables of some folders, or all that were written so far, but the last ``keep``; call it once the results that read them have been written."""
    folders = _written.get() if folders is None else folders
    gone = folders[: len(folders) - keep]
    del folders[: len(gone)]
    for folder in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let no more rows than these go to a Python worker at once, from now on in this session.

    By default 10,000 do, whole texts of which take tens of megabytes several times over: in the JVM, on the way and in the
    worker. No result depends on it, so it isn't set back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives unused memory back to the system at the end; a worker that is used again keeps it otherwise."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def row_hash(df: DataFrame) -> Column:
    """A hash of whole rows; maps, which Spark doesn't hash, go by their text."""
    return F.xxhash64(*[F.to_json(F.struct(_named(f.name))) if "map<" in f.dataType.simpleString() else _named(f.name) for f in df.schema.fields])


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def as_row(df: DataFrame, **beside: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``row``, and columns of them set beside it, which so clash with none."""
    return df.select(F.struct(*[_named(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in beside.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a possibly skewed ``big`` with ``small``, a materialised table with unique, non-null keys.

    The small side is broadcast only after its rows were counted; beyond the bound, the keys are
    salted on both sides, so that a key holding a third of ``big`` is spread over many tasks. They are merged there,
    whatever size Spark takes the salted rows for: it takes them for one of the ``SALTS`` copies, as its files hold it.
    """
    if small.count() <= rows:
        return big.join(F.broadcast(small), on, how)
    salt = "salt_" + uuid.uuid4().hex
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = big.withColumn(salt, F.pmod(row_hash(big), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), [*on, salt], how).drop(salt)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings, dots written as ``__``, for the jobs planned within; restored afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
