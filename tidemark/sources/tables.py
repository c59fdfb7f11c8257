"""Tables that a run writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only on a local master may it be unset; a temporary one is set then."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, wherever Spark can read."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if there is none."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file: it has the old text or the new one, or, for a moment, none."""
    fs, new = _file_system(spark, f"{path}.{uuid.uuid4().hex}.new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    p = _file_system(spark, path)[1]
    if not fs.rename(new, p):  # some stores rename over no file
        fs.delete(p, False)
        fs.rename(new, p)


def listing(spark: SparkSession, path: str) -> str:
    """A table's files by name, size and time: what tells without reading them whether anybody changed them."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return ""
    found, root = [], p.toUri().getPath()
    files = fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toUri().getPath()
        if not name.rsplit("/", 1)[1].startswith((".", "_")):
            found.append(f"{name.removeprefix(root)}|{f.getLen()}|{f.getModificationTime()}")
    return "\n".join(sorted(found))


_scopes = threading.local()


class Scope:
    """Tables that a thread writes ``with`` it are deleted by ``close``, when nothing reads them any more, instead of at
    the session's end. Scopes nest; several threads may write with one."""

    def __init__(self):
        self.made: list[tuple[SparkSession, str, str | None]] = []

    def __enter__(self) -> Scope:
        _scopes.stack = [*getattr(_scopes, "stack", ()), self]
        return self

    def __exit__(self, *_) -> None:
        _scopes.stack = _scopes.stack[:-1]

    def close(self) -> None:
        while self.made:
            _delete(*self.made.pop())


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """A scope that closes at its end."""
    own = Scope()
    try:
        with own:
            yield
    finally:
        own.close()


@contextlib.contextmanager
def outside() -> Iterator[None]:
    """Tables written inside are those of the scope around the innermost one: a caller's, who reads them after that one has
    closed. Without one they stay until the session's end."""
    stack = getattr(_scopes, "stack", ())
    _scopes.stack = stack[:-1]
    try:
        yield
    finally:
        _scopes.stack = stack


def _made(spark: SparkSession, path: str, name: str | None) -> None:
    if stack := getattr(_scopes, "stack", ()):
        stack[-1].made.append((spark, path, name))
    else:
        atexit.register(_delete, spark, path, name)


def _delete(spark: SparkSession, path: str, name: str | None) -> None:
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is then the cluster's to clean
        pass


def new_folder(spark: SparkSession, label: str) -> str:
    """The address of a folder of its own in the shared one, deleted as written tables are."""
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _made(spark, path, None)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, and gives the
    planner its true size, so that a join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` written in buckets of ``key`` without a shuffle, a file for each bucket that a task has rows of: for few large
    rows, which joins by ``key`` then read where they are."""
    spark = df.sparkSession
    name = f"tidemark_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    _made(spark, path, name)
    return spark.table(name)


#: Bytes of stored input in a part, whose words a task sorts in memory; the most parts.
PART_BYTES, MOST_PARTS = 1 << 20, 10000


#: Bytes of stored input in a slice; the most slices, as each reads the input.
SLICE_BYTES, MOST_SLICES = 1 << 27, 16


def _stored_bytes(df: DataFrame) -> int | None:
    """A table's size as the planner knows it; none if it doesn't."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return None if size >> 60 else size


def parts_of(df: DataFrame, slices: int = 1) -> int:
    """Into how many parts to deal out a table, or one of its slices, that grows many times over in its tasks: by its size as
    the planner knows it, and no fewer than shuffles have, so that joins needn't deal it out again."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = _stored_bytes(df)
    return least if size is None else max(least, min(MOST_PARTS, -(-size // (PART_BYTES * slices))))


def in_slices(df: DataFrame, label: str, work: Callable[[Callable[..., DataFrame], int], DataFrame], growth: int = 1) -> DataFrame:
    """What ``work(own, slices)`` makes of all recordings, of a slice of them after another: what it writes and shuffles of
    a slice is deleted before the next one, and only results stay. ``df``, the table that they come from, decides by its
    size how many slices there are, of less where the work makes it grow; of one, nothing is written. ``own(df,
    key="rec_id")`` leaves a table's rows of the slice, so every recording is in one slice, with all its rows of every table."""
    spark, size = df.sparkSession, _stored_bytes(df)
    slices = 1 if size is None else max(1, min(MOST_SLICES, -(-size * growth // SLICE_BYTES)))
    if slices == 1:
        return work(lambda df, key="rec_id": df, 1)
    path = new_folder(spark, label)
    for k in range(slices):
        with scope(), _shuffles_deleted(spark):
            out = work(lambda df, key="rec_id", k=k: df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slices)) == k), slices)
            out.write.mode("append").options(**COMPACT).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, True)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Times and numbers that rise become small differences.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2"}


def by_recording(df: DataFrame, label: str, *order: str, key: str = "rec_id", dealt: int | None = None) -> DataFrame:
    """``df`` written once in buckets of ``key``, sorted by it and ``order``: windows, groups and joins by recording that
    follow, however many, read it without another shuffle. ``dealt``: its rows are in so many partitions by ``key``
    already, so that each bucket's are with one task as they are.

    Joins by ``key`` and more columns read it where it is, too: the session no longer asks that a join's sides are dealt
    out by all columns that it compares. It takes the order of a bucket that is one file as it is, too, without
    sorting it again for each window."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", False)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", True)
    name, buckets = f"tidemark_{label}_{uuid.uuid4().hex}", dealt or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    own = df if dealt else df.repartition(buckets, key)  # a file for each bucket
    own.write.bucketBy(buckets, key).sortBy(key, *order).options(path=path, **COMPACT).format("parquet").saveAsTable(name)
    _made(spark, path, name)
    return spark.table(name)
