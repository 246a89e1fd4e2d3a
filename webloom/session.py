"""Session helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times bytes up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may lack the setting; it gets a folder of its own
    there. A cluster without the setting is an error, as a machine-local folder
    would be lost with its machine.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_webloom_dir", None)
    if not found:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = sc._webloom_dir = "file://" + tempfile.mkdtemp(prefix="webloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system it is on."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, on whatever file system it is on, is there as a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(p) and files.getFileStatus(p).isDirectory()


#: Tables that ``cut`` wrote and that are still there.
_WRITTEN: dict[str, SparkSession] = {}


def _forget(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        remove_path(spark, path)


def cut(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and keeps column pruning,
    which ``checkpoint()`` would not. The folder goes when a ``scratch`` block around the
    call ends, else when the interpreter does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN[path] = spark
    atexit.register(_forget, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes inside go at the end, but those given to the function that this yields."""
    before, kept = set(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_read_by(df))
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in kept]:
            _forget(path)


def discard(df: DataFrame) -> None:
    """Remove the table that ``cut`` returned; nothing may read it any more."""
    for path in _read_by(df):
        _forget(path)


def _read_by(df: DataFrame) -> list[str]:
    """The tables of ``cut`` that ``df`` reads."""
    folders = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    return [p for p in _WRITTEN if p.rpartition("/")[2] in folders]


def input_bytes(df: DataFrame) -> int:
    """The planner's size of ``df`` in bytes: of the files that a scan reads, without a job; 0 if it has none."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 0 if found >= 1 << 60 else found


def partitions_for(df: DataFrame, each: int = 128 << 20) -> int:
    """Shuffle partitions of about ``each`` bytes; those of the session at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // each))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_enough(df: DataFrame, row_bytes: int, limit: int | None = None) -> bool:
    """Whether ``df`` (cheap to count: a written table or an aggregate) may be broadcast."""
    limit = BROADCAST_BYTES if limit is None else limit
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it was measured to be small; else as it is."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df.hint("shuffle_merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
