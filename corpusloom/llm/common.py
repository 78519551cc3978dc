"""What the training-data operators share: tables, shared storage and document keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
#: Tables stored by each application, in their order.
_STORED: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (local tests) a temporary folder of the machine takes its place.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, local_path(base), ignore_errors=True)
        elif "://" not in base and not base.startswith("file:"):
            base = f"file://{base}" if base.startswith("/") and spark.sparkContext.master.startswith("local") else base
        _ROOTS[app] = f"{base.rstrip('/')}/{app}"
    return _ROOTS[app]


def local_path(uri: str) -> str:
    """The path of a file: address."""
    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri


def release(spark: SparkSession) -> None:
    """Deletes what this application has stored below spark.checkpoint.dir. For the end of a job: results that were not written elsewhere go too."""
    _STORED.pop(spark.sparkContext.applicationId, None)
    if root := _ROOTS.pop(spark.sparkContext.applicationId, None):
        _delete(spark, root)


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_so_far(spark: SparkSession) -> int:
    return len(_STORED.get(spark.sparkContext.applicationId, []))


def drop_between(spark: SparkSession, first: int, last: int) -> None:
    """Deletes the tables that were stored from the ``first`` to before the ``last``; nothing may read them any more."""
    for path in _STORED.get(spark.sparkContext.applicationId, [])[first:last]:
        _delete(spark, path)


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written once to shared storage and read from there.

    A lost executor costs nothing that was written; lineage ends here.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    _STORED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, *names: str) -> DataFrame:
    """df with none of the named columns, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in low))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_small() -> None:
    """Lets a worker's allocator keep what arrays under 4 MB give back, up to 64 MB, for the next ones.

    Arrays of about a megabyte are made and dropped in every step; by default each takes fresh pages from the machine.
    """
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def hand_back() -> None:
    """Gives a worker's freed memory back to the machine, as workers live on after a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def executor_cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
