"""Where intermediate results are written so that a lost executor costs no recomputation."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

#: Codec of tables that are written to be read again by the same job.
CODEC = "zstd"
#: Folders named so far within :func:`passing`, by thread. A plain dict, since task functions are pickled with what they name.
_named: dict[int, list[str] | None] = {}

#: Folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; only a local session may do without."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="clauseloom-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder nobody has written yet, so a retried job never overwrites what it reads."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (named := _named.get(get_ident())) is not None:
        named.append(path)
    return path


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where several outputs come from one costly input, and between the steps of a loop.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("error").option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete_folder(folder: str) -> bool:
    """Delete a folder that nothing reads any more; one that cannot be reached from here, or is gone, stays as it is."""
    from pyarrow import fs

    try:
        store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.delete_dir(path)
    except (OSError, ValueError) as why:
        logging.getLogger(__name__).warning("%s stays: %s", folder, why)
        return False
    return True


def discard(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once everything made from it has been written itself.

    A folder that cannot be reached from here stays; it does no harm but for its size.
    """
    for df in staged:
        delete_folder(df.staged_at)


@contextmanager
def _naming(into: list[str] | None) -> Iterator[None]:
    """The folders that this thread names inside go to ``into``."""
    me = get_ident()
    outer = _named.get(me)
    _named[me] = into
    try:
        yield
    finally:
        if outer is None:
            _named.pop(me, None)
        else:
            _named[me] = outer


@contextmanager
def passing() -> Iterator[None]:
    """Folders that :func:`fresh_path` names inside are deleted at the end, so nothing read later may come from them. After an
    error they stay."""
    named: list[str] = []
    with _naming(named):
        yield
    for folder in named:
        delete_folder(folder)


def settled(make: Callable[[], Sequence[DataFrame]], name: str) -> list[DataFrame]:
    """The frames that ``make`` returns, staged. What it staged itself on the way is deleted."""
    outer = _named.get(get_ident())
    with passing():
        frames = make()
        with _naming(outer):
            return [stage(df, name) for df in frames]
