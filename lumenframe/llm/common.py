"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every contract: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def hex_sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent a local session (tests) gets one; a cluster must name its own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lumenframe-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def stash(df: DataFrame, *, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what stands
    above. The files go with ``discard``, or when the driver's process ends. Spark frees
    the shuffle files of the write once the driver's garbage is collected, which is
    asked for here: a job of many tables would hold all of them on the executors' disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _scopes:
        _scopes[-1].append(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


#: Paths of the tables stashed in each open ``scratch``, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stashed inside are removed at its end, but for those handed to the function
    that it gives: what a plan returned from here still reads. An operator thus holds no
    more disk than its result needs while the next one works."""
    made, held = [], []
    _scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        held.append(df._stashed_at)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        for path in made:
            if path not in held:
                _remove(spark, path)
        if _scopes:
            _scopes[-1].extend(held)


def discard(*tables: DataFrame) -> None:
    """Remove the files of stashed tables that no plan will read again."""
    for df in tables:
        _remove(df.sparkSession, df._stashed_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has gone; its owner clears the folder
        pass
