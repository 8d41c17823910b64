"""Shared scratch folders, cut points for lineage, and scopes that delete what a job has used up."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_current: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """Tables that cut() writes within `with Scope() as scope` are deleted at its end, but for those given to keep().

    A kept table belongs to the enclosing scope, if there is one. What the block returns may read kept tables only.
    """

    def __enter__(self) -> Scope:
        self.made: list[tuple[DataFrame, str]] = []
        self.kept: list[DataFrame] = []
        self._token = _current.set(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more before the block ends."""
        gone = [x for x in self.made if any(x[0] is t for t in tables)]
        self.made = [x for x in self.made if not any(x is g for g in gone)]
        for df, path in gone:
            remove(df.sparkSession, path)

    def __exit__(self, *error) -> None:
        _current.reset(self._token)
        outer = _current.get()
        if outer is not None and error[0] is None:
            outer.made += [x for x in self.made if any(x[0] is k for k in self.kept)]
        self.free(*[df for df, _ in self.made if error[0] is not None or not any(df is k for k in self.kept)])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its URI names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, the folder that driver and executors share.

    Where that is unset, a local master gets a temporary folder; a cluster has no
    safe default, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/cohortweave-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to a shared Parquet folder and read it back: the plan restarts from that table."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if (scope := _current.get()) is not None:
        scope.made.append((out, path))
    return out


#: Rows of a partition of dealt().
DEALT = 500_000


def dealt(df: DataFrame, *keys: str, rows: int = DEALT) -> DataFrame:
    """df dealt out by keys into so many partitions that each has about so many rows; none are merged again by their compressed size."""
    return df.repartition(max(1, math.ceil(df.count() / rows)), *keys)


def cut_counted(df: DataFrame, name: str, mark: tuple[str, ...] = ()) -> tuple[DataFrame, int, object]:
    """cut, with the number of rows and a sum of hashes of the mark columns, observed while the table is written."""
    seen = Observation()
    hashes = F.sum(F.xxhash64(*mark).cast("decimal(38,0)")) if mark else F.lit(None)
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("h")) if mark else df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"], seen.get.get("h")
