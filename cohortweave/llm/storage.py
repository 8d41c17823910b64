"""Shared folders for tables and binary files, and joins that a hot key cannot stall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.scratch import Scope, cut, remove, shared_dir

__all__ = ["Scope", "cut", "join_salted", "open_fs", "ranges", "remove", "shared_dir", "small_side"]
SALTS = 32
#: Rows of a few numbers each that a broadcast may have.
SMALL = 300_000


def open_fs(uri: str):
    """(file system, path) of pyarrow for a shared URI; used inside tasks for binary files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ranges(spark: SparkSession, files: list[tuple], fields: str, step: int) -> DataFrame:
    """A row for every `step` units of each file, with start and end, dealt over tasks; files need a column size.

    The driver lists files alone, one row each; their ranges are made in tasks, at most 64 to a task beyond 4096 tasks.
    """
    rows = spark.createDataFrame(files, fields).where("size > 0")
    out = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))).withColumn("end", F.least(F.col("start") + step, F.col("size")))
    at = [x.split()[0] for x in fields.split(",")].index("size")
    n = sum(-(-f[at] // step) for f in files)
    return out.repartition(max(1, min(n, max(4096, -(-n // 64)))))


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame | None:
    """df marked for broadcast if it has at most so many rows, else None; count a cut table, since this counts it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def join_salted(rows: DataFrame, small: DataFrame, keys: list[str], by: str | list[str], how: str = "left") -> DataFrame:
    """rows joined to small on keys, where one key may hold a third of all rows and small has each key once.

    Up to SMALL rows, small is broadcast. Beyond, rows of a key are dealt over SALTS partitions by the hash
    of the columns `by`, and small is repeated for each.
    """
    held = small_side(small)
    if held is not None:
        return rows.join(held, keys, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
