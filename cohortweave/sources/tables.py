"""Tab-separated and Parquet tables, ingest caches, manifests and result bundles."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortweave.scratch import remove

MANIFEST = "id string, filename string, md5 string, size long, state string"
#: Bytes of a file that a task holds while it works out a checksum.
CHUNK = 1 << 22
#: Typed columns of the tables that reports read back, by what the table holds.
RESULTS = {
    "regulon": "source_genesymbol string, target_genesymbol string, consensus_stimulation string, consensus_inhibition string, mor double",
    "cis": "gene string, rho double, p double, padj double, n long",
    "de": "gene string, log2FC double, padj double, AveExpr double, t double",
    "dmr": "gene string, region string, delta_beta double, padj double, probe string",
    "grid": "seeds string, network string, k_hops int, rho_conf double, sign_acc_conf double, p double",
}


def read_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A tab-separated result table with typed columns, found by name in its header; columns that the file lacks are NULL, NA is NULL."""
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    wanted = [x.split() for x in RESULTS[kind].split(", ")]
    return raw.select(*[(F.col(f"`{n}`") if n in raw.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def ingest_sample_counts(spark: SparkSession, paths: str | list[str], manifest: DataFrame, gene: str = "gene_id", count: str = "unstranded") -> DataFrame:
    """Long counts (gene_id, sample, count) of per-sample tables with a header; summary rows, which start with N_, and comment lines go."""
    raw = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(paths)
    rows = raw.select(F.col(gene).alias("gene_id"), F.col(count).cast("long").alias("count"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"))
    rows = rows.where(~F.col("gene_id").startswith("N_"))
    return rows.join(manifest.select(_last("filename").alias("filename"), F.col("id").alias("sample")), "filename").select("gene_id", "sample", "count")


def _last(path: str) -> Column:
    """The last part of a path; manifests name files with their folders."""
    return F.element_at(F.split(path, "/"), -1)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, quoting: bool = True) -> DataFrame:
    """A tab-separated table with a header. Without a schema all columns are strings; quoting off takes quotes as text."""
    reader = spark.read.option("sep", "\t").option("header", True)
    reader = reader if quoting else reader.option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", quoting: bool = True, na: str = "") -> None:
    """A tab-separated table with a header, NULL written as `na`. Quoting off writes quotes as text."""
    writer = df.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", na)
    (writer if quoting else writer.option("quote", "")).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, path: str, ingest: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; made by ingest() first if its write has not finished there before."""
    if not exists(spark, f"{path}/_SUCCESS"):
        ingest().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Download manifest: id, filename, md5, size, state."""
    return read_tsv(spark, path, MANIFEST)


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(id, filename, size, found_size, found_md5, fault) of every file that a manifest lists, read from a folder.

    fault is missing, short (another size than listed), altered (another checksum) or null. Sizes come from the listing of the folder, without
    reading; a file of the listed size is read in tasks, chunk by chunk in order, so a file of any size takes bounded memory. A size or
    checksum that the manifest does not list is not compared.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("at"), F.col("length").alias("found_size"))
    root = folder.rstrip("/") + "/"
    root = root if "://" in root or root.startswith("file:") else "file:" + root
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    named = manifest.select("id", "filename", "size", F.lower("md5").alias("md5"), plain(F.concat(F.lit(root), F.col("filename"))).alias("at"))
    rows = named.join(found.select(plain(F.col("at")).alias("at"), "found_size"), "at", "left")
    fault = F.when(F.col("found_size").isNull(), "missing").when(F.col("found_size") != F.col("size"), "short")
    rows = rows.withColumn("fault", fault)

    def digests(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri, wanted, fault in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("at", "md5", "fault"))):
                if fault is not None or not wanted:
                    out.append(None)
                    continue
                system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else uri)
                digest = hashlib.md5()
                with system.open_input_stream(path) as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "found_md5"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", found_md5 string"
    read = rows.repartition("at").mapInArrow(digests, schema)
    altered = F.col("found_md5").isNotNull() & (F.col("found_md5") != F.col("md5"))
    return read.select("id", "filename", "size", "found_size", "found_md5", F.when(altered, "altered").otherwise(F.col("fault")).alias("fault"))


def verified(spark: SparkSession, folder: str, manifest: DataFrame, named: int = 5) -> list[str]:
    """The paths of a manifest's files, if all are there as listed; else an error that counts the faults and names a few."""
    faults = verify_manifest(spark, folder, manifest).where("fault is not null")
    counts = {r["fault"]: r["n"] for r in faults.groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        some = ", ".join(f"{r['filename']} ({r['fault']})" for r in faults.orderBy("filename").limit(named).collect())
        raise ValueError(f"{sum(counts.values())} files are not as the manifest lists them, {counts}: {some}")
    return [f"{folder.rstrip('/')}/{r['filename']}" for r in manifest.select("filename").collect()]


def read_sample_files(spark: SparkSession, paths: str | list[str], manifest: DataFrame, columns: str = "probe string, beta double") -> DataFrame:
    """One header-less file per sample, in long form with the manifest's id of its file as `sample`."""
    rows = spark.read.option("sep", "\t").schema(columns).csv(paths)
    rows = rows.withColumn("filename", _last(F.input_file_name()))
    return rows.join(manifest.select(_last("filename").alias("filename"), F.col("id").alias("sample")), "filename").drop("filename")


def ingest_samples(spark: SparkSession, folder: str, manifest: DataFrame, columns: str = "probe string, beta double") -> DataFrame:
    """read_sample_files of all files of a manifest, once they are verified."""
    return read_sample_files(spark, verified(spark, folder, manifest), manifest, columns)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Number and state of the versions under a bundle's path, ascending; a version is complete once its mark is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    names = {x.getPath().getName() for x in system.listStatus(at)}
    return sorted((int(n[1:]), f"{n}.complete" in names) for n in names if n[:1] == "v" and n[1:].isdigit())


def write_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], params: dict, keep: int = 2) -> int:
    """A result of several tables and its parameters, as a new version; its number.

    Tables go to a folder of their own, and the version counts once a mark beside it is created, which is one step that happens or does not.
    Readers see the last complete version, whole, also while a later one is written or after its writer has died. The last `keep`
    complete versions stay, and what is older goes.
    """
    before = _versions(spark, path)
    number = max((n for n, _ in before), default=0) + 1
    at = f"{path}/v{number}"
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}")
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.text(f"{at}/params")
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number}.complete")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(mark):
        raise RuntimeError(f"another writer has completed version {number} of {path}")
    complete = [n for n, done in before if done]
    oldest = ([*complete, number])[-keep:][0]
    for n, _ in before:
        if n < oldest:
            remove(spark, f"{path}/v{n}.complete")
            remove(spark, f"{path}/v{n}")
    return number


def read_bundle(spark: SparkSession, path: str, names: list[str], version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables and parameters of the last complete version, or of a given one."""
    complete = [n for n, done in _versions(spark, path) if done]
    if not complete or version is not None and version not in complete:
        raise FileNotFoundError(f"no complete version {'' if version is None else version} of a bundle at {path}")
    at = f"{path}/v{complete[-1] if version is None else version}"
    params = json.loads(spark.read.text(f"{at}/params").first()["value"])
    return {n: spark.read.parquet(f"{at}/{n}") for n in names}, params
