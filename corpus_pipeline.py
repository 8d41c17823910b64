"""A corpus pipeline of five stages: quality, near duplicates, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads it back from Parquet. All
but the last return the columns of docs. STAGES can be run one by one; run() runs them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.llm.bpe import bpe_round_trip
from cohortweave.llm.jaccard_join import jaccard_components
from cohortweave.llm.mixing import mixed_documents
from cohortweave.llm.pii import redact_documents
from cohortweave.llm.quality_classifier import keep_quality
from cohortweave.llm.storage import Scope, cut, small_side
from cohortweave.llm.tokens import tokenizer_path

#: The stages cannot be put in SQL; tests/llm/test_brute_force.py holds run() against plain versions of all five.
ORACLE_SQL = None

#: Documents in an Arrow batch: texts are long, and a batch is in memory several times over, in the JVM and beside it.
BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bounded(spark: SparkSession) -> str:
    """Bound Arrow batches of the session to BATCH rows, if they are larger; gives the setting before.

    A stage is run after it returns, so a single stage leaves the session so; run() puts the setting back.
    """
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(_BATCH, str(BATCH))
    return before


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the rest stay as they are.

    Null and empty texts are judged by their zero statistics, rows with a null doc_id and repeated rows one by one; texts
    of any length are read whole; an empty table stays empty; without a usable label nothing goes. Other columns are kept.
    """
    _bounded(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; a null doc_id is in no group and stays.

    Null texts, empty ones and those without words link with nothing and stay. Where rows share a doc_id, each goes by
    its own text: it is in the groups that this text is linked to, and rows of the same doc_id and text are one. Of rows
    that are linked and share a doc_id, the one with the smallest hash stays. An empty table stays empty, texts of any length
    are compared whole, and other columns are kept, whatever their names.
    """
    _bounded(spark)
    known, columns = docs.where("doc_id is not null"), [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    with Scope() as scope:
        if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            found = jaccard_components(docs)
            gone = scope.keep(cut(found.where("doc_id <> component_id").select("doc_id"), "pipeline-gone"))
            return docs.join(gone if (held := small_side(gone)) is None else held, "doc_id", "left_anti").select(columns)
        # a row travels as one struct, so that its columns may have any names
        rows = scope.keep(cut(known.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("id")), "pipeline-rows"))
        found = jaccard_components(rows.select(F.col("id").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("id"), "n_shingles", "component_id")
        empty = F.col("n_shingles") == 0
        own = rows.select("id", F.struct(F.col("row.doc_id").cast("long"), F.xxhash64("row.*"), "id").alias("first"), F.col("row.doc_id").alias("doc_id"), F.coalesce(F.sha2("row.text", 256), F.lit("")).alias("digest"))
        group = own.join(found, "id").groupBy(F.when(~empty, F.col("component_id")), F.when(empty, F.col("doc_id")), F.when(empty, F.col("digest")))
        stay = scope.keep(cut(group.agg(F.min("first").alias("first")).select(F.col("first.id").alias("id")), "pipeline-stay"))
    return rows.join(stay, "id", "left_semi").select("row.*").unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data, by pattern or field, are replaced by their kind in brackets; n_chars follows.

    Each row is read by itself and whole: null texts stay null, empty ones empty, repeated rows equal, an empty table empty;
    a null doc_id and other columns stay as they are.
    """
    _bounded(spark)
    return redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it.

    A null or empty text has size 0, a null source is a source of its own, a null doc_id is a document like others; repeated
    rows share what the mix takes of them; an empty table stays empty; other columns are kept, whatever their names.
    """
    _bounded(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what the mix holds: doc_id, n_tokens and the digests of ids and decoded text, a row for each row.

    A null text counts as an empty one, with no ids; a null doc_id stays null; repeated rows give repeated rows, an empty
    table none; texts of any length are encoded whole; other columns are left out.
    """
    _bounded(spark)
    return bpe_round_trip(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing", mix),
    ("BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; a stage's table is deleted when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), _bounded(spark)
    try:
        with Scope() as scope:
            for name, stage in STAGES:
                last, docs = docs, cut(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
                scope.free(last)
            return scope.keep(docs)
    finally:
        spark.conf.set(_BATCH, before)
