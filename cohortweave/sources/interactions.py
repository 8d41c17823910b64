"""Interaction records from a web service or its saved answer: checked parameters, error pages, derived columns."""

from __future__ import annotations

import hashlib
import urllib.parse
import urllib.request
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.functions.scalars import distinct_fields, has_column
from cohortweave.operators.network import cost_graph
from cohortweave.scratch import cut
from cohortweave.sources.tables import cached, read_tsv, write_tsv

# What the service accepts.
FIELDS = (
    "curation_effort", "databases", "datasets", "dorothea_level",
    "dorothea_methods", "entity_type", "evidences", "extra_attrs",
    "ncbi_tax_id", "ncbi_tax_id_source", "ncbi_tax_id_target",
    "organism", "references", "resources", "sources", "type",
)
DATASETS = (
    "collectri", "dorothea", "kinaseextra", "ligrecextra", "lncrna_mrna",
    "mirnatarget", "omnipath", "pathwayextra", "small_molecule", "tf_mirna",
    "tf_target",
)
TAXA = (9606, 10090, 10116)
SOURCE, TARGET = "source_genesymbol", "target_genesymbol"


def request_url(base: str, datasets: list[str], organism: int = 9606, fields: list[str] | None = None, license: str = "academic") -> str:
    """The query URL; raises for unknown datasets or fields, warns for taxa that the service does not serve itself."""
    if isinstance(organism, bool) or not isinstance(organism, (int, float)):
        raise TypeError("organism must be a number")
    fields = ["curation_effort", "sources", "references"] if fields is None else fields
    for what, given, allowed in (("fields", fields, FIELDS), ("datasets", datasets, DATASETS)):
        unknown = [x for x in given if x not in allowed]
        if unknown:
            raise ValueError(f"unknown {what}: {', '.join(unknown)}; allowed: {', '.join(allowed)}")
    if int(organism) not in TAXA:
        warnings.warn(f"taxon {int(organism)} is translated by orthology or refused", stacklevel=2)
    query = {"genesymbols": "yes", "datasets": ",".join(datasets), "organisms": int(organism), "fields": ",".join(fields), "license": license}
    return f"{base}?{urllib.parse.urlencode(query, safe=',')}"


def checked(df: DataFrame) -> DataFrame:
    """df itself; an error if it is an error page, which has two columns or fewer, or no source symbol."""
    if len(df.columns) <= 2 or not has_column(df, SOURCE):
        raise ValueError(f"the service answered with an error page, beginning {df.columns[:3]}")
    return df


def with_counts(df: DataFrame) -> DataFrame:
    """Add n_references and n_resources, the distinct entries of the packed columns, where these exist."""
    for packed, name in (("references", "n_references"), ("sources", "n_resources")):
        if has_column(df, packed):
            df = df.withColumn(name, distinct_fields(packed))
    return df


def _answer(spark: SparkSession, url: str) -> DataFrame:
    """(line, fields) of the service's answer, asked for in one task as it has no pages, and handed on some lines at a time."""

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for at in batch.column(0).to_pylist():
                held, line = [], 0
                with urllib.request.urlopen(at) as f:
                    for raw in f:
                        held.append((line, raw.decode().rstrip("\r\n").split("\t")))
                        line += 1
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_pydict({"line": [x for x, _ in held], "fields": [y for _, y in held]})
                            held = []
                yield pa.RecordBatch.from_pydict({"line": pa.array([x for x, _ in held], pa.int64()), "fields": pa.array([y for _, y in held], pa.list_(pa.string()))})

    return spark.createDataFrame([(url,)], "url string").coalesce(1).mapInArrow(ask, "line long, fields array<string>")


def fetch(spark: SparkSession, url: str, save_to: str | None = None, landing: str | None = None) -> DataFrame:
    """Records of a query URL with derived counts; optionally also saved as a tab-separated table.

    The service is asked once: its answer lands in a table that every later action reads. With a landing folder the
    table is named after the URL's digest, and later calls for the same URL read it too; delete it to ask again.
    """
    if landing:
        lines = cached(spark, f"{landing.rstrip('/')}/{hashlib.sha256(url.encode()).hexdigest()}", lambda: _answer(spark, url))
    else:
        lines = cut(_answer(spark, url), "service-answer")
    head = lines.where("line = 0").first()
    names = [] if head is None else head["fields"]
    rows = lines.where("line > 0").select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])
    df = with_counts(checked(rows))
    if save_to:
        write_tsv(df, save_to)
    return df


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of a saved tab-separated table, quotes taken as text, with derived counts."""
    return with_counts(checked(read_tsv(spark, path, quoting=False)))


def interaction_graph(records: DataFrame, confidence: str = "curation_effort", **options) -> DataFrame:
    """Undirected cost network of the records."""
    return cost_graph(records, SOURCE, TARGET, confidence, **options)
