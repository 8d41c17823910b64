"""The order and event tables in the roles of assay, annotation, interaction and prize tables.

Each role is a DataFrame and, under the same name, a SQL definition with the same rows. Averages are rounded to nine
decimals before any threshold or rank, since many of them lie on one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sides(value: str):
    side = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col(value)))
    return side("O"), side("F")


def de(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, f = _sides("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.round(F.log2(o / f), 9).alias("log2FC"), F.round(F.avg("l_tax"), 9).alias("padj"))


def dmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, f = _sides("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("region")).agg(F.round(o - f, 9).alias("delta_beta"), F.round(F.avg("l_tax"), 9).alias("padj"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user and the next one within the hour: raw directed records with flags as strings."""
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("s"), F.lead("user_id").over(w).alias("t"), (F.col("event_type") == "error").alias("bad")).where("t is not null")
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    flag = lambda c: F.when(c, "True").otherwise("False")
    return pairs.groupBy(name("s").alias("source"), name("t").alias("target")).agg(
        F.count(F.lit(1)).alias("confidence"), F.lit("True").alias("is_directed"),
        flag(F.count_if(~F.col("bad")) > 0).alias("is_stimulation"), flag(F.count_if("bad") > 0).alias("is_inhibition"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user as a node: mean value, errors and clicks."""
    return table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node")).agg(
        F.round(F.avg("value"), 9).alias("value"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count(F.lit(1)).alias("n")
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir).where("errors > clicks")
    return u.select("node", F.round((F.col("clicks") - F.col("errors")) / (F.col("clicks") + F.col("errors")), 9).alias("state"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select("node", "value", (F.col("errors") > 0).alias("sig"))


def prizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prize per user node: how far its share of errors lies above a tenth."""
    return users(spark, sf_dir).select("node", F.greatest(F.lit(0.0), F.round(F.col("errors") / F.col("n") - 0.1, 9)).alias("prize"))


SQL = {
    "de": """de AS (SELECT l_partkey AS gene, round(log2(avg(CASE WHEN l_linestatus='O' THEN l_extendedprice END)/avg(CASE WHEN l_linestatus='F' THEN l_extendedprice END)),9) AS log2FC, round(avg(l_tax),9) AS padj FROM lineitem GROUP BY 1)""",
    "dmr": """dmr AS (SELECT l_partkey AS gene, l_returnflag AS region, round(avg(CASE WHEN l_linestatus='O' THEN l_discount END)-avg(CASE WHEN l_linestatus='F' THEN l_discount END),9) AS delta_beta, round(avg(l_tax),9) AS padj FROM lineitem GROUP BY 1,2)""",
    "interactions": """pairs AS (SELECT user_id AS s, lead(user_id) OVER (PARTITION BY date_trunc('hour',ts) ORDER BY ts,event_id) AS t, event_type='error' AS bad FROM events),
raw AS (SELECT 'u'||s AS source, 'u'||t AS target, count(*) AS confidence, 'True' AS is_directed, CASE WHEN count(*) FILTER (NOT bad)>0 THEN 'True' ELSE 'False' END AS is_stimulation, CASE WHEN count(*) FILTER (bad)>0 THEN 'True' ELSE 'False' END AS is_inhibition FROM pairs WHERE t IS NOT NULL GROUP BY s,t)""",
    "users": """users AS (SELECT 'u'||user_id AS node, round(avg(value),9) AS value, count(*) FILTER (event_type='error') AS errors, count(*) FILTER (event_type='click') AS clicks, count(*) AS n FROM events GROUP BY user_id)""",
    "seeds": """seeds AS (SELECT node, round((clicks-errors)::DOUBLE/(clicks+errors),9) AS state FROM users WHERE errors>clicks)""",
    "prizes": """prizes AS (SELECT node, greatest(0.0::DOUBLE, round(errors::DOUBLE/n - 0.1::DOUBLE,9)) AS prize FROM users)""",
    "costs": """clean AS (SELECT * FROM raw WHERE source<>target),
ranked AS (SELECT *, (rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence)-1)/2.0::DOUBLE)/count(*) OVER () AS conf FROM clean),
costed AS (SELECT *, greatest(0.05::DOUBLE, least(1.0::DOUBLE, 1-conf)) AS cost FROM ranked),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(source,target), greatest(source,target) ORDER BY cost, source, target) AS k FROM costed) WHERE k=1)""",
    "matrix": """signed AS (SELECT source, target, confidence, CASE WHEN is_stimulation='True' AND is_inhibition<>'True' THEN 1 WHEN is_inhibition='True' AND is_stimulation<>'True' THEN -1 ELSE 0 END AS sign FROM raw WHERE source<>target),
m AS (SELECT source, target, sum(sign*confidence::DOUBLE) AS w FROM signed WHERE sign<>0 GROUP BY 1,2 HAVING sum(sign*confidence::DOUBLE)<>0),
w AS (SELECT source, target, w/sum(abs(w)) OVER (PARTITION BY target) AS w FROM m)""",
    "hops": """h1 AS (SELECT target AS node, 0.5::DOUBLE*sum(w*state) AS state FROM seeds JOIN w ON node=source GROUP BY 1),
h2 AS (SELECT target AS node, 0.5::DOUBLE*sum(w*state) AS state FROM h1 JOIN w ON node=source GROUP BY 1),
h3 AS (SELECT target AS node, 0.5::DOUBLE*sum(w*state) AS state FROM h2 JOIN w ON node=source GROUP BY 1),
h4 AS (SELECT target AS node, 0.5::DOUBLE*sum(w*state) AS state FROM h3 JOIN w ON node=source GROUP BY 1),
pred AS (SELECT node, sum(state) AS state FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) GROUP BY 1)""",
    "expr": """expr0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY abs(log2FC) DESC, padj, log2FC) AS k FROM de WHERE log2FC IS NOT NULL AND padj<=0.05 AND abs(log2FC)>=0.1) WHERE k=1),
expr AS (SELECT gene, (rank() OVER (ORDER BY abs(log2FC)) + (count(*) OVER (PARTITION BY abs(log2FC))-1)/2.0::DOUBLE)/count(*) OVER () AS expr_score, sign(log2FC)::DOUBLE AS expr_direction FROM expr0)""",
    "meth": """m0 AS (SELECT *, CASE WHEN region='R' THEN 'prom' ELSE 'body' END AS ctx FROM dmr WHERE delta_beta IS NOT NULL AND padj<=0.05 AND abs(delta_beta)>=0.01),
m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene,ctx ORDER BY abs(delta_beta) DESC, padj, region, delta_beta) AS k FROM m0) WHERE k=1),
m2 AS (SELECT *, (rank() OVER (PARTITION BY ctx ORDER BY abs(delta_beta)) + (count(*) OVER (PARTITION BY ctx,abs(delta_beta))-1)/2.0::DOUBLE)/count(*) OVER (PARTITION BY ctx) AS s FROM m1),
meth AS (SELECT gene, max(CASE WHEN ctx='prom' THEN s END) AS prom_score, max(CASE WHEN ctx='prom' THEN sign(delta_beta) END)::DOUBLE AS prom_direction, max(CASE WHEN ctx='body' THEN s END) AS body_score, max(CASE WHEN ctx='body' THEN sign(delta_beta) END)::DOUBLE AS body_direction FROM m2 GROUP BY gene)""",
    "prize_table": """joined AS (SELECT coalesce(e.gene,m.gene) AS gene, expr_score, expr_direction, prom_score, prom_direction, body_score, body_direction FROM expr e FULL JOIN meth m ON e.gene=m.gene),
conc AS (SELECT *, CASE WHEN coalesce(prom_direction,0)*coalesce(expr_direction,0)<0 THEN sqrt(prom_score*expr_score) ELSE 0 END + 0.5::DOUBLE*CASE WHEN coalesce(body_direction,0)*coalesce(expr_direction,0)>0 THEN sqrt(body_score*expr_score) ELSE 0 END AS concordance FROM joined),
prized AS (SELECT *, coalesce(expr_score,0)+coalesce(prom_score,0)+0.4::DOUBLE*coalesce(body_score,0)+1.5::DOUBLE*concordance AS prize FROM conc)""",
}


def sql(*parts: str, select: str) -> str:
    """A statement over the named role definitions."""
    return ("WITH " + ",\n".join(SQL[p] if p in SQL else p for p in parts) + "\n" if parts else "") + select
