"""The registered queries of the library with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from cohortweave.functions import ranks, scalars
from cohortweave.functions.draws import draw_key_sql, permuted_sql
from cohortweave.functions.smooth import local_regression, local_regression_sql
from cohortweave.operators import diff, evidence, network, propagation, regulon, solver, summaries
from cohortweave.operators.components import connected_components
from cohortweave.plans import roles
from cohortweave.plans.forest_sql import forest_sql
from cohortweave.plans.roles import sql, table
from cohortweave.scratch import Scope, cut, dealt, shared_dir
from cohortweave.sources import tables as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few decimals, and no negative zero."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(*names: str) -> str:
    return ", ".join(f"round({n},6)+0.0::DOUBLE AS {n}" for n in names)


def _expr(spark, sf_dir):
    return evidence.expression_scores(roles.de(spark, sf_dir), effect_cutoff=0.1)


def _meth(spark, sf_dir):
    return evidence.methylation_scores(roles.dmr(spark, sf_dir), min_delta=0.01, promoter=("R",), body=("A", "N"))


def _prizes(spark, sf_dir):
    return evidence.build_prizes(_expr(spark, sf_dir), _meth(spark, sf_dir))


def _edges(spark, sf_dir):
    return network.cost_graph(roles.interactions(spark, sf_dir))


def _matrix(spark, sf_dir):
    return propagation.signed_matrix(network.signed_edges(roles.interactions(spark, sf_dir)), weight="confidence")


# ranks and windows


@query("SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal)-1)/2.0::DOUBLE)/count(*) OVER (),6)+0.0::DOUBLE AS score FROM customer")
def rank_normalise(spark, sf_dir):
    return ranks.rank_normalise(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "score")


@query("SELECT s_suppkey, greatest(1, ceil(10*(row_number() OVER (ORDER BY s_acctbal, s_suppkey)-1)::DOUBLE/(count(*) OVER ()-1)))::INTEGER AS bin FROM supplier")
def degree_rank_bins(spark, sf_dir):
    return ranks.rank_bins(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "bin")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size/51.0::DOUBLE AS p FROM part),
k AS (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY p) AS upto FROM p)
SELECT p_partkey, round(least(1.0::DOUBLE, min(p*n/upto) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),6)+0.0::DOUBLE AS padj FROM k""")
def bh_adjust(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(51.0)).alias("p"))
    return ranks.bh_adjust(parts, "p").select("p_partkey", "padj")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size/51.0::DOUBLE AS p FROM part),
k AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, count(*) OVER (PARTITION BY p_brand ORDER BY p) AS upto FROM p)
SELECT p_partkey, p_brand, round(least(1.0::DOUBLE, min(p*n/upto) OVER (PARTITION BY p_brand ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),6)+0.0::DOUBLE AS padj FROM k""")
def bh_adjust_by_group(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") / F.lit(51.0)).alias("p"))
    return ranks.bh_adjust(parts, "p", by=["p_brand"]).select("p_partkey", "p_brand", "padj")


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag,l_quantity)-1)/2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag,l_extendedprice)-1)/2.0::DOUBLE AS y FROM lineitem)
SELECT l_returnflag, round(corr(x,y),6)+0.0::DOUBLE AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman_by_group(spark, sf_dir):
    return ranks.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice)-1)/2.0::DOUBLE AS x, rank() OVER (ORDER BY o_custkey::DOUBLE) + (count(*) OVER (PARTITION BY o_custkey)-1)/2.0::DOUBLE AS y FROM orders)
SELECT round(corr(x,y),6)+0.0::DOUBLE AS rho, count(*) AS n FROM r""")
def spearman(spark, sf_dir):
    return ranks.spearman(table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey").cast("double")), "o_totalprice", "k")


@query("SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice,6)+0.0::DOUBLE AS l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM lineitem) WHERE nth<=14")
def top_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    out = regulon.top_per_group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], order, 14)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("nth").cast("long").alias("nth"))


# evidence


@query(sql("de", "expr", select=f"SELECT gene, {r6('expr_score', 'expr_direction')} FROM expr"))
def expression_scores(spark, sf_dir):
    return _expr(spark, sf_dir)


_METH = ("prom_score", "prom_direction", "body_score", "body_direction")


@query(sql("dmr", "meth", select=f"SELECT gene, {r6(*_METH)} FROM meth"))
def methylation_scores(spark, sf_dir):
    return _meth(spark, sf_dir)


_ALL = ("expr_score", "expr_direction", *_METH, "concordance", "prize")


@query(sql("de", "dmr", "expr", "meth", "prize_table", select=f"SELECT gene, {r6(*_ALL)} FROM prized"))
def concordance_prizes(spark, sf_dir):
    return _prizes(spark, sf_dir)


@query(sql("de", "dmr", "expr", "meth", "prize_table", select="SELECT gene, round(prize,6)+0.0::DOUBLE AS prize FROM prized WHERE prize>0 ORDER BY round(prize,9) DESC, gene LIMIT 20"))
def prize_vector_topk(spark, sf_dir):
    return evidence.prize_vector(_prizes(spark, sf_dir)).orderBy(F.round("prize", 9).desc(), "gene").limit(20)


@query(sql("de", "dmr", "expr", "meth", "prize_table", select="SELECT round(coalesce(quantile_cont(prize,0.9),1.0::DOUBLE),6)+0.0::DOUBLE AS omega FROM prized WHERE prize>0"))
def suggest_omega(spark, sf_dir):
    return network.suggest_omega(_prizes(spark, sf_dir))


@query("""WITH s AS (SELECT substr(c_name,1,12)||substr(c_mktsegment,1,1)||(c_nationkey%3+9)::VARCHAR AS b, c_custkey FROM customer)
SELECT substr(b,1,12) AS patient, substr(b,14,2) AS code, min(b) AS barcode, count(*) AS n FROM s GROUP BY 1,2""")
def sample_codes(spark, sf_dir):
    b = F.concat(F.substring("c_name", 1, 12), F.substring("c_mktsegment", 1, 1), (F.col("c_nationkey") % 3 + 9).cast("string"))
    s = table(spark, sf_dir, "customer").select(b.alias("b"))
    return s.groupBy(scalars.patient_of("b").alias("patient"), scalars.sample_type_of("b").alias("code")).agg(F.min("b").alias("barcode"), F.count(F.lit(1)).alias("n"))


_BARCODES = """b AS (SELECT DISTINCT lpad(c_custkey::VARCHAR,12,'P') || '-' || CASE o_orderstatus WHEN 'O' THEN '01' WHEN 'F' THEN '11' ELSE '06' END || substr(o_orderpriority,1,1) AS barcode FROM orders JOIN customer ON o_custkey=c_custkey)"""


def _barcodes(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    code = F.when(F.col("o_orderstatus") == "O", "01").when(F.col("o_orderstatus") == "F", "11").otherwise("06")
    return joined.select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, "P"), F.lit("-"), code, F.substring("o_orderpriority", 1, 1)).alias("barcode")).distinct()


@query(sql(_BARCODES, select="SELECT min(barcode) AS barcode FROM b GROUP BY substr(barcode,1,12), substr(barcode,14,2)"))
def dedup_aliquots(spark, sf_dir):
    return evidence.dedup_aliquots(_barcodes(spark, sf_dir))


@query(sql(_BARCODES, select="SELECT barcode, CASE substr(barcode,14,2) WHEN '01' THEN 'tumour' WHEN '11' THEN 'normal' ELSE 'other' END AS grp FROM b"))
def group_label(spark, sf_dir):
    return _barcodes(spark, sf_dir).select("barcode", scalars.sample_group("barcode").alias("grp"))


@query(sql(_BARCODES, select="SELECT substr(barcode,1,12) AS patient FROM b WHERE substr(barcode,14,2) IN ('01','11') GROUP BY 1 HAVING count(DISTINCT substr(barcode,14,2))=2"))
def complete_pairs(spark, sf_dir):
    return evidence.patients_with_both(_barcodes(spark, sf_dir))


@query(sql(_BARCODES, """x AS (SELECT *, right(barcode,1) IN ('1','2','3') AS e, right(barcode,1) IN ('3','4','5') AS m, substr(barcode,1,12) AS p, substr(barcode,14,2) AS c FROM b)""",
    """y AS (SELECT p, count(*) FILTER (e AND c='01') AS et, count(*) FILTER (e AND c='11') AS en, count(*) FILTER (m AND c='01') AS mt, count(*) FILTER (m AND c='11') AS mn FROM x GROUP BY p)""",
    select="SELECT sum(et)::BIGINT AS expr_tumour, sum(en)::BIGINT AS expr_normal, sum(mt)::BIGINT AS meth_tumour, sum(mn)::BIGINT AS meth_normal, count(*) FILTER (et>0 AND en>0) AS expr_pairs, count(*) FILTER (mt>0 AND mn>0) AS meth_pairs, count(*) FILTER (et>0 AND mt>0) AS both_tumour FROM y"))
def design_summary(spark, sf_dir):
    b = _barcodes(spark, sf_dir)
    last = F.substring("barcode", -1, 1)
    return evidence.summarise_design(b.where(last.isin("1", "2", "3")), b.where(last.isin("3", "4", "5")))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size=1) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>=50)")
def filter_probes_anti(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("probe"), "p_brand", "p_size")
    sex = parts.where("p_size = 1").select("p_brand").distinct()
    marked = parts.join(sex.withColumn("chr", F.lit("chrX")), "p_brand", "left")
    bad = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("probe"))
    return evidence.filter_probes(parts, marked, bad=bad).select(F.col("probe").alias("p_partkey"), "p_brand")


@query("SELECT DISTINCT l_orderkey AS probe, l_partkey::VARCHAR AS gene, l_returnflag AS region FROM lineitem")
def annotate_unpack(spark, sf_dir):
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("probe")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("g"), F.col("l_returnflag").alias("r")))).alias("x"))
    packed = rows.select("probe", F.array_join("x.g", ";").alias("genes"), F.array_join("x.r", ";").alias("regions"))
    return evidence.unpack_annotation(packed)


@query("SELECT l_partkey AS probe, round(avg(CASE WHEN l_linestatus='O' THEN l_quantity END)-avg(CASE WHEN l_linestatus='F' THEN l_quantity END),6)+0.0::DOUBLE AS delta FROM lineitem GROUP BY 1")
def delta_mean(spark, sf_dir):
    return diff.mean_difference(table(spark, sf_dir, "lineitem").withColumn("probe", F.col("l_partkey")), "probe", "l_quantity", "l_linestatus", "O", "F")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, least(greatest(l_discount,0.001::DOUBLE),0.999::DOUBLE) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(log2(b/(1-b)),6)+0.0::DOUBLE AS m FROM x")
def beta_to_m(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", scalars.m_value("l_discount").alias("m"))


@query(sql("dmr", select="SELECT gene, region, CASE WHEN padj<0.05 AND delta_beta>0.01 THEN 'hyper' WHEN padj<0.05 AND delta_beta<-0.01 THEN 'hypo' ELSE 'unchanged' END AS class FROM dmr"))
def methylation_class(spark, sf_dir):
    return roles.dmr(spark, sf_dir).select("gene", "region", scalars.change_class("delta_beta", "padj", least=0.01).alias("class"))


@query("SELECT doc_id, (SELECT count(DISTINCT x) FROM unnest(string_split(coalesce(text,''),' ')) t(x) WHERE x<>'')::INTEGER AS n_tokens FROM documents")
def distinct_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.distinct_fields("text", " ").alias("n_tokens"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*) FILTER (l_quantity>=49)=0")
def complete_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_partkey", "l_suppkey").alias("probe"), F.when(F.col("l_quantity") < 49, F.col("l_quantity")).alias("beta"))
    return evidence.complete_probes(rows).groupBy("probe").agg(F.count(F.lit(1)).alias("n")).select("probe.*", "n")


# networks


@query(sql("interactions", "costs", select=f"SELECT source, target, confidence, {r6('conf', 'cost')} FROM costed"))
def edge_cost_graph(spark, sf_dir):
    raw = network.clean_endpoints(roles.interactions(spark, sf_dir))
    return network.edge_costs(raw).select("source", "target", "confidence", "conf", "cost")


@query(sql("interactions", "costs", select=f"SELECT source, target, {r6('cost')}, is_directed, is_stimulation, is_inhibition FROM edges"))
def reciprocal_collapse(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(sql("interactions", select="SELECT source, target, CASE WHEN is_stimulation='True' AND is_inhibition<>'True' THEN 1 WHEN is_inhibition='True' AND is_stimulation<>'True' THEN -1 ELSE 1 END AS sign FROM raw WHERE source<>target"))
def signed_edges(spark, sf_dir):
    return network.signed_edges(roles.interactions(spark, sf_dir), unsigned=1).select("source", "target", "sign")


@query("""WITH g AS (SELECT DISTINCT o_custkey AS gene FROM orders), x AS (SELECT coalesce(c_mktsegment,'unknown') AS biotype, CASE WHEN n.gene IS NULL THEN 0 ELSE 1 END AS hit FROM g LEFT JOIN customer ON gene=c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS gene FROM orders WHERE o_totalprice>300000) n ON n.gene=g.gene)
SELECT coalesce(biotype,'ALL') AS biotype, count(*) AS n, sum(hit)::BIGINT AS in_network, round(avg(hit),6)+0.0::DOUBLE AS coverage FROM x GROUP BY ROLLUP(biotype)""")
def biotype_coverage_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return network.biotype_coverage(
        orders.select(F.col("o_custkey").alias("gene")), orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("node")),
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gene"), F.col("c_mktsegment").alias("biotype")),
    )


@query(sql("interactions", "costs", select="SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1"))
def degrees(spark, sf_dir):
    return network.degrees(_edges(spark, sf_dir))


_NATION = """sup AS (SELECT DISTINCT l_orderkey, s_nationkey AS t FROM lineitem JOIN supplier ON l_suppkey=s_suppkey), nat AS (SELECT c_nationkey AS s, t, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey JOIN sup ON l_orderkey=o_orderkey WHERE c_nationkey<>t GROUP BY 1,2),
cutg AS (SELECT s, t FROM nat QUALIFY n>=quantile_cont(n,0.97) OVER ())"""


def _nation_edges(spark, sf_dir):
    """Nations whose customers and suppliers share the most orders."""
    sup = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("t")).distinct()
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(sup, F.col("l_orderkey") == F.col("o_orderkey"))
    nat = rows.select(F.col("c_nationkey").alias("s"), "t").where("s <> t").groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"))
    return network.confident(nat, F.col("n"), 0.97).select("s", "t")


@query("WITH RECURSIVE " + _NATION + """, e AS (SELECT s AS a, t AS b FROM cutg UNION SELECT t, s FROM cutg), walk(node, other) AS (SELECT a, b FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON walk.other=e.a)
SELECT node, least(node, min(other)) AS component FROM walk GROUP BY node""")
def components(spark, sf_dir):
    return connected_components(_nation_edges(spark, sf_dir), "s", "t")


@query("WITH RECURSIVE " + _NATION + """, e AS (SELECT s AS a, t AS b FROM cutg UNION SELECT t, s FROM cutg), walk(node, other) AS (SELECT a, b FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON walk.other=e.a),
c AS (SELECT n_nationkey AS node, coalesce(least(n_nationkey, min(other)), n_nationkey) AS c FROM nation LEFT JOIN walk ON node=n_nationkey GROUP BY n_nationkey), z AS (SELECT c, count(*) AS k FROM c GROUP BY 1)
SELECT count(*) AS n_components, count(*) FILTER (k=1) AS n_singletons, count(*) FILTER (k>1) AS n_multinode, coalesce(max(k),0) AS largest FROM z""")
def component_summary(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return network.component_summary(_nation_edges(spark, sf_dir), nodes, "s", "t")


@query(sql("interactions", "costs", """d AS (SELECT node, count(*) AS k FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)""",
    select="""SELECT (SELECT count(*) FROM d) AS n_nodes, (SELECT max(k) FROM d) AS max_degree, (SELECT count(*) FROM edges) AS n_edges, round((SELECT min(cost) FROM edges),6)+0.0::DOUBLE AS min_cost, round((SELECT max(cost) FROM edges),6)+0.0::DOUBLE AS max_cost, 1.0::DOUBLE AS directed_share, round((SELECT avg(CASE WHEN is_stimulation<>is_inhibition THEN 1 ELSE 0 END) FROM raw),6)+0.0::DOUBLE AS signed_share"""))
def network_report(spark, sf_dir):
    return network.network_report(roles.interactions(spark, sf_dir), _edges(spark, sf_dir))


@query(sql("interactions", "costs", select="SELECT source, target, round(cost,6)+0.0::DOUBLE AS cost FROM edges QUALIFY conf>=quantile_cont(conf,0.75) OVER ()"))
def confidence_tail(spark, sf_dir):
    edges = network.collapse_reciprocal(network.edge_costs(network.clean_endpoints(roles.interactions(spark, sf_dir))))
    return network.confident(edges, F.col("conf"), 0.75).select("source", "target", "cost")


# propagation


@query(sql("interactions", "matrix", select=f"SELECT source, target, {r6('w')} FROM m"))
def signed_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(sql("interactions", "users", "seeds", "matrix", "hops", select=f"SELECT node, {r6('state')} FROM h1"))
def propagate_k1(spark, sf_dir):
    return propagation.propagate(_matrix(spark, sf_dir), roles.seeds(spark, sf_dir), hops=1).select("node", "state")


@query(sql("interactions", "users", "seeds", "matrix", "hops", select=f"SELECT node, {r6('state')} FROM pred"))
def propagate_k4(spark, sf_dir):
    return propagation.propagate(_matrix(spark, sf_dir), roles.seeds(spark, sf_dir)).select("node", "state")


@query(sql("interactions", "users", "seeds", "matrix", "hops",
    """o AS (SELECT u.node, round(coalesce(p.state,0),12) AS p, u.value AS v, errors>0 AS sig FROM users u LEFT JOIN pred p ON p.node=u.node WHERE u.node NOT IN (SELECT node FROM seeds))""",
    """f AS (SELECT *, abs(p)>1e-9 AS l, abs(p)>1e-9 AND sig AS h FROM o)""",
    """t AS (SELECT quantile_cont(abs(p),0.75) AS lim, count(*) AS hits FROM f WHERE h)""",
    """g AS (SELECT f.*, h AND abs(p)>=lim AND hits>=10 AS c FROM f, t)""",
    """rg AS (SELECT corr(rank_p,rank_v) AS rho FROM (SELECT rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS rank_p, rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0::DOUBLE AS rank_v FROM g))""",
    """rl AS (SELECT corr(rank_p,rank_v) AS rho FROM (SELECT rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS rank_p, rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0::DOUBLE AS rank_v FROM g WHERE l))""",
    """rc AS (SELECT corr(rank_p,rank_v) AS rho FROM (SELECT rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS rank_p, rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0::DOUBLE AS rank_v FROM g WHERE c))""",
    select="""SELECT round((SELECT rho FROM rg),6)+0.0::DOUBLE AS rho_global, CASE WHEN count(*) FILTER (l)>=10 THEN round((SELECT rho FROM rl),6)+0.0::DOUBLE END AS rho_local, CASE WHEN count(*) FILTER (c)>=10 THEN round((SELECT rho FROM rc),6)+0.0::DOUBLE END AS rho_conf, CASE WHEN count(*) FILTER (h)>=10 THEN round(avg(CASE WHEN h THEN (sign(p)=sign(v))::INTEGER END),6)+0.0::DOUBLE END AS sign_acc, CASE WHEN count(*) FILTER (c)>=10 THEN round(avg(CASE WHEN c THEN (sign(p)=sign(v))::INTEGER END),6)+0.0::DOUBLE END AS sign_acc_conf, count(*) FILTER (l) AS n_reached, count(*) FILTER (h) AS n_sign_scored, count(*) FILTER (c) AS n_conf FROM g"""))
def score_prediction(spark, sf_dir):
    seeds = roles.seeds(spark, sf_dir)
    pred = propagation.propagate(_matrix(spark, sf_dir), seeds).withColumn("state", F.round("state", 12))
    return propagation.score_prediction(pred, roles.observed(spark, sf_dir), seeds.select("node")).drop("run")


@query(sql("interactions", "matrix", """d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM m UNION ALL SELECT target FROM m) GROUP BY 1)""",
    select="SELECT node, degree, greatest(1, ceil(10*(row_number() OVER (ORDER BY degree, node)-1)::DOUBLE/(count(*) OVER ()-1)))::INTEGER AS bin FROM d"))
def degree_bins(spark, sf_dir):
    return propagation.degree_bins(_matrix(spark, sf_dir)).select("node", "degree", "bin")


@query(sql("interactions", "users", "seeds", "matrix", """hit AS (SELECT s.node AS source, m.target, m.w*s.state AS push, u.value FROM seeds s JOIN m ON m.source=s.node JOIN users u ON u.node=m.target AND u.errors>0)""",
    """k AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY abs(value) DESC, target) AS nth FROM hit)""",
    select="SELECT source, target, nth, sign(push)::DOUBLE AS predicted, sign(value)::DOUBLE AS observed, sign(push)=sign(value) AS agree FROM k WHERE n>=5 AND nth<=14"))
def star_targets(spark, sf_dir):
    out = propagation.star(_matrix(spark, sf_dir), roles.seeds(spark, sf_dir), roles.observed(spark, sf_dir))
    return out.withColumn("nth", F.col("nth").cast("long"))


@query("""WITH n AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1), o AS (SELECT round(avg(o_totalprice),2) AS obs FROM orders)
SELECT round((count(*) FILTER (round(v,2)>=obs)+1)::DOUBLE/(count(*)+1),6)+0.0::DOUBLE AS p, round(avg(round(v,2)),4)+0.0::DOUBLE AS null_mean, count(*) AS n FROM n, o""")
def empirical_p(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    null = orders.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    out = propagation.empirical_p(orders.agg(F.round(F.avg("o_totalprice"), 2).alias("v")), null, "v")
    return out.withColumn("null_mean", F.round("null_mean", 4))


def _placed(ends: str) -> str:
    """Nodes with their degree bin, their place in it and its size; ends: a table of node."""
    return f"""d AS (SELECT node, count(*) AS degree FROM ({ends}) GROUP BY 1), k AS (SELECT node, row_number() OVER (ORDER BY degree, node) AS r, count(*) OVER () AS n FROM d),
b AS (SELECT *, greatest(1, ceil(10*(r-1)::DOUBLE/(n-1)))::INTEGER AS bin FROM k), placed AS (SELECT node, bin, row_number() OVER (PARTITION BY bin ORDER BY r)-1 AS place, count(*) OVER (PARTITION BY bin) AS size FROM b)"""


def _drawn(rows: str, value: str, runs: int, seed: int = 1) -> str:
    """A value of rows (node, ...) moved within bins in each run."""
    return f"""keyed AS (SELECT run, bin, place, size, {value}, {draw_key_sql(seed, "run", "bin")} AS draw FROM {rows} JOIN placed USING (node), range(1,{runs + 1}) AS runs(run)),
drawn AS (SELECT run, bin, {permuted_sql("place", "size", "draw")} AS place, {value} FROM keyed),
moved AS (SELECT run::INTEGER AS run, placed.node, {value} FROM drawn JOIN placed USING (bin, place))"""


_MATRIX_ENDS = "SELECT source AS node FROM m UNION ALL SELECT target FROM m"


@query(sql("interactions", "users", "seeds", "matrix", _placed(_MATRIX_ENDS), _drawn("seeds", "state", 300), select="SELECT run, node, state FROM moved"))
def seed_shuffles(spark, sf_dir):
    bins = cut(propagation.degree_bins(cut(_matrix(spark, sf_dir), "seed-matrix")), "seed-bins")
    return propagation.shuffle_seeds(roles.seeds(spark, sf_dir), bins, runs=300)


@query(sql("interactions", "costs", "users", "prizes", _placed("SELECT source AS node FROM edges UNION ALL SELECT target FROM edges"), _drawn("prizes", "prize", 200), select="SELECT run, node, prize FROM moved WHERE prize<>0"))
def prize_shuffles(spark, sf_dir):
    return solver.shuffled_prizes(cut(_edges(spark, sf_dir).select("source", "target"), "shuffle-network"), roles.prizes(spark, sf_dir), runs=200)


_hop = lambda k: f"h{k} AS (SELECT run, target AS node, 0.5::DOUBLE*sum(w.w*x.state) AS state FROM {'moved' if k == 1 else f'h{k - 1}'} x JOIN w ON x.node=w.source GROUP BY 1,2)"
_ranked = lambda name, where: f"""{name} AS (SELECT run, corr(p_,v_) AS rho FROM (SELECT run, rank() OVER (PARTITION BY run ORDER BY p)+(count(*) OVER (PARTITION BY run,p)-1)/2.0::DOUBLE AS p_, rank() OVER (PARTITION BY run ORDER BY v)+(count(*) OVER (PARTITION BY run,v)-1)/2.0::DOUBLE AS v_ FROM g WHERE {where}) GROUP BY run)"""
_real = lambda x: f"CASE WHEN isfinite({x}) THEN round({x},6)+0.0::DOUBLE END"
#: Scores of predictions `pred` (run, node, state) for every row of `runs` (run), with the seeds left out.
_SCORED = [
    "o AS (SELECT runs.run, u.node, coalesce(p.state,0) AS p, u.value AS v, u.errors>0 AS sig FROM users u CROSS JOIN runs LEFT JOIN pred p ON p.node=u.node AND p.run=runs.run WHERE u.node NOT IN (SELECT node FROM seeds))",
    "f AS (SELECT *, abs(p)>1e-9 AS l, abs(p)>1e-9 AND sig AS h FROM o)",
    "t AS (SELECT run, quantile_cont(abs(p),0.75) AS lim, count(*) AS hits FROM f WHERE h GROUP BY run)",
    "g AS (SELECT f.*, coalesce(h AND abs(p)>=lim AND hits>=10, false) AS c FROM f LEFT JOIN t USING (run))",
    _ranked("rg", "true"), _ranked("rl", "l"), _ranked("rc", "c"),
    "s AS (SELECT run, count(*) FILTER (l) AS n_reached, count(*) FILTER (h) AS n_sign_scored, count(*) FILTER (c) AS n_conf, avg(CASE WHEN h THEN (sign(p)=sign(v))::INTEGER END) AS a, avg(CASE WHEN c THEN (sign(p)=sign(v))::INTEGER END) AS ac FROM g GROUP BY run)",
]
_SCORES = f"""SELECT s.run, {_real("rg.rho")} AS rho_global, CASE WHEN n_reached>=10 THEN {_real("rl.rho")} END AS rho_local, CASE WHEN n_conf>=10 THEN {_real("rc.rho")} END AS rho_conf, CASE WHEN n_sign_scored>=10 THEN {_real("a")} END AS sign_acc,
CASE WHEN n_conf>=10 THEN {_real("ac")} END AS sign_acc_conf, n_reached, n_sign_scored, n_conf FROM s LEFT JOIN rg USING (run) LEFT JOIN rl USING (run) LEFT JOIN rc USING (run)"""
_HOPS4 = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(1, 5))


@query(sql("interactions", "users", "seeds", "matrix", _placed(_MATRIX_ENDS), _drawn("seeds", "state", 300), *map(_hop, range(1, 5)), f"pred AS (SELECT run, node, round(sum(state),12) AS state FROM ({_HOPS4}) GROUP BY 1,2)",
    "runs AS (SELECT range::INTEGER AS run FROM range(1,301))", *_SCORED, select=_SCORES))
def null_scores(spark, sf_dir):
    return propagation.null_scores(_matrix(spark, sf_dir), roles.seeds(spark, sf_dir), roles.observed(spark, sf_dir), runs=300)


_GRID_HOP = lambda k: f"h{k} AS (SELECT network, seeds, target AS node, 0.5::DOUBLE*sum(wn.w*x.state) AS state FROM {'s0' if k == 1 else f'h{k - 1}'} x JOIN wn USING (network) WHERE x.node=wn.source GROUP BY 1,2,3)"


@query(sql("interactions", "users", "seeds", "matrix",
    "mm AS (SELECT 'weighted' AS network, source, target, w FROM m UNION ALL SELECT 'plain', source, target, sum(sign)::DOUBLE FROM signed WHERE sign<>0 GROUP BY 2,3 HAVING sum(sign)<>0)",
    "wn AS (SELECT network, source, target, w/sum(abs(w)) OVER (PARTITION BY network, target) AS w FROM mm)",
    "sets AS (SELECT 'all' AS seeds, node, state FROM seeds UNION ALL SELECT 'strong', node, state FROM seeds WHERE state<=-0.3 UNION ALL SELECT 'weak', node, state FROM seeds WHERE state>-0.3)",
    "s0 AS (SELECT network, sets.seeds, node, state FROM sets, (SELECT DISTINCT network FROM mm))", *map(_GRID_HOP, range(1, 5)),
    "hops AS (" + " UNION ALL ".join(f"SELECT network, seeds, {k} AS hop, node, state FROM h{k}" for k in range(1, 5)) + ")",
    "grid AS (SELECT *, row_number() OVER (ORDER BY network, seeds, observation, k_hops) AS run FROM (SELECT DISTINCT network, seeds FROM s0), (SELECT unnest(['value','errors']) AS observation), (SELECT range::INTEGER AS k_hops FROM range(1,5)))",
    "pred AS (SELECT run, node, round(sum(state),12) AS state FROM hops JOIN grid ON grid.network=hops.network AND grid.seeds=hops.seeds AND hop<=k_hops GROUP BY 1,2)",
    "o AS (SELECT grid.run, u.node, coalesce(p.state,0) AS p, CASE observation WHEN 'value' THEN u.value ELSE u.errors::DOUBLE END AS v, u.errors>0 AS sig FROM users u CROSS JOIN grid LEFT JOIN pred p ON p.node=u.node AND p.run=grid.run LEFT JOIN sets x ON x.seeds=grid.seeds AND x.node=u.node WHERE x.node IS NULL)",
    *_SCORED[1:], select="SELECT network, seeds, observation, k_hops, sc.* EXCLUDE (run) FROM (" + _SCORES + ") sc JOIN grid USING (run)"))
def propagation_grid(spark, sf_dir):
    """3 seed sets, 2 networks, 2 observations and 4 depths."""
    with Scope() as scope:
        signed = cut(network.signed_edges(roles.interactions(spark, sf_dir)), "grid-signed")
        seeds, u = cut(roles.seeds(spark, sf_dir), "grid-roots"), cut(roles.users(spark, sf_dir), "grid-users")
        matrices = propagation.signed_matrix(signed, weight="confidence").withColumn("network", F.lit("weighted")).unionByName(propagation.signed_matrix(signed).withColumn("network", F.lit("plain")))
        named = lambda name, rows: rows.select(F.lit(name).alias("seeds"), "node", "state")
        sets = named("all", seeds).unionByName(named("strong", seeds.where("state <= -0.3"))).unionByName(named("weak", seeds.where("state > -0.3")))
        seen = lambda c: u.select(F.lit(c).alias("observation"), "node", F.col(c).cast("double").alias("value"), (F.col("errors") > 0).alias("sig"))
        return scope.keep(propagation.evaluate_grid(matrices, sets, seen("value").unionByName(seen("errors")), [1, 2, 3, 4]))


# activities and associations


_REG = """reg AS (SELECT s_nationkey AS tf, l_partkey AS target, CASE WHEN sum(CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END)>=0 THEN 1 ELSE -1 END AS mor FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2)"""


def _regulon(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("tf"), F.col("l_partkey").alias("target")).agg(F.when(F.sum(F.when(F.col("l_returnflag") == "R", -1).otherwise(1)) >= 0, 1).otherwise(-1).alias("mor"))


_ULM = """y AS (SELECT gene, log2FC AS y FROM de WHERE log2FC IS NOT NULL), a AS (SELECT count(*)::DOUBLE AS n, sum(y) AS sy, sum(y*y) AS syy FROM y),
t AS (SELECT tf, count(*) AS n_targets, sum(mor)::DOUBLE AS sw, sum(mor*mor)::DOUBLE AS sww, sum(mor*y) AS swy FROM reg JOIN y ON gene=target WHERE tf<>target GROUP BY 1 HAVING count(*)>=5),
c AS (SELECT *, sww-sw*sw/n AS cww, swy-sw*sy/n AS cwy, syy-sy*sy/n AS cyy FROM t, a)"""


@query(sql("de", _REG, _ULM, select="SELECT tf, n_targets, round((cwy/cww)/sqrt((cyy-cwy*cwy/cww)/(n-2)/cww),6)+0.0::DOUBLE AS activity FROM c"))
def ulm_activity(spark, sf_dir):
    return regulon.activity(_regulon(spark, sf_dir), roles.de(spark, sf_dir).select("gene", F.col("log2FC").alias("y")))


def _t_tail(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided p of t by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    a, c = f"atan(abs({t})/sqrt({df}))", f"2*exp(lgamma(({df}+1)/2)-lgamma({df}/2))/sqrt(pi())"
    return f"least(1.0::DOUBLE, {c}*(pi()/2-{a})/{steps}/3*list_sum([(CASE WHEN i=0 OR i={steps} THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*pow(greatest(0,cos({a}+(pi()/2-{a})*i/{steps})),{df}-1) for i in range({steps + 1})]))"


_BH = """upto AS (SELECT *, count(*) OVER () AS __m, count(*) OVER (ORDER BY p) AS __r FROM tested), adj AS (SELECT *, least(1.0::DOUBLE, min(p*__m/__r) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM upto)"""


@query(sql("de", _REG, _ULM, "act AS (SELECT tf, n_targets, (cwy/cww)/sqrt((cyy-cwy*cwy/cww)/(n-2)/cww) AS activity, n-2 AS df FROM c)", f"tested AS (SELECT *, {_t_tail('activity', 'df', 20000)} AS p FROM act)", _BH,
    select="SELECT tf, n_targets, round(activity,4)+0.0::DOUBLE AS activity, round(p,4)+0.0::DOUBLE AS p, round(padj,4)+0.0::DOUBLE AS padj FROM adj"))
def ulm_activity_p(spark, sf_dir):
    act = regulon.activity(_regulon(spark, sf_dir), roles.de(spark, sf_dir).select("gene", F.col("log2FC").alias("y")), with_p=True)
    return rounded(ranks.bh_adjust(act, "p").select("tf", "n_targets", "activity", "p", "padj"), 4)


_CIS = """x AS (SELECT l_partkey AS k, l_suppkey AS pair, round(avg(l_quantity),6) AS x, round(avg(l_discount),6) AS y FROM lineitem GROUP BY 1,2),
r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x)+(count(*) OVER (PARTITION BY k,x)-1)/2.0::DOUBLE AS rx, rank() OVER (PARTITION BY k ORDER BY y)+(count(*) OVER (PARTITION BY k,y)-1)/2.0::DOUBLE AS ry FROM x),
g AS (SELECT k, count(*) AS n, count(*)*sum(rx*ry)-sum(rx)*sum(ry) AS c, count(*)*sum(rx*rx)-sum(rx)*sum(rx) AS vx, count(*)*sum(ry*ry)-sum(ry)*sum(ry) AS vy FROM r GROUP BY 1)"""


@query(sql(_CIS, select="SELECT k, CASE WHEN n>=10 AND vx>1e-9 AND vy>1e-9 THEN round(c/(sqrt(vx)*sqrt(vy)),6)+0.0::DOUBLE END AS rho, n FROM g"))
def cis_correlation(spark, sf_dir):
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("pair")).agg(F.round(F.avg("l_quantity"), 6).alias("x"), F.round(F.avg("l_discount"), 6).alias("y"))
    return regulon.cis_correlation(rows.select("k", "pair", F.col("x").alias("value")), rows.select("k", "pair", F.col("y").alias("value")), "k", "pair", least=10)


@query("""WITH s AS (SELECT o_custkey AS k, o_orderpriority AS patient, avg(o_totalprice) FILTER (o_orderstatus='O') - avg(o_totalprice) FILTER (o_orderstatus='F') AS delta FROM orders GROUP BY 1,2)
SELECT k, patient, round(delta,4)+0.0::DOUBLE AS delta FROM s WHERE delta IS NOT NULL""")
def paired_deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("patient"), F.when(F.col("o_orderstatus") == "O", "tumour").when(F.col("o_orderstatus") == "F", "normal").alias("grp"), "o_totalprice")
    return regulon.paired_deltas(rows, "k", "o_totalprice").withColumn("delta", F.round("delta", 4))


def _rank_sql(columns: dict[str, str], source: str) -> str:
    return "k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {e})+(count(*) OVER (PARTITION BY {e})-1)/2.0::DOUBLE AS {n}" for n, e in columns.items()) + f" FROM {source})"


@query(sql(_rank_sql({"x": "p_retailprice", "y": "p_size", "z": "p_partkey"}, "part"), "c AS (SELECT corr(x,y) AS xy, corr(x,z) AS xz, corr(y,z) AS yz, count(*) AS n FROM k)", select="SELECT round((xy-xz*yz)/(sqrt(1-xz*xz)*sqrt(1-yz*yz)),6)+0.0::DOUBLE AS rho, n FROM c"))
def partial_corr(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_partkey").cast("double").alias("z"))
    return regulon.partial_correlation(rows, "x", "y", "z")


@query(sql(_rank_sql({"y": "s_acctbal", "a": "s_suppkey", "b": "s_nationkey"}, "supplier"),
    "s AS (SELECT count(*) AS n, sum(a*a)-sum(a)*sum(a)/count(*) AS aa, sum(b*b)-sum(b)*sum(b)/count(*) AS bb, sum(a*b)-sum(a)*sum(b)/count(*) AS ab, sum(a*y)-sum(a)*sum(y)/count(*) AS ay, sum(b*y)-sum(b)*sum(y)/count(*) AS by_, sum(y*y)-sum(y)*sum(y)/count(*) AS yy FROM k)",
    "q AS (SELECT *, aa*bb-ab*ab AS det, (ay*bb-by_*ab)/(aa*bb-ab*ab) AS b1, (by_*aa-ay*ab)/(aa*bb-ab*ab) AS b2 FROM s)",
    "v AS (SELECT *, (yy-b1*ay-b2*by_)/(n-3) AS s2 FROM q)",
    select="SELECT round(b1/sqrt(s2*bb/det),6)+0.0::DOUBLE AS t1, round(b2/sqrt(s2*aa/det),6)+0.0::DOUBLE AS t2, n FROM v"))
def rank_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("y"), F.col("s_suppkey").cast("double").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return regulon.rank_regression(rows, "y", "a", "b")


_PAIR = """w AS (SELECT o_custkey, round(avg(o_totalprice) FILTER (o_orderstatus='O') - avg(o_totalprice) FILTER (o_orderstatus='F'),2) AS d FROM orders GROUP BY 1),
q AS (SELECT d, rank() OVER (ORDER BY abs(d))+(count(*) OVER (PARTITION BY abs(d))-1)/2.0::DOUBLE AS r FROM w WHERE d IS NOT NULL AND d<>0),
ti AS (SELECT coalesce(sum(t*t*t-t),0)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS t FROM q GROUP BY abs(d))), o AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d>0),0) AS v FROM q)"""


def _paired_orders(spark, sf_dir):
    """Per customer x, the mean price of open orders less that of finished ones, summed in the order of their keys: one in seven lies between two cents, where the last bit of a sum counts."""
    price = {s: F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")) for s in "OF"}
    means = regulon.ordered_means(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", price)
    return cut(means.select("o_custkey", scalars.rounded_half(F.col("O") - F.col("F"), 2).alias("x"), F.lit(0.0).alias("y")), "paired-orders")


@query(sql(_PAIR, select="SELECT n, round(v,6)+0.0::DOUBLE AS v, round((v-n*(n+1)/4.0::DOUBLE-0.5::DOUBLE*sign(v-n*(n+1)/4.0::DOUBLE))/sqrt(n::DOUBLE*(n+1)*(2*n+1)/24-ties/48),6)+0.0::DOUBLE AS z FROM o, ti"))
def paired_signed_rank(spark, sf_dir):
    return regulon.signed_rank(_paired_orders(spark, sf_dir), "x", "y")


@query(sql(_PAIR, "z AS (SELECT n, (v-n*(n+1)/4.0::DOUBLE-0.5::DOUBLE*sign(v-n*(n+1)/4.0::DOUBLE))/sqrt(n::DOUBLE*(n+1)*(2*n+1)/24-ties/48) AS z FROM o, ti)",
    "s AS (SELECT n, z, abs(z)/40000 AS h FROM z)",
    select="SELECT n, round(z,6)+0.0::DOUBLE AS z, round(1-2*h/3/sqrt(2*pi())*list_sum([(CASE WHEN i=0 OR i=40000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*exp(-(i*h)*(i*h)/2) for i in range(40001)]),6)+0.0::DOUBLE AS p FROM s"))
def paired_signed_rank_p(spark, sf_dir):
    """The same test with its two-sided p; the SQL integrates the normal density."""
    return regulon.signed_rank(_paired_orders(spark, sf_dir), "x", "y", with_p=True).select("n", "z", "p")


_FIVE = "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, " + ", ".join(f"round(quantile_cont(l_quantity,{q}),6)+0.0::DOUBLE AS {c}" for q, c in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))) + " FROM lineitem GROUP BY 1,2"


@query(_FIVE)
def five_numbers(spark, sf_dir):
    return regulon.five_numbers(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("SELECT least(floor((o_totalprice-0)*70/500000.0::DOUBLE),69)::INTEGER AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1")
def histogram(spark, sf_dir):
    return regulon.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0, 70)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice,l_quantity),4)+0.0::DOUBLE AS slope, round(regr_intercept(l_extendedprice,l_quantity),4)+0.0::DOUBLE AS intercept, regr_count(l_extendedprice,l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def fitted_lines(spark, sf_dir):
    out = regulon.fitted_lines(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


_SEED = """s AS (SELECT sign(m.delta_beta)::DOUBLE AS direction, log2FC AS effect, round(m.delta_beta*-10,6) AS rho, d.padj AS p, d.padj*2 AS padj FROM dmr m JOIN de d ON m.gene=d.gene WHERE m.region='R' AND m.delta_beta IS NOT NULL AND log2FC IS NOT NULL),
f AS (SELECT 'all' AS filter, * FROM s UNION ALL SELECT 'paired_nominal', * FROM s WHERE rho < -0.1 AND p < 0.05 UNION ALL SELECT 'loose', * FROM s WHERE rho < -0.1 AND padj < 0.25 UNION ALL SELECT 'strict', * FROM s WHERE rho < -0.2 AND padj < 0.05)"""


@query(sql("de", "dmr", _SEED, select="SELECT filter, count(*) AS n, round(avg(CASE WHEN direction>0 THEN (effect<0)::INTEGER END),6)+0.0::DOUBLE AS hyper_down, round(avg(CASE WHEN direction<0 THEN (effect>0)::INTEGER END),6)+0.0::DOUBLE AS hypo_up, round(avg(CASE WHEN direction<0 THEN effect END)-avg(CASE WHEN direction>0 THEN effect END),6)+0.0::DOUBLE AS separation FROM f GROUP BY 1"))
def seed_quality(spark, sf_dir):
    m = roles.dmr(spark, sf_dir).where("region = 'R' and delta_beta is not null").select("gene", "delta_beta")
    rows = m.join(roles.de(spark, sf_dir).where("log2FC is not null"), "gene")
    return regulon.seed_quality(rows.select(scalars.sign("delta_beta").alias("direction"), F.col("log2FC").alias("effect"), F.round(F.col("delta_beta") * -10, 6).alias("rho"), F.col("padj").alias("p"), (F.col("padj") * 2).alias("padj")))


@query(sql("de", _REG, _ULM, """b AS (SELECT tf, (cwy/cww)/sqrt((cyy-cwy*cwy/cww)/(n-2)/cww) AS va FROM c)""",
    """t2 AS (SELECT tf, count(*) AS n_targets, sum(mor)::DOUBLE AS sw, sum(mor*mor)::DOUBLE AS sww, sum(mor*y) AS swy FROM reg JOIN y ON gene=target WHERE tf<>target AND mor>0 GROUP BY 1 HAVING count(*)>=5)""",
    """c2 AS (SELECT *, sww-sw*sw/n AS cww, swy-sw*sy/n AS cwy, syy-sy*sy/n AS cyy FROM t2, a)""", """d2 AS (SELECT tf, (cwy/cww)/sqrt((cyy-cwy*cwy/cww)/(n-2)/cww) AS vb FROM c2)""",
    """j AS (SELECT round(va,9) AS va, round(vb,9) AS vb FROM b JOIN d2 USING (tf))""", _rank_sql({"ra": "va", "rb": "vb", "sa": "sign(va)", "sb": "sign(vb)"}, "j"), """g2 AS (SELECT count(*) AS n, avg((sign(va)=sign(vb))::INTEGER) AS s FROM j)""",
    select="SELECT n, round(s,6)+0.0::DOUBLE AS sign_agreement, round((SELECT corr(ra,rb) FROM k),6)+0.0::DOUBLE AS rho FROM g2"))
def compare_variants(spark, sf_dir):
    y = roles.de(spark, sf_dir).select("gene", F.col("log2FC").alias("y"))
    reg = _regulon(spark, sf_dir)
    nine = lambda df: df.withColumn("activity", F.round("activity", 9))
    return regulon.compare_variants(nine(regulon.activity(reg, y)), nine(regulon.activity(reg.where("mor > 0"), y)))


# joins, unions, shapes


@query(sql("de", "dmr", select="SELECT d.gene, round(log2FC,6)+0.0::DOUBLE AS log2FC, round(r.delta_beta,6)+0.0::DOUBLE AS prom, round(a.delta_beta,6)+0.0::DOUBLE AS body FROM de d LEFT JOIN (SELECT * FROM dmr WHERE region='R') r ON r.gene=d.gene LEFT JOIN (SELECT * FROM dmr WHERE region='A') a ON a.gene=d.gene"))
def left_chain(spark, sf_dir):
    m = roles.dmr(spark, sf_dir)
    side = lambda r, n: m.where(F.col("region") == r).select("gene", F.col("delta_beta").alias(n))
    return regulon.left_chain([roles.de(spark, sf_dir).select("gene", "log2FC"), side("R", "prom"), side("A", "body")], "gene")


@query("SELECT l_returnflag, measure, round(sum(v),2)+0.0::DOUBLE AS total, count(*) AS n FROM (SELECT l_returnflag, 'l_quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1,2")
def union_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").unpivot(["l_returnflag"], ["l_quantity", "l_extendedprice"], "measure", "v")
    return rows.groupBy("l_returnflag", "measure").agg(F.round(F.sum("v"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus='O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus='F'")
def set_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P' OR o_totalprice>400000")
def set_difference(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' or o_totalprice > 400000")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(ordered.select("o_custkey"))


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, round(l_extendedprice,6)+0.0::DOUBLE AS l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY abs(l_extendedprice) DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k=1")
def strongest_per_key(spark, sf_dir):
    out = evidence.strongest(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])
    return out.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


# forests


def _forest_inputs(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target", "cost"), roles.prizes(spark, sf_dir).where("prize > 0")


#: Every way through this network has a length of its own, and so the solver's steps have one result: costs with a small number of the pair's own.
_OWN = """fe AS MATERIALIZED (SELECT source AS a, target AS b, cost+((substr(source,2)::BIGINT*1000003+substr(target,2)::BIGINT*15485863)%2147483647)*4e-12::DOUBLE AS cost FROM edges),
fprizes AS MATERIALIZED (SELECT node, round(6*(prize-0.1::DOUBLE),9) AS prize FROM prizes WHERE prize>0.1)"""
_OMEGA, _MU = 0.3, 0.002


def _tree_inputs(spark, sf_dir):
    own = (F.expr("substring(source, 2)").cast("long") * 1000003 + F.expr("substring(target, 2)").cast("long") * 15485863) % 2147483647
    edges = _edges(spark, sf_dir).select("source", "target", (F.col("cost") + own * F.lit(4e-12)).alias("cost"))
    return edges, roles.prizes(spark, sf_dir).where("prize > 0.1").select("node", F.round(6 * (F.col("prize") - 0.1), 9).alias("prize"))


def _forest_oracle(select: str, fp: str = "fp AS (SELECT 0 AS run, node, prize FROM fprizes)") -> str:
    return "WITH RECURSIVE " + sql("interactions", "costs", "users", "prizes", _OWN, fp, *forest_sql(_OMEGA, _MU), select=select).removeprefix("WITH ")


@query(_forest_oracle(f"SELECT nodes, n_trees, terminals, steiner, {r6('objective')} FROM finfo"))
def solve_forest(spark, sf_dir):
    return solver.summarise_forest(*solver.solve_forest(*_tree_inputs(spark, sf_dir), _OMEGA, _MU), _OMEGA).drop("run")


@query(_forest_oracle(f"SELECT a, b, {r6('cost')} FROM fedges"))
def forest_edges(spark, sf_dir):
    edges, _ = solver.solve_forest(*_tree_inputs(spark, sf_dir), _OMEGA, _MU)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cost")


@query(_forest_oracle(f"SELECT node, {r6('prize', 'p')}, terminal FROM fnodes"))
def forest_nodes(spark, sf_dir):
    return solver.solve_forest(*_tree_inputs(spark, sf_dir), _OMEGA, _MU)[1].select("node", "prize", "p", "terminal")


def _steiner(spark, sf_dir):
    """The trees over the terminals, before they are pruned, and what their nodes are worth."""
    edges, prizes = _tree_inputs(spark, sf_dir)
    edges = cut(edges, "tree-network")
    worth = prizes.join(network.degrees(edges), "node").select(F.lit(0).alias("run"), "node", (F.col("prize") - _MU * F.col("degree")).alias("p")).where("p > 0")
    worth = cut(worth, "tree-worth")
    net = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "cost")
    return *solver.steiner_trees(net, worth.select("run", "node")), worth


@query(_forest_oracle(f"SELECT least(a,b) AS a, greatest(a,b) AS b, {r6('cost')} FROM tree"))
def steiner_edges(spark, sf_dir):
    return _steiner(spark, sf_dir)[0].select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cost")


@query(_forest_oracle(f"SELECT steps.node, parent, {r6('cost', 'gain')} FROM steps JOIN gains USING (run, node) WHERE parent IS NOT NULL"))
def leaf_gains(spark, sf_dir):
    """What each subtree is worth to its parent, and so the parent of every node under the root of its tree."""
    tree, home, _, worth = _steiner(spark, sf_dir)
    net = home.join(worth, ["run", "node"], "left").select("run", "node", "tree", F.coalesce("p", F.lit(0.0)).alias("net"))
    roots = net.groupBy("run", "tree").agg(F.min(F.struct((-F.col("net")).alias("x"), "node")).alias("r")).select("run", "r.node")
    return solver.settled_leaves(tree, net.select("run", "node", "net"), roots).select("node", "parent", "cost", "gain")


@query(_forest_oracle(f"SELECT least(node,parent) AS a, greatest(node,parent) AS b, {r6('cost')} FROM kept WHERE parent IS NOT NULL"))
def pruned_edges(spark, sf_dir):
    tree, home, _, worth = _steiner(spark, sf_dir)
    return solver.prune_trees(tree, worth, home)[0].select("a", "b", "cost")


_NOISY = f"fp AS MATERIALIZED (SELECT run::INTEGER AS run, node, greatest(0.0::DOUBLE, prize*(1+0.1::DOUBLE*{scalars.normal_sql(1, 'run', 'node')})) AS prize FROM fprizes, range(1,101) AS runs(run))"


@query(_forest_oracle("SELECT a AS source, b AS target, round(count(*)/100.0::DOUBLE,6)+0.0::DOUBLE AS frequency FROM fedges GROUP BY 1,2", _NOISY))
def robust_frequency(spark, sf_dir):
    return solver.robust_forest(*_tree_inputs(spark, sf_dir), _OMEGA, _MU)[0]


@query(_forest_oracle("SELECT node, round(count(*)/100.0::DOUBLE,6)+0.0::DOUBLE AS frequency FROM fnodes GROUP BY 1", _NOISY))
def robust_nodes(spark, sf_dir):
    return solver.robust_forest(*_tree_inputs(spark, sf_dir), _OMEGA, _MU)[1]


_PERMUTED = _placed("SELECT source AS node FROM edges UNION ALL SELECT target FROM edges") + ",\n" + _drawn("fprizes", "prize", 200) + ",\nfp AS MATERIALIZED (SELECT 0 AS run, node, prize FROM fprizes UNION ALL SELECT run, node, prize FROM moved WHERE prize<>0)"
_COUNTS = ("nodes", "steiner", "objective")
_null_p = lambda cond, name: f"round((count(*) FILTER ({cond})+1)/201.0::DOUBLE,6)+0.0::DOUBLE AS {name}"


@query(_forest_oracle(
    f"SELECT {', '.join(f'round(any_value(o.{c}),6)+0.0::DOUBLE AS observed_{c}, round(avg(i.{c}),6)+0.0::DOUBLE AS null_{c}_mean' for c in _COUNTS)}, {_null_p('i.nodes<=o.nodes', 'p_compactness')}, {_null_p('i.steiner>=o.steiner', 'p_steiner')}, {_null_p('i.objective>=o.objective', 'p_objective')}"
    f" FROM (SELECT run, {', '.join(f'coalesce({c},0)::DOUBLE AS {c}' for c in _COUNTS)} FROM range(201) AS runs(run) LEFT JOIN finfo USING (run)) i, (SELECT * FROM finfo WHERE run=0) o WHERE i.run>0", _PERMUTED))  # fmt: skip
def permutation_test(spark, sf_dir):
    return solver.permutation_test(*_tree_inputs(spark, sf_dir), _OMEGA, _MU)


# differential tests over samples


_ASSAY = """sampled AS (SELECT l_suppkey AS feature, lpad((o_custkey%40)::VARCHAR,12,'P') AS patient, CASE o_orderstatus WHEN 'O' THEN 'tumour' ELSE 'normal' END AS grp, sum(l_quantity)::BIGINT AS count, round(avg(l_discount),9) AS beta FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_orderstatus IN ('O','F') GROUP BY 1,2,3)"""


def _assay(spark, sf_dir):
    """Suppliers as features, customers in forty groups as patients, open and finished orders as tumour and normal samples."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderstatus in ('O', 'F')")
    sample = F.concat(F.lpad((F.col("o_custkey") % 40).cast("string"), 12, "P"), F.when(F.col("o_orderstatus") == "O", "-01A").otherwise("-11A"))
    return rows.groupBy(F.col("l_suppkey").alias("feature"), sample.alias("sample")).agg(F.sum("l_quantity").cast("long").alias("count"), F.round(F.avg("l_discount"), 9).alias("beta"))


def _samples(assay):
    return assay.select(F.col("sample").alias("barcode")).distinct()


_M = "log2(least(greatest(beta,0.001::DOUBLE),0.999::DOUBLE)/(1-least(greatest(beta,0.001::DOUBLE),0.999::DOUBLE)))"
_FITS = f"""ms AS (SELECT feature, grp, patient, beta, {_M} AS y FROM sampled),
fit AS (SELECT feature, avg(beta) FILTER (grp='tumour')-avg(beta) FILTER (grp='normal') AS delta_beta, avg(y) FILTER (grp='tumour')-avg(y) FILTER (grp='normal') AS effect, count(*) FILTER (grp='tumour') AS nt, count(*) FILTER (grp='normal') AS nn,
var_pop(y) FILTER (grp='tumour')*count(*) FILTER (grp='tumour')+var_pop(y) FILTER (grp='normal')*count(*) FILTER (grp='normal') AS ss FROM ms GROUP BY 1),
fits AS (SELECT *, (nt+nn-2)::DOUBLE AS df, ss/(nt+nn-2) AS s2, 1.0::DOUBLE/nt+1.0::DOUBLE/nn AS scale FROM fit WHERE nt>0 AND nn>0 AND nt+nn>2)"""


def _digamma(x: str) -> str:
    z = f"({x}+20)"
    return f"(ln({z})-1/(2*{z})-1/(12*pow({z},2))+1/(120*pow({z},4))-list_sum([1.0::DOUBLE/({x}+k) for k in range(20)]))"


def _trigamma(x: str) -> str:
    z = f"({x}+20)"
    return f"(1/{z}+1/(2*pow({z},2))+1/(6*pow({z},3))-1/(30*pow({z},5))+list_sum([1.0::DOUBLE/pow({x}+k,2) for k in range(20)]))"


_PRIOR = f"""grp_df AS (SELECT df, count(*) AS n, avg(ln(s2)) AS m, coalesce(var_samp(ln(s2)),0) AS v, {_digamma('df/2')}-ln(df/2) AS c, {_trigamma('df/2')} AS tri FROM fits WHERE s2>0 GROUP BY df),
mean_ AS (SELECT sum(n*(m-c))/sum(n) AS mean, sum(n) AS total FROM grp_df),
excess AS (SELECT any_value(mean) AS mean, sum((n-1)*v+n*pow(m-c-mean,2))/(any_value(total)-1)-sum(n*tri)/any_value(total) AS x FROM grp_df, mean_),
bis(i, lo, hi) AS (SELECT 0, -20.0::DOUBLE, 20.0::DOUBLE UNION ALL SELECT i+1, CASE WHEN {_trigamma('exp((lo+hi)/2)')}>x THEN (lo+hi)/2 ELSE lo END, CASE WHEN {_trigamma('exp((lo+hi)/2)')}>x THEN hi ELSE (lo+hi)/2 END FROM bis, excess WHERE i<90 AND x>1e-12),
prior AS (SELECT CASE WHEN x>1e-12 THEN (SELECT 2*exp(max(lo)) FROM bis WHERE i=90) END AS d0, mean FROM excess),
prior2 AS (SELECT d0, exp(mean+CASE WHEN d0 IS NULL THEN 0 ELSE {_digamma('d0/2')}-ln(d0/2) END) AS s0, (SELECT sum(df) FROM fits) AS total FROM prior),
mod AS (SELECT *, effect/sqrt(coalesce((d0*s0+df*s2)/(d0+df),s0)*scale) AS t, coalesce(least(df+d0,total),total) AS dft FROM fits, prior2), tested AS (SELECT *, {_t_tail('t', 'dft')} AS p FROM mod)"""


@query("WITH RECURSIVE " + sql(_ASSAY, _FITS, _PRIOR, _BH, select="SELECT feature AS probe, round(delta_beta,4)+0.0::DOUBLE AS delta_beta, round(padj,4)+0.0::DOUBLE AS padj, round(t,4)+0.0::DOUBLE AS t FROM adj").removeprefix("WITH "))
def diff_methylation(spark, sf_dir):
    assay = _assay(spark, sf_dir)
    return rounded(diff.diff_methylation(assay.select(F.col("feature").alias("probe"), "sample", "beta"), _samples(assay)), 4)


@query(sql(_ASSAY, _FITS, select=f"SELECT feature AS probe, {r6('effect', 's2', 'df')} FROM fits"))
def two_group_fits(spark, sf_dir):
    assay = _assay(spark, sf_dir)
    return diff.group_fits(assay.select(F.col("feature").alias("probe"), "sample", "beta"), _samples(assay)).select("probe", "effect", "s2", "df")


@query(sql(_ASSAY, f"""both_ AS (SELECT patient FROM sampled GROUP BY 1 HAVING count(DISTINCT grp)=2)""", f"""d AS (SELECT feature, patient, max(CASE WHEN grp='tumour' THEN {_M} END)-max(CASE WHEN grp='normal' THEN {_M} END) AS d FROM sampled WHERE patient IN (SELECT patient FROM both_) GROUP BY 1,2)""",
    select="SELECT feature AS probe, round(avg(d),6)+0.0::DOUBLE AS effect, round(var_samp(d)/2,6)+0.0::DOUBLE AS s2, (count(d)-1)::DOUBLE AS df FROM d GROUP BY 1 HAVING count(d)>1"))
def paired_fits(spark, sf_dir):
    assay = _assay(spark, sf_dir)
    return diff.group_fits(assay.select(F.col("feature").alias("probe"), "sample", "beta"), _samples(assay), paired=True).select("probe", "effect", "s2", "df")


_TMM = """lib AS (SELECT sample, sum(count)::DOUBLE AS lib FROM c GROUP BY 1), shares AS (SELECT c.*, lib, count/lib AS q FROM c JOIN lib USING (sample)),
up AS (SELECT sample, quantile_cont(q,0.75) AS u FROM shares GROUP BY 1), ref AS (SELECT sample FROM up ORDER BY abs(u-(SELECT avg(u) FROM up)), sample LIMIT 1), base AS (SELECT feature, q AS rq, count AS rc, lib AS rl FROM shares WHERE sample=(SELECT sample FROM ref)),
r AS (SELECT shares.*, rq, rc, rl, log2(q/rq) AS m, log2(q*rq)/2 AS a, (lib-count)/lib/count+(rl-rc)/rl/rc AS v FROM shares JOIN base USING (feature) WHERE count>0 AND rc>0),
k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, rank() OVER (PARTITION BY sample ORDER BY m) AS rm, rank() OVER (PARTITION BY sample ORDER BY a) AS ra FROM r),
f AS (SELECT sample, sum(m/v)/sum(1/v) AS lf FROM k WHERE rm>=floor(n*0.3::DOUBLE)+1 AND rm<=n-floor(n*0.3::DOUBLE) AND ra>=floor(n*0.05::DOUBLE)+1 AND ra<=n-floor(n*0.05::DOUBLE) GROUP BY 1), g AS (SELECT lib.*, coalesce(lf,0) AS lf FROM lib LEFT JOIN f USING (sample))"""


@query(sql(_ASSAY, "c AS (SELECT feature, patient||grp AS sample, count FROM sampled)", _TMM, select="SELECT substr(sample,1,12) AS patient, substr(sample,13) AS grp, lib, round(pow(2,lf-(SELECT avg(lf) FROM g)),5)+0.0::DOUBLE AS factor FROM g"))
def size_factors(spark, sf_dir):
    counts = _assay(spark, sf_dir).select(F.col("feature").alias("gene_id"), "sample", "count")
    out = diff.tmm_factors(counts)
    return out.select(scalars.patient_of("sample").alias("patient"), scalars.sample_group("sample").alias("grp"), "lib", F.round("factor", 5).alias("factor"))


@query("WITH pts AS (SELECT avg(l_quantity)::DOUBLE AS x, round(stddev_samp(l_extendedprice),2) AS y FROM lineitem GROUP BY l_partkey),\n" + local_regression_sql("pts") + "\nSELECT round(pos,6) AS knot, round(level,2)+0.0::DOUBLE AS level FROM smooth")
def local_trend(spark, sf_dir):
    """The spread of a part's prices on its mean quantity, as the variance trend of genes is made."""
    points = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").cast("double").alias("x"), F.round(F.stddev_samp("l_extendedprice"), 2).alias("y"))
    knots, levels = local_regression(points)
    return spark.createDataFrame(list(zip(knots, levels)), "knot double, level double").withColumn("level", F.round("level", 2))


#: From the samples used (`c0`) to log counts: genes with enough counts, sizes of the samples, `sz` and `logs`.
_LOGS = """lib0 AS (SELECT sample, any_value(grp) AS grp, sum(count)::DOUBLE AS lib FROM c0 GROUP BY 1),
need AS (SELECT CASE WHEN min(n)<=10 THEN min(n) ELSE 10+0.7::DOUBLE*(min(n)-10) END AS least FROM (SELECT count(*) AS n FROM lib0 GROUP BY grp)),
typical AS (SELECT median(lib) AS med FROM lib0),
passed AS (SELECT feature FROM c0 JOIN lib0 USING (sample), typical, need GROUP BY feature, least HAVING count(*) FILTER (count/lib*1e6>=10*1e6/med)>=least-1e-14 AND sum(count)>=15),
c AS (SELECT * FROM c0 WHERE feature IN (SELECT feature FROM passed)), """ + _TMM + """,
sz AS MATERIALIZED (SELECT sample, lib*pow(2,lf-(SELECT avg(lf) FROM g)) AS size FROM g), shift AS (SELECT avg(log2(size+1))-log2(1e6) AS shift FROM sz),
logs AS MATERIALIZED (SELECT feature, patient, grp, size, log2((count+0.5::DOUBLE)/(size+1)*1e6) AS y FROM c JOIN sz USING (sample))"""
#: From a first fit (`one`: feature, mean, s2) and fitted values (`hat`: feature, patient, grp, y, x) to precision weights.
_TREND = "pts AS MATERIALIZED (SELECT mean+shift AS x, pow(s2,0.25) AS y FROM one, shift WHERE s2>0),\n" + local_regression_sql("pts") + """,
seg AS (SELECT pos, greatest(level,1e-6) AS level, lead(pos) OVER (ORDER BY pos) AS next, lead(greatest(level,1e-6)) OVER (ORDER BY pos) AS above, row_number() OVER (ORDER BY pos) AS nth, count(*) OVER () AS knots FROM smooth),
weighted AS MATERIALIZED (SELECT feature, patient, grp, y, pow(level+(above-level)*greatest(0,least(1,(x-pos)/(next-pos))),-4) AS w FROM hat JOIN seg ON next IS NOT NULL AND (x>=pos OR nth=1) AND (x<next OR nth=knots-1))"""
_GENES = "SELECT feature::VARCHAR AS gene, round(effect,4)+0.0::DOUBLE AS \"log2FC\", round(padj,4)+0.0::DOUBLE AS padj, round(mean,4)+0.0::DOUBLE AS \"AveExpr\", round(t,4)+0.0::DOUBLE AS t FROM adj"


def _genes(spark, sf_dir, paired):
    # the counts are summed up once, for the design too
    counts = cut(_assay(spark, sf_dir).select(F.col("feature").cast("string").alias("gene_id"), "sample", "count"), "genes-counts")
    return rounded(diff.diff_expression(counts, _samples(counts), paired=paired), 4)


@query("WITH RECURSIVE " + sql(_ASSAY, "c0 AS (SELECT feature, patient||grp AS sample, patient, grp, count FROM sampled)", _LOGS,
    """one AS (SELECT feature, avg(y) AS mean, (var_pop(y) FILTER (grp='tumour')*count(*) FILTER (grp='tumour')+var_pop(y) FILTER (grp='normal')*count(*) FILTER (grp='normal'))/(count(*)-2) AS s2 FROM logs GROUP BY 1 HAVING count(DISTINCT grp)=2 AND count(*)>2)""",
    """hat AS (SELECT logs.*, m+log2(size+1)-log2(1e6) AS x FROM logs JOIN (SELECT feature, grp, avg(y) AS m FROM logs GROUP BY 1,2) USING (feature, grp))""", _TREND,
    """side AS (SELECT feature, grp, count(*) AS n, sum(w) AS w, sum(w*y)/sum(w) AS mu, sum(y) AS sy FROM weighted GROUP BY 1,2), spread AS (SELECT feature, grp, sum(weighted.w*(y-mu)*(y-mu)) AS ss FROM weighted JOIN side USING (feature, grp) GROUP BY 1,2)""",
    """fits AS (SELECT t.feature, t.mu-o.mu AS effect, (t.n+o.n-2)::DOUBLE AS df, (st.ss+so.ss)/(t.n+o.n-2) AS s2, 1/t.w+1/o.w AS scale, (t.sy+o.sy)/(t.n+o.n) AS mean FROM side t JOIN side o ON t.feature=o.feature AND t.grp='tumour' AND o.grp='normal' JOIN spread st ON st.feature=t.feature AND st.grp='tumour' JOIN spread so ON so.feature=t.feature AND so.grp='normal' WHERE t.n+o.n>2)""",
    _PRIOR, _BH, select=_GENES).removeprefix("WITH "))
def diff_expression(spark, sf_dir):
    return _genes(spark, sf_dir, False)


_BOTH = "both_ AS (SELECT patient FROM sampled GROUP BY 1 HAVING count(DISTINCT grp)=2)"


@query("WITH RECURSIVE " + sql(_ASSAY, _BOTH, "c0 AS (SELECT feature, patient||grp AS sample, patient, grp, count FROM sampled WHERE patient IN (SELECT patient FROM both_))", _LOGS,
    """pairs AS (SELECT feature, patient, max(y) FILTER (grp='tumour') AS y1, max(y) FILTER (grp='normal') AS y0 FROM logs GROUP BY 1,2 HAVING count(DISTINCT grp)=2)""",
    """one AS (SELECT feature, avg(y1-y0) AS effect, var_samp(y1-y0)/2 AS s2, avg((y1+y0)/2) AS mean FROM pairs GROUP BY 1 HAVING count(*)>1)""",
    """hat AS (SELECT feature, patient, grp, y, (y1+y0)/2+CASE WHEN grp='tumour' THEN effect/2 ELSE -effect/2 END+log2(size+1)-log2(1e6) AS x FROM logs JOIN pairs USING (feature, patient) JOIN one USING (feature))""", _TREND,
    """duo AS (SELECT feature, patient, max(w) FILTER (grp='tumour') AS w1, max(w) FILTER (grp='normal') AS w0, max(y) FILTER (grp='tumour') AS y1, max(y) FILTER (grp='normal') AS y0 FROM weighted GROUP BY 1,2)""",
    """eff AS (SELECT feature, sum(w1*w0/(w1+w0)*(y1-y0))/sum(w1*w0/(w1+w0)) AS effect, 1/sum(w1*w0/(w1+w0)) AS scale, (count(*)-1)::DOUBLE AS df, avg((y1+y0)/2) AS mean FROM duo GROUP BY 1)""",
    """fits AS (SELECT feature, effect, df, scale, mean, sum(w1*w0/(w1+w0)*pow(y1-y0-effect,2))/df AS s2 FROM duo JOIN eff USING (feature) WHERE df>0 GROUP BY feature, effect, df, scale, mean)""",
    _PRIOR, _BH, select=_GENES).removeprefix("WITH "))
def diff_expression_paired(spark, sf_dir):
    return _genes(spark, sf_dir, True)


@query("WITH RECURSIVE " + sql(_ASSAY, _BOTH, f"""mine AS (SELECT feature, patient, grp, beta, {_M} AS y FROM sampled WHERE patient IN (SELECT patient FROM both_))""",
    """d AS (SELECT feature, patient, max(y) FILTER (grp='tumour')-max(y) FILTER (grp='normal') AS d FROM mine GROUP BY 1,2)""",
    """fits AS (SELECT feature, avg(d) AS effect, var_samp(d)/2 AS s2, (count(d)-1)::DOUBLE AS df, 2.0::DOUBLE/count(d) AS scale FROM d GROUP BY 1 HAVING count(d)>1)""", _PRIOR, _BH,
    """delta AS (SELECT feature, avg(beta) FILTER (grp='tumour')-avg(beta) FILTER (grp='normal') AS delta_beta FROM mine GROUP BY 1)""",
    select="SELECT feature AS probe, round(delta_beta,4)+0.0::DOUBLE AS delta_beta, round(padj,4)+0.0::DOUBLE AS padj, round(t,4)+0.0::DOUBLE AS t FROM adj JOIN delta USING (feature)").removeprefix("WITH "))
def diff_methylation_paired(spark, sf_dir):
    assay = _assay(spark, sf_dir)
    return rounded(diff.diff_methylation(assay.select(F.col("feature").alias("probe"), "sample", "beta"), _samples(assay), paired=True), 4)



# annotation


_PACKED = """packed AS (SELECT l_orderkey AS probe, string_agg(CASE WHEN l_tax>0.07 THEN '' ELSE l_partkey::VARCHAR END, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS genes, string_agg(l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_suppkey)||CASE WHEN l_orderkey%7=0 THEN ';X' ELSE '' END AS regions FROM lineitem GROUP BY l_orderkey),
fields AS (SELECT probe, CASE WHEN genes='' THEN []::VARCHAR[] ELSE string_split(regexp_replace(genes,';$',''),';') END AS g, string_split(regions,';') AS r FROM packed)"""


def _packed(spark, sf_dir):
    """Orders as probes whose genes and regions are packed in two columns; some genes are empty, some lists uneven."""
    gene = F.when(F.col("l_tax") > 0.07, "").otherwise(F.col("l_partkey").cast("string"))
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("probe")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", gene.alias("g"), F.col("l_returnflag").alias("r")))).alias("x"))
    return rows.select("probe", F.array_join("x.g", ";").alias("genes"), F.concat(F.array_join("x.r", ";"), F.when(F.col("probe") % 7 == 0, ";X").otherwise("")).alias("regions"))


@query(sql(_PACKED, """dm AS (SELECT o_orderkey AS probe, round(o_totalprice/1000-100,6) AS delta_beta, round((o_custkey%100)/100.0::DOUBLE,6) AS padj FROM orders WHERE o_orderstatus<>'P')""",
    """pairs AS (SELECT DISTINCT probe, gene, region FROM (SELECT probe, unnest(g) AS gene, unnest(r) AS region FROM fields WHERE len(g)=len(r)) WHERE gene<>'')""",
    select=f"SELECT gene, region, {r6('delta_beta', 'padj')}, probe FROM pairs JOIN dm USING (probe)"))
def annotate_probes(spark, sf_dir):
    dm = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("probe"), F.round(F.col("o_totalprice") / 1000 - 100, 6).alias("delta_beta"), F.round((F.col("o_custkey") % 100) / 100.0, 6).alias("padj"))
    return evidence.annotate_probes(dm, _packed(spark, sf_dir))


@query(sql(_PACKED, select="SELECT count(*) FILTER (len(g)<>len(r)) AS dropped FROM fields"))
def annotation_mismatches(spark, sf_dir):
    return evidence.mismatched_probes(_packed(spark, sf_dir))


@query("""WITH a AS (SELECT p_partkey AS probe, CASE WHEN p_size%3=0 THEN '' WHEN p_size%3=1 THEN p_brand END AS regions, p_name AS genes FROM part WHERE p_partkey%5<>0), b AS (SELECT l_partkey AS probe, min(l_returnflag) AS regions, max(l_linestatus) AS genes FROM lineitem GROUP BY 1)
SELECT coalesce(a.probe,b.probe) AS probe, coalesce(nullif(a.regions,''),b.regions) AS regions, coalesce(nullif(a.genes,''),b.genes) AS genes FROM a FULL JOIN b ON a.probe=b.probe""")
def annotation_with_fallback(spark, sf_dir):
    size = F.col("p_size") % 3
    a = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("probe"), F.when(size == 0, "").when(size == 1, F.col("p_brand")).alias("regions"), F.col("p_name").alias("genes"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("probe")).agg(F.min("l_returnflag").alias("regions"), F.max("l_linestatus").alias("genes"))
    return evidence.annotation_or(a, b)


@query(sql("de", """coding AS (SELECT p_partkey AS gene FROM part WHERE p_size%2=0)""", """deC AS (SELECT de.* FROM de JOIN coding USING (gene))""",
    """x0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY abs(log2FC) DESC, padj, log2FC) AS k FROM deC WHERE log2FC IS NOT NULL AND padj<=0.05 AND abs(log2FC)>=0.1) WHERE k=1)""",
    select="SELECT gene, round((rank() OVER (ORDER BY abs(log2FC)) + (count(*) OVER (PARTITION BY abs(log2FC))-1)/2.0::DOUBLE)/count(*) OVER (),6)+0.0::DOUBLE AS expr_score, sign(log2FC)::DOUBLE AS expr_direction FROM x0"))
def coding_scores(spark, sf_dir):
    biotype = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") % 2 == 0, "protein_coding").otherwise("other").alias("biotype"))
    return evidence.expression_scores(evidence.coding_only(roles.de(spark, sf_dir), biotype), effect_cutoff=0.1)


@query(sql(_BARCODES, """n AS (SELECT *, right(barcode,1) || left(barcode,12) AS pos FROM b)""", """k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY substr(barcode,1,12), substr(barcode,14,2) ORDER BY barcode)=1)""", select="SELECT barcode, row_number() OVER (ORDER BY pos, barcode) AS place FROM k"))
def aliquots_in_order(spark, sf_dir):
    rows = _barcodes(spark, sf_dir).withColumn("pos", F.concat(F.substring("barcode", -1, 1), F.substring("barcode", 1, 12), "barcode"))
    kept = evidence.dedup_aliquots(rows, position="pos").select("barcode", "pos")
    return ranks.counted_values(kept, ["pos"]).join(kept, "pos").select("barcode", (F.col("n_before") + 1).alias("place"))


@query("SELECT DISTINCT p_brand||'.'||p_size AS id, p_brand AS stripped FROM part")
def version_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("id")).distinct()
    return rows.select("id", scalars.strip_version("id").alias("stripped"))


# networks, continued


@query(sql("interactions", """marked AS (SELECT CASE WHEN substr(source,2)::INTEGER%9=0 THEN 'COMP:'||source ELSE source END AS source, CASE WHEN substr(target,2)::INTEGER%11=0 THEN NULL WHEN substr(target,2)::INTEGER%11=1 THEN '' ELSE target END AS target, confidence FROM raw)""",
    select="SELECT * FROM marked WHERE source<>target AND target<>'' AND source NOT LIKE 'COMP:%' AND target NOT LIKE 'COMP:%'"))
def clean_endpoints(spark, sf_dir):
    number = lambda c: F.substring(c, 2, 20).cast("int")
    s = F.when(number("source") % 9 == 0, F.concat(F.lit("COMP:"), "source")).otherwise(F.col("source"))
    t = F.when(number("target") % 11 == 0, None).when(number("target") % 11 == 1, "").otherwise(F.col("target"))
    raw = roles.interactions(spark, sf_dir).select(s.alias("source"), t.alias("target"), "confidence")
    return network.clean_endpoints(raw, drop_complexes=True)


_ORDERS = """og AS (SELECT DISTINCT 2*o_custkey AS s, 2*(o_orderkey%(SELECT count(*)+o_custkey FROM customer))+1 AS t FROM orders WHERE o_totalprice>250000)"""


def _order_edges(spark, sf_dir):
    """Customers linked to the groups that their larger orders fall into: some thousands of nodes, many small components."""
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 250000").join(F.broadcast(n))
    return rows.select((2 * F.col("o_custkey")).alias("s"), (2 * (F.col("o_orderkey") % (F.col("n") + F.col("o_custkey"))) + 1).alias("t")).distinct()


_WALK = """e AS (SELECT s AS a, t AS b FROM og UNION SELECT t, s FROM og), walk(node, other) AS (SELECT a, b FROM e UNION SELECT walk.node, e.b FROM walk JOIN e ON walk.other=e.a)"""


@query("WITH RECURSIVE " + _ORDERS + ", " + _WALK + " SELECT node, least(node, min(other)) AS component FROM walk GROUP BY node")
def order_components(spark, sf_dir):
    return connected_components(_order_edges(spark, sf_dir), "s", "t")


@query("WITH RECURSIVE " + _ORDERS + ", " + _WALK + ", c AS (SELECT node, least(node, min(other)) AS component FROM walk GROUP BY node), z AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS n, min(component) AS first FROM z WHERE size>1 GROUP BY 1")
def component_sizes(spark, sf_dir):
    sizes = network.component_sizes(_order_edges(spark, sf_dir), "s", "t")
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("first"))


_ROUTES = """routes AS (SELECT least(c_nationkey,s_nationkey) AS a, greatest(c_nationkey,s_nationkey) AS b, min(o_totalprice+l_orderkey*1e-7) AS cost FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE c_nationkey<>s_nationkey GROUP BY 1,2)"""


@query("WITH RECURSIVE " + _ROUTES + """, placed AS (SELECT *, row_number() OVER (ORDER BY cost, a, b) AS k FROM routes), two AS (SELECT a AS x, b AS y, k FROM placed UNION ALL SELECT b, a, k FROM placed),
reach(a, b, lim, node) AS (SELECT a, b, k, a FROM placed UNION SELECT r.a, r.b, r.lim, two.y FROM reach r JOIN two ON two.x=r.node AND two.k<r.lim)
SELECT a, b, round(cost,3)+0.0::DOUBLE AS cost FROM routes WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.a=routes.a AND reach.b=routes.b AND reach.node=routes.b)""")
def spanning_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ends = rows.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b"))
    routes = ends.agg(F.min(F.col("o_totalprice") + F.col("l_orderkey") * 1e-7).alias("cost"))
    return solver.spanning_forest(routes).select("a", "b", F.round("cost", 3).alias("cost"))


@query("WITH RECURSIVE " + sql("interactions", "costs", "users", "prizes", """arcs AS (SELECT source AS a, target AS b, cost FROM edges UNION ALL SELECT target, source, cost FROM edges)""",
    """near(node, dist) USING KEY (node) AS (SELECT node, 0.0::DOUBLE FROM prizes WHERE prize>0.12 UNION (SELECT b, min(near.dist+arcs.cost) FROM near JOIN arcs ON arcs.a=near.node LEFT JOIN recurring.near AS known ON known.node=arcs.b WHERE known.dist IS NULL OR near.dist+arcs.cost<known.dist-1e-12 GROUP BY b))""",
    select="SELECT node, round(dist,6)+0.0::DOUBLE AS dist FROM near").removeprefix("WITH "))
def nearest_terminals(spark, sf_dir):
    edges, prizes = _forest_inputs(spark, sf_dir)
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "cost")
    return solver.nearest_terminal(ends, prizes.where("prize > 0.12").select("node")).select("node", "dist")


@query("WITH RECURSIVE " + sql("interactions", "costs", "users", "prizes", """arcs AS (SELECT source AS a, target AS b, cost FROM edges UNION ALL SELECT target, source, cost FROM edges)""",
    """far(src, node, dist) USING KEY (src, node) AS (SELECT node, node, 0.0::DOUBLE FROM prizes WHERE prize>0.12 UNION (SELECT far.src, b, min(far.dist+arcs.cost) FROM far JOIN arcs ON arcs.a=far.node LEFT JOIN recurring.far AS known ON known.src=far.src AND known.node=arcs.b WHERE far.dist+arcs.cost<=0.5 AND (known.dist IS NULL OR far.dist+arcs.cost<known.dist-1e-12) GROUP BY far.src, b))""",
    select="SELECT src, node, round(dist,6)+0.0::DOUBLE AS dist FROM far").removeprefix("WITH "))
def terminal_distances(spark, sf_dir):
    edges, prizes = _forest_inputs(spark, sf_dir)
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "cost")
    return solver.distance_table(ends, prizes.where("prize > 0.12").select("node"), radius=0.5).select("src", "node", "dist")


@query("SELECT DISTINCT p_partkey, nullif(p_brand,'Brand#11') AS symbol FROM part")
def first_symbol(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("external_gene_name"), "p_name").distinct()
    return parts.select("p_partkey", scalars.first_available(parts, ["gene_name", "external_gene_name"], F.col("p_name")).alias("symbol"))


@query(sql("interactions", "users", "seeds", "matrix", """inside AS (SELECT node FROM users WHERE clicks%3<>0)""", """m2 AS (SELECT * FROM m WHERE source IN (SELECT node FROM inside) AND target IN (SELECT node FROM inside))""", """w2 AS (SELECT source, target, w/sum(abs(w)) OVER (PARTITION BY target) AS w FROM m2)""",
    """g1 AS (SELECT target AS node, 0.5::DOUBLE*sum(w*state) AS state FROM seeds JOIN w2 ON node=source GROUP BY 1)""", """g2 AS (SELECT target AS node, 0.5::DOUBLE*sum(w*state) AS state FROM g1 JOIN w2 ON node=source GROUP BY 1)""",
    select="SELECT node, round(sum(state),6)+0.0::DOUBLE AS state FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY 1"))
def propagate_inside(spark, sf_dir):
    inside = roles.users(spark, sf_dir).where("clicks % 3 <> 0").select("node")
    return propagation.propagate(_matrix(spark, sf_dir), roles.seeds(spark, sf_dir), nodeset=inside, hops=2).select("node", "state")


@query("""WITH n AS (SELECT o_custkey, round(avg(o_totalprice),2) AS v FROM orders GROUP BY 1), o AS (SELECT round(avg(o_totalprice),2) AS obs FROM orders)
SELECT round((count(*) FILTER (v<=obs)+1)::DOUBLE/(count(*)+1),6)+0.0::DOUBLE AS p, round(avg(v),4)+0.0::DOUBLE AS null_mean, count(*) AS n FROM n, o""")
def empirical_p_lower(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    null = orders.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    out = propagation.empirical_p(orders.agg(F.round(F.avg("o_totalprice"), 2).alias("v")), null, "v", lower=True)
    return out.withColumn("null_mean", F.round("null_mean", 4))


# summaries of the reports


_CISROWS = "cis AS (SELECT gene, region, round(delta_beta*10,6) AS rho, padj FROM dmr WHERE delta_beta IS NOT NULL)"


def _cis(spark, sf_dir):
    return roles.dmr(spark, sf_dir).where("delta_beta is not null").select("gene", "region", F.round(F.col("delta_beta") * 10, 6).alias("rho"), "padj")


@query(sql("dmr", _CISROWS, select="SELECT region, count(*) AS genes, round(avg((rho<0)::INTEGER),6)+0.0::DOUBLE AS share_negative, count(*) FILTER (rho<-0.2 AND padj<0.05) AS strong_negative, count(*) FILTER (rho>0.2 AND padj<0.05) AS strong_positive, round(median(rho),6)+0.0::DOUBLE AS median_rho FROM cis GROUP BY 1"))
def region_summary(spark, sf_dir):
    return summaries.region_summary(_cis(spark, sf_dir))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2")
def cross_table(spark, sf_dir):
    return summaries.cross_table(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(sql("de", "dmr", "meth", _CISROWS, """inside AS (SELECT gene FROM de WHERE abs(log2FC)<0.5)""",
    select="SELECT gene AS node, round(-prom_direction*prom_score,6)+0.0::DOUBLE AS state FROM meth WHERE prom_direction IS NOT NULL AND prom_score IS NOT NULL AND gene IN (SELECT gene FROM inside) AND gene IN (SELECT gene FROM cis WHERE region='A' AND rho<-0.1 AND padj<0.25)"))
def seed_vector(spark, sf_dir):
    nodes = roles.de(spark, sf_dir).where("abs(log2FC) < 0.5").select(F.col("gene").alias("node"))
    return summaries.seed_vector(_meth(spark, sf_dir), nodes, _cis(spark, sf_dir).where("region = 'A'"))


@query(sql("de", "dmr", _REG, _ULM, """act AS (SELECT tf, round((cwy/cww)/sqrt((cyy-cwy*cwy/cww)/(n-2)/cww),9) AS activity FROM c)""", """j AS (SELECT activity AS x, delta_beta AS y FROM act JOIN dmr ON tf=gene WHERE region='R' AND delta_beta IS NOT NULL)""", _rank_sql({"rx": "x", "ry": "y"}, "j"),
    select="SELECT round(corr(rx,ry),6)+0.0::DOUBLE AS rho, count(*) AS n FROM k"))
def activity_against_promoter(spark, sf_dir):
    act = regulon.activity(_regulon(spark, sf_dir), roles.de(spark, sf_dir).select("gene", F.col("log2FC").alias("y"))).withColumn("activity", F.round("activity", 9))
    return summaries.activity_against(act, roles.dmr(spark, sf_dir).where("region = 'R'"), "delta_beta")


_GRID = [(p, e) for p in (0.03, 0.04, 0.05) for e in (0.0, 0.1, 0.5, 9.0)]


@query(sql("de", "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({p}::DOUBLE, {e}::DOUBLE)" for p, e in _GRID) + ") v(padj_cutoff, effect_cutoff))",
    select="SELECT padj_cutoff, effect_cutoff, count(gene) AS n, count(gene) FILTER (log2FC>0) AS up, count(gene) FILTER (log2FC<0) AS down FROM grid LEFT JOIN de ON padj<=padj_cutoff AND abs(log2FC)>=effect_cutoff GROUP BY 1,2"))
def threshold_sweep(spark, sf_dir):
    return summaries.threshold_sweep(roles.de(spark, sf_dir), spark.createDataFrame(_GRID, "padj_cutoff double, effect_cutoff double"))


@query("SELECT l_shipmode_ AS flag, place AS flag_place, round(total,2)+0.0::DOUBLE AS total FROM (SELECT l_returnflag AS l_shipmode_, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END::BIGINT AS place, sum(l_quantity) AS total FROM lineitem WHERE l_linenumber=1 GROUP BY 1) WHERE place IS NOT NULL")
def grid_rows(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.col("l_returnflag").alias("flag")).agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    return summaries.grid_rows(results, "l_linenumber", 1, {"flag": ["R", "A"]}, ["total"])


@query(sql("dmr", _CISROWS, select="SELECT region, printf('%+.3f', round(median(rho),6)) AS median_rho, printf('%.0f%%', round(100*avg((rho<0)::INTEGER),6)) AS negative FROM cis GROUP BY 1"))
def figures_as_text(spark, sf_dir):
    rows = summaries.region_summary(_cis(spark, sf_dir)).select("region", F.round("median_rho", 6).alias("median_rho"), F.round(100 * F.col("share_negative"), 6).alias("negative"))
    return summaries.figures_as_text(rows, median_rho="%+.3f", negative="%.0f%%")


_SEEDS = """seed AS (SELECT gene AS node, -prom_direction*prom_score AS state FROM meth WHERE prom_direction IS NOT NULL AND prom_score IS NOT NULL)"""


@query(sql("de", "dmr", "meth", _CISROWS, _SEEDS, select=f"SELECT node, {r6('state')}, round(log2FC,6)+0.0::DOUBLE AS effect, round(de.padj,6)+0.0::DOUBLE AS de_padj, {r6('rho')}, round(cis.padj,6)+0.0::DOUBLE AS cis_padj FROM seed JOIN de ON de.gene=node JOIN cis ON cis.gene=node WHERE region='A' AND log2FC IS NOT NULL"))
def seed_evidence(spark, sf_dir):
    de = roles.de(spark, sf_dir)
    seeds = summaries.seed_vector(_meth(spark, sf_dir), de.select(F.col("gene").alias("node")))
    return summaries.seed_evidence(seeds, de, _cis(spark, sf_dir).where("region = 'A'"))


_BYFEATURE = """cells AS (SELECT l_suppkey AS k, o_custkey%40 AS patient, o_orderstatus AS g, avg(l_quantity) AS x, avg(l_discount) AS y FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_orderstatus IN ('O','F') GROUP BY 1,2,3),
deltas AS (SELECT k, patient, round(max(x) FILTER (g='O')-max(x) FILTER (g='F'),6) AS x, round(max(y) FILTER (g='O')-max(y) FILTER (g='F'),6) AS y FROM cells GROUP BY 1,2),
r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x)+(count(*) OVER (PARTITION BY k,x)-1)/2.0::DOUBLE AS rx, rank() OVER (PARTITION BY k ORDER BY y)+(count(*) OVER (PARTITION BY k,y)-1)/2.0::DOUBLE AS ry FROM deltas WHERE x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT k, count(*) AS n, count(*)*sum(rx*ry)-sum(rx)*sum(ry) AS c, count(*)*sum(rx*rx)-sum(rx)*sum(rx) AS vx, count(*)*sum(ry*ry)-sum(ry)*sum(ry) AS vy FROM r GROUP BY 1),
h AS (SELECT k, CASE WHEN n>=10 AND vx>1e-9 AND vy>1e-9 THEN c/(sqrt(vx)*sqrt(vy)) END AS rho, n, (n-2)::DOUBLE AS df FROM g)"""


@query(sql(_BYFEATURE, select=f"SELECT k, round(rho,4)+0.0::DOUBLE AS rho, n, round({_t_tail('(rho*sqrt(df)/sqrt(1-rho*rho))', 'df')},4)+0.0::DOUBLE AS p FROM h"))
def paired_cis_correlation(spark, sf_dir):
    """Correlation per supplier of the paired differences of two measures, with its p."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderstatus in ('O', 'F')")
    rows = rows.select(F.col("l_suppkey").alias("k"), (F.col("o_custkey") % 40).alias("patient"), F.when(F.col("o_orderstatus") == "O", "tumour").otherwise("normal").alias("grp"), "l_quantity", "l_discount")
    x, y = (regulon.paired_deltas(rows, "k", c).select("k", "patient", F.round("delta", 6).alias("value")) for c in ("l_quantity", "l_discount"))
    return rounded(regulon.with_spearman_p(regulon.cis_correlation(x, y, "k", "patient", least=10)).select("k", "rho", "n", "p"), 4)


# tables that go to files and come back through the library's readers


@query(sql("de", select=f"SELECT gene::VARCHAR AS gene, {r6('log2FC', 'padj')}, NULL::DOUBLE AS \"AveExpr\", NULL::DOUBLE AS t FROM de"))
def result_table(spark, sf_dir):
    """A result table as tab-separated text, with NA, read back typed; the columns that it lacks are NULL."""
    path = shared_dir(spark, "result-table")
    sources.write_tsv(roles.de(spark, sf_dir), path, na="NA")
    return sources.read_result(spark, path, "de")


@query("""SELECT p_partkey::VARCHAR AS id, '"'||p_name||'" of "'||p_brand AS symbol FROM part""")
def raw_quotes(spark, sf_dir):
    """Names with quotes in them, written and read as they are."""
    path = shared_dir(spark, "raw-quotes")
    named = F.concat(F.lit('"'), "p_name", F.lit('" of "'), "p_brand").alias("symbol")
    sources.write_tsv(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), named), path, quoting=False)
    return sources.read_tsv(spark, path, quoting=False)


@query(sql("de", select=f"SELECT gene, {r6('log2FC', 'padj')} FROM de"))
def ingest_cache(spark, sf_dir):
    """The second reading of a cache takes what the first has written."""
    path = shared_dir(spark, "ingest-cache")
    sources.cached(spark, path, lambda: roles.de(spark, sf_dir))
    return sources.cached(spark, path, lambda: roles.de(spark, sf_dir).where("false"))


@query(sql("de", "dmr", "expr", "meth", "prize_table", select=f"SELECT gene, {r6('prize', 'log2FC')} FROM prized JOIN de USING (gene)"))
def result_bundle(spark, sf_dir):
    """Two tables of the last version of a bundle, joined."""
    path = shared_dir(spark, "bundle")
    sources.write_bundle(spark, path, {"prizes": _prizes(spark, sf_dir).limit(0), "de": roles.de(spark, sf_dir).limit(0)}, {"version": 1})
    sources.write_bundle(spark, path, {"prizes": _prizes(spark, sf_dir), "de": roles.de(spark, sf_dir)}, {"version": 2})
    got, params = sources.read_bundle(spark, path, ["prizes", "de"])
    return got["prizes"].join(got["de"], "gene").where(F.lit(params["version"]) == 2).select("gene", "prize", "log2FC")


#: Priorities as samples: the first characters of their names.
_SAMPLES = ("1", "2", "3", "4", "5")


def _sample_files(spark, folder, rows, header):
    """The rows of each sample as files of their own, and the manifest that lists them, written and read again."""
    for s in _SAMPLES:
        rows.where(F.col("sample") == s).drop("sample").write.option("sep", "\t").option("header", header).csv(f"{folder}/files/s{s}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/files")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    listed = files.select(F.substring(part(-2), 2, 1).alias("id"), F.concat_ws("/", part(-2), part(-1)).alias("filename"), F.md5("content").alias("md5"), F.col("length").alias("size"), F.lit("validated").alias("state"))
    sources.write_tsv(listed, f"{folder}/manifest")
    return sources.read_manifest(spark, f"{folder}/manifest")


@query("SELECT left(o_orderpriority,1) AS sample, o_custkey::VARCHAR AS probe, round(avg(o_totalprice)/1000000,6)+0.0::DOUBLE AS beta FROM orders GROUP BY 1,2")
def sample_files(spark, sf_dir):
    """A file without a header for each sample, verified against the manifest and read in long form."""
    folder = shared_dir(spark, "sample-files")
    keys = [F.substring("o_orderpriority", 1, 1).alias("sample"), F.col("o_custkey").alias("probe")]
    rows = table(spark, sf_dir, "orders").groupBy(*keys).agg((F.avg("o_totalprice") / 1000000).alias("beta"))
    manifest = _sample_files(spark, folder, rows, False)
    return sources.ingest_samples(spark, f"{folder}/files", manifest).select("sample", "probe", "beta")


@query("SELECT left(o_orderpriority,1) AS sample, 'ENSG'||o_custkey AS gene_id, count(*) AS count FROM orders GROUP BY 1,2")
def sample_counts(spark, sf_dir):
    """A count table with a header and summary rows for each sample, read in long form."""
    folder = shared_dir(spark, "sample-counts")
    sample = F.substring("o_orderpriority", 1, 1).alias("sample")
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy(sample, F.concat(F.lit("ENSG"), "o_custkey").alias("gene_id")).agg(F.count(F.lit(1)).alias("unstranded"))
    rows = rows.unionByName(orders.groupBy(sample).agg(F.lit("N_unmapped").alias("gene_id"), F.count(F.lit(1)).alias("unstranded")))
    manifest = _sample_files(spark, folder, rows, True)
    return sources.ingest_sample_counts(spark, sources.verified(spark, f"{folder}/files", manifest), manifest)


@query("""SELECT 's'||left(o_orderpriority,1) AS id, CASE left(o_orderpriority,1) WHEN '2' THEN 'short' WHEN '3' THEN 'altered' WHEN '4' THEN 'missing' END AS fault, count(DISTINCT o_custkey) AS listed FROM orders GROUP BY 1,2""")
def manifest_faults(spark, sf_dir):
    """What a manifest that was altered in three ways lists of each sample's files: the fault that they are found with, and their rows."""
    folder = shared_dir(spark, "manifest-faults")
    rows = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("sample"), "o_custkey").distinct()
    manifest = _sample_files(spark, folder, rows, False)
    wrong = lambda s, c, x: F.when(F.col("id") == s, x).otherwise(F.col(c)).alias(c)
    manifest = manifest.select("id", wrong("4", "filename", F.concat(F.lit("gone-"), "filename")), wrong("3", "md5", F.md5("md5")), wrong("2", "size", F.col("size") + 1), "state")
    faults = sources.verify_manifest(spark, f"{folder}/files", manifest).select(F.concat(F.lit("s"), "id").alias("id"), "fault").distinct()
    return faults.join(rows.groupBy(F.concat(F.lit("s"), "sample").alias("id")).agg(F.count(F.lit(1)).alias("listed")), "id")


_GAMMA = lambda seed, shape, *keys: "(" + "+".join(f"-ln({scalars.uniform_sql(seed, *keys, str(i))})" for i in range(shape)) + ")"
_FAILS = "+".join(f"floor(ln({scalars.uniform_sql(5, 'p_partkey', str(i))})/ln(20.0::DOUBLE/25.0))" for i in range(5))


@query(f"""SELECT p_partkey, round({scalars.uniform_sql(1, 'p_partkey')},6)+0.0::DOUBLE AS uniform, round({scalars.normal_sql(2, 'p_partkey', 'p_brand')},6)+0.0::DOUBLE AS normal, round({_GAMMA(3, 4, 'p_partkey')},6)+0.0::DOUBLE AS gamma,
round({_GAMMA(9, 2, 'p_partkey')}/({_GAMMA(9, 2, 'p_partkey')}+{_GAMMA(10, 5, 'p_partkey')}),6)+0.0::DOUBLE AS beta, ({_FAILS})::BIGINT AS counts,
CASE WHEN {scalars.uniform_sql(6, 'p_partkey')}<0.25 THEN 'a' WHEN {scalars.uniform_sql(6, 'p_partkey')}<0.75 THEN 'b' ELSE 'c' END AS choice FROM part""")
def synthetic_measurements(spark, sf_dir):
    """A draw of every kind for each part, from its key alone."""
    drawn = {
        "uniform": scalars.uniform(1, "p_partkey"), "normal": scalars.normal(2, "p_partkey", "p_brand"), "gamma": scalars.gamma(3, 4, "p_partkey"), "beta": scalars.beta(4, 2, 5, "p_partkey"),
        "counts": scalars.negative_binomial(5, 5, 20.0, "p_partkey"), "choice": scalars.choice(6, ["a", "b", "c"], [1.0, 2.0, 1.0], "p_partkey"),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in drawn.items()])
