"""Agglomerative clustering, K sweeps and whole runs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.operators.agglomerative import agglomerative
from shoal.operators.micro import micro_clusters
from shoal.plans.analyze_k import analyze_k, k_sweep
from shoal.plans.batch import analyze_folder
from shoal.plans.grouped import preprocess_groups
from shoal.plans.preprocess import preprocess
from shoal.plans.report import Settings, analyze
from shoal.plans.train import run_clustering
from shoal.queries.clustering import embedded
from shoal.queries.registry import query, round_columns, rounded, table
from shoal.queries.tables import _correlation_sql
from shoal.session import scratch_path

# -- agglomerative: 25 nations described by their customers, and the embeddings -----------------


def nations(spark, sf_dir):
    """One vector per nation: mean and deviation of balances, and customers, of all customers."""
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("row_id")).agg(
        F.avg("c_acctbal").alias("a"), F.stddev_samp("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.select("row_id", F.array(F.col("a") / 100, F.col("s") / 100, F.col("n").cast("double")).alias("features"))


_NATIONS_SQL = """SELECT c_nationkey::BIGINT AS id, [avg(c_acctbal) / 100, stddev_samp(c_acctbal) / 100,
  count(*)::DOUBLE] AS f FROM customer GROUP BY c_nationkey"""

_EMBEDDED_SQL = "SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings"


def greedy_sql(source: str, linkage: str, k: int) -> str:
    """Greedy agglomeration down to ``k`` clusters: one merge of the closest pair per iteration.

    The recursion carries the pair linkages, updated by the recurrence of the linkage, and the
    label of every point. Ends with ``final (id, c)`` and ``merge (step, height)``.
    """
    joined = {"single": "min(e.h)", "complete": "max(e.h)",
              "average": "sum(e.h * e.ni) / sum(e.ni)",
              "ward": ("sqrt(greatest(0, (sum((e.ni + e.nj) * e.h * e.h) - any_value(e.nj) * any_value(m.h) * any_value(m.h))"
                       " / (any_value(m.ni + m.nj) + any_value(e.nj))))")}[linkage]
    return f"""p AS MATERIALIZED ({source}),
n AS (SELECT count(*) AS n FROM p),
tree(step, kind, i, j, h, ni, nj) AS (
  SELECT 0, 'pair', a.id, b.id, list_distance(a.f, b.f), 1.0::DOUBLE, 1.0::DOUBLE FROM p a JOIN p b ON a.id <> b.id
  UNION ALL SELECT 0, 'label', id, id, 0.0, 1.0, 1.0 FROM p
  UNION ALL (
    WITH t AS MATERIALIZED (SELECT * FROM tree WHERE kind <> 'merge'),
    m AS MATERIALIZED (SELECT i, j, h, ni, nj FROM t WHERE kind = 'pair' AND i < j ORDER BY h, i, j LIMIT 1),
    e AS (SELECT CASE WHEN t.i = m.j THEN m.i ELSE t.i END AS i, CASE WHEN t.j = m.j THEN m.i ELSE t.j END AS j,
      t.h, t.ni, t.nj, t.i IN (m.i, m.j) AS li, t.j IN (m.i, m.j) AS lj
      FROM t, m WHERE kind = 'pair' AND NOT (t.i IN (m.i, m.j) AND t.j IN (m.i, m.j))),
    half AS (SELECT e.i, e.j, {joined} AS h, any_value(m.ni + m.nj) AS ni, any_value(e.nj) AS nj
      FROM e, m WHERE li GROUP BY e.i, e.j),
    step AS (SELECT max(step) + 1 AS s FROM t)
    SELECT s, 'pair', i, j, h, ni, nj FROM e, step WHERE NOT li AND NOT lj
    UNION ALL SELECT s, 'pair', i, j, h, ni, nj FROM half, step
    UNION ALL SELECT s, 'pair', j, i, h, nj, ni FROM half, step
    UNION ALL SELECT s, 'label', t.i, CASE WHEN t.j = m.j THEN m.i ELSE t.j END, 0.0, 1.0, 1.0 FROM t, m, step WHERE kind = 'label'
    UNION ALL SELECT s, 'merge', m.i, m.j, m.h, m.ni, m.nj FROM m, step, n WHERE s <= n.n - {k}
  )),
final AS (SELECT i AS id, j AS c FROM tree, n WHERE kind = 'label' AND step = n.n - {k}),
merge AS (SELECT step, h AS height FROM tree WHERE kind = 'merge')"""


def _hac(spark, sf_dir, linkage):
    """Cluster and size of every nation cut at four, and the height of the last merge below the cut."""
    tree = agglomerative(nations(spark, sf_dir), linkage)
    return tree.cut([4], ["cluster"]).select("row_id", "cluster")


def _hac_sql(linkage: str) -> str:
    return f"""WITH RECURSIVE {greedy_sql(_NATIONS_SQL, linkage, 4)}
SELECT id AS row_id, (dense_rank() OVER (ORDER BY c) - 1)::INT AS cluster FROM final"""


for _linkage in ("ward", "complete", "average", "single"):
    query(f"hac_{_linkage}", _hac_sql(_linkage))(
        lambda spark, sf_dir, linkage=_linkage: _hac(spark, sf_dir, linkage))


@query("hac_heights", f"""WITH RECURSIVE {greedy_sql(_NATIONS_SQL, "ward", 1)}
SELECT round(height, 6) AS height FROM merge""")
def hac_heights(spark, sf_dir):
    return round_columns(agglomerative(nations(spark, sf_dir), "ward").merges.select("height"))


def _cut_sizes(labelled, ks):
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("cluster")) for k in ks]))
    return labelled.select(cells.alias("c")).groupBy("c.k", "c.cluster").agg(F.count(F.lit(1)).alias("n"))


@query("hac_embeddings")
def hac_embeddings(spark, sf_dir):
    """Cluster sizes of the ward tree over all embeddings, cut at 2 to 10."""
    tree = agglomerative(embedded(spark, sf_dir).select("row_id", "features"), "ward")
    return _cut_sizes(tree.cut(range(2, 11)), range(2, 11))


@query("hac_micro")
def hac_micro(spark, sf_dir):
    """Ward tree over 200 micro-clusters of all of lineitem, cut at 2 to 5."""
    rows = preprocess(table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")).rows
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "features")
    tree = agglomerative(rows, "ward", micro=200)
    return _cut_sizes(tree.cut(range(2, 6)), range(2, 6))


_MICRO = {"quantity": "l_quantity", "price": "l_extendedprice / 1000", "discount": "l_discount * 100", "tax": "l_tax * 100"}


@query("micro_clusters", "SELECT 200 AS parts, count(*) AS n, round("
       + " + ".join(f"var_pop({x}) * count(*)" for x in _MICRO.values()) + ", 3) AS inertia, "
       + ", ".join(f"round(avg({x}), 6) AS {name}" for name, x in _MICRO.items()) + " FROM lineitem")
def micro_clusters_query(spark, sf_dir):
    """200 clustering features of all of lineitem: their sizes, inertias inside and between, and means are those of the table."""
    rows = table(spark, sf_dir, "lineitem").select(F.array(*[F.expr(x).cast("double") for x in _MICRO.values()]).alias("features"))
    parts = micro_clusters(rows, 200).table(spark)
    total = parts.agg(F.sum("weight").alias("n"), *[(F.sum(F.col("weight") * F.col("features")[i]) / F.sum("weight")).alias(name)
                                                    for i, name in enumerate(_MICRO)])
    gap = sum((F.col("features")[i] - F.col(name)) * (F.col("features")[i] - F.col(name)) for i, name in enumerate(_MICRO))
    found = parts.crossJoin(F.broadcast(total)).groupBy("n", *_MICRO).agg(  # one row on each side but for 200 parts
        F.count("*").cast("int").alias("parts"), F.round(F.sum(F.col("inertia") + F.col("weight") * gap), 3).alias("inertia"))
    return found.select("parts", F.col("n").cast("long").alias("n"), "inertia", *[F.round(c, 6).alias(c) for c in _MICRO])


# -- choosing K and training ------------------------------------------------------------------------

@query("k_sweep")
def k_sweep_query(spark, sf_dir):
    """Every index of both models for K = 2 to 10 over all embeddings, two trials."""
    rows = embedded(spark, sf_dir).select("row_id", "features")
    return round_columns(k_sweep(rows, n_trials=2).curves)


@query("analyze_k")
def analyze_k_query(spark, sf_dir):
    """Best K per index of the last trial, and the agreed suggestion, over all embeddings."""
    found = analyze_k(embedded(spark, sf_dir).select("row_id", "features"))
    agreed = found.suggestion.agg(
        F.max(F.when(F.col("model") == "kmeans", F.col("k"))).alias("kmeans_k"),
        F.max(F.when(F.col("model") == "hierarchical", F.col("k"))).alias("hierarchical_k"))
    return found.detail.unionByName(agreed.select(F.lit("Suggested").alias("metric"), "*"))


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").drop("c_name")


@query("train_profile")
def train_profile(spark, sf_dir):
    """Profiles of three K-Means and three agglomerative clusters of all customers."""
    pre = preprocess(customers(spark, sf_dir), key="c_custkey")
    found = run_clustering(pre.rows.withColumnRenamed("c_custkey", "row_id"))
    return found.profile_kmeans.select(F.lit("kmeans").alias("model"), "*").unionByName(
        found.profile_hierarchical.select(F.lit("hierarchical").alias("model"), "*"))


@query("full_run_summary")
def full_run_summary(spark, sf_dir):
    """A whole run over the customers: quality of both models with the suggested K."""
    report = analyze(customers(spark, sf_dir), Settings(), "customer", key="c_custkey")
    k = F.when(F.col("model") == "K-Means", report.analysis.kmeans_k).otherwise(report.analysis.hierarchical_k)
    return round_columns(report.result.metrics.withColumn("k", k))


_CUSTOMER_RAW = "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_custkey % 2 = 0 AS even FROM customer"


@query("report_correlation", _correlation_sql(_CUSTOMER_RAW, ["c_custkey", "c_nationkey", "c_acctbal"]))
def report_correlation(spark, sf_dir):
    """The correlation table of a whole run: that of the raw columns, gaps and all, not of the encoded and scaled ones."""
    gone = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal")
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", gone, (F.col("c_custkey") % 2 == 0).alias("even"))
    return round_columns(analyze(raw, Settings(micro=50), "customer").tables["correlation"])


# -- many datasets ----------------------------------------------------------------------------------

_BATCH = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _batch_sql() -> str:
    parts = ", ".join(f"PARTITION BY l_returnflag" for _ in "x")
    z = ", ".join(f"abs(({c} - avg({c}) OVER ({parts})) / stddev_samp({c}) OVER ({parts})) AS z_{c}" for c in _BATCH)
    keep = " AND ".join(f"z_{c} < 3" for c in _BATCH)
    out = ", ".join(f"(({c} - avg({c}) OVER ({parts})) / stddev_pop({c}) OVER ({parts})) AS {c}" for c in _BATCH)
    shown = ", ".join(f"CASE WHEN abs({c}) < 5e-07 THEN 0.0 ELSE round({c}, 6) END AS {c}" for c in _BATCH)
    return f"""WITH z AS (SELECT *, {z} FROM lineitem), kept AS (SELECT * FROM z WHERE {keep}),
scaled AS (SELECT l_returnflag AS dataset, l_orderkey, {out} FROM kept)
SELECT dataset, l_orderkey, {shown} FROM scaled"""


@query("batch_preprocess", _batch_sql())
def batch_preprocess(spark, sf_dir):
    """The same preprocessing on one dataset per return flag, all in one job."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", *_BATCH)
    found = preprocess_groups(lines, "l_returnflag", key="l_orderkey")
    return round_columns(found.withColumnRenamed("l_returnflag", "dataset"))


@query("batch_run")
def batch_run(spark, sf_dir):
    """Whole runs over a folder of CSV files, with the ten trials of a batch: the suppliers with low and with high balances."""
    folder = scratch_path(spark, "batch")
    (table(spark, sf_dir, "supplier").drop("s_name", "s_suppkey")
     .withColumn("side", F.when(F.col("s_acctbal") < 4500, "low").otherwise("high"))
     .write.partitionBy("side").option("header", True).csv(folder))
    done = analyze_folder(spark, folder)
    return done.status.select(F.regexp_extract("dataset", "/side=([^/]+)/", 1).alias("dataset"), "status",
                              "error", "kmeans_k", "hierarchical_k")
