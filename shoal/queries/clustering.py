"""Quality indices, K-Means, PCA and agglomerative clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shoal.operators.columns import assemble
from shoal.operators.kmeans import assign_nearest, kmeans, lloyd
from shoal.operators.pca import pca, projection
from shoal.operators.quality import calinski_harabasz, davies_bouldin, score, silhouette
from shoal.operators.cleaning import scale
from shoal.queries.registry import query, round_columns, rounded_sql, table


def embedded(spark, sf_dir):
    """embeddings with DOUBLE features."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def scaled_lines(spark, sf_dir):
    """lineitem: four standardised measures and the coded return flag and line number."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linenumber")
    rows = assemble(scale(lines, "standard", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
                    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.select("features", F.ascii("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))


# -- quality -----------------------------------------------------------------------------

def silhouette_sql(source: str) -> str:
    """Exact silhouette of ``source`` (id, f, label): CTEs up to ``point`` (id, label, s)."""
    return f"""p AS MATERIALIZED ({source}),
size_of AS (SELECT label, count(*) AS n FROM p GROUP BY label),
d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.f, b.f)) AS total
  FROM p a, p b GROUP BY a.id, a.label, b.label),
m AS (SELECT d.id, d.label, d.other, n, total / CASE WHEN d.label = d.other THEN greatest(n - 1, 1) ELSE n END AS mean
  FROM d JOIN size_of s ON s.label = d.other),
ab AS (SELECT id, label, max(CASE WHEN label = other THEN mean END) AS a,
  min(CASE WHEN label <> other THEN mean END) AS b, max(CASE WHEN label = other THEN n END) AS n
  FROM m GROUP BY id, label),
point AS (SELECT id, label, CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0
  ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


def moments_sql(source: str) -> str:
    """Cluster sizes, centres and spreads of ``source`` (f, label)."""
    return f"""p AS ({source}), e AS (SELECT label, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM p),
c AS (SELECT label, list(v ORDER BY i) AS f FROM (SELECT label, i, avg(v) AS v FROM e GROUP BY label, i) GROUP BY label),
g AS (SELECT list(v ORDER BY i) AS f FROM (SELECT i, avg(v) AS v FROM e GROUP BY i)),
w AS (SELECT p.label, count(*) AS n, avg(list_distance(p.f, c.f)) AS s,
  sum(power(list_distance(p.f, c.f), 2)) AS ss FROM p JOIN c USING (label) GROUP BY p.label),
db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT a.label, max((wa.s + wb.s) / list_distance(a.f, b.f)) AS r
  FROM c a JOIN c b ON a.label <> b.label JOIN w wa ON wa.label = a.label JOIN w wb ON wb.label = b.label
  GROUP BY a.label)),
ch AS (SELECT (sum(n * power(list_distance(c.f, g.f), 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*)))
  AS calinski_harabasz FROM w JOIN c USING (label), g)"""


_EMBEDDED = "SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings"


@query("silhouette_exact", f"""WITH {silhouette_sql(_EMBEDDED)}
SELECT 'label' AS model, count(*) AS n, {rounded_sql('avg(s)')} AS silhouette FROM point""")
def silhouette_exact(spark, sf_dir):
    found = silhouette(embedded(spark, sf_dir), ["label"])
    return round_columns(found.groupBy("model").agg(
        F.sum("n").alias("n"), (F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("silhouette")))


@query("silhouette_by_cluster", f"""WITH {silhouette_sql(_EMBEDDED)}
SELECT 'label' AS model, label AS cluster, count(*) AS n, {rounded_sql('avg(s)')} AS silhouette
FROM point GROUP BY label""")
def silhouette_by_cluster(spark, sf_dir):
    return round_columns(silhouette(embedded(spark, sf_dir), ["label"]))


_SUPPLIED = """SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice / 10] AS f,
  ascii(p_type) AS label FROM part"""


@query("silhouette_parts", f"""WITH {silhouette_sql(_SUPPLIED)}
SELECT 'label' AS model, label AS cluster, count(*) AS n, {rounded_sql('avg(s)')} AS silhouette
FROM point GROUP BY label""")
def silhouette_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 10).alias("features"),
        F.ascii("p_type").alias("label"))
    return round_columns(silhouette(parts, ["label"]))


_LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SCALED_LINES = ("SELECT [" + ", ".join(f"({c} - a_{c}) / b_{c}" for c in _LINES)
                 + "] AS f, ascii(l_returnflag) AS label FROM lineitem, (SELECT "
                 + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in _LINES) + " FROM lineitem)")


@query("davies_bouldin", f"""WITH {moments_sql(_SCALED_LINES)}
SELECT 'flag' AS model, round(davies_bouldin, 4) AS davies_bouldin FROM db""")
def davies_bouldin_query(spark, sf_dir):
    return round_columns(davies_bouldin(scaled_lines(spark, sf_dir), ["flag"]), 4)


@query("calinski_harabasz", f"""WITH {moments_sql(_SCALED_LINES)}
SELECT 'flag' AS model, round(calinski_harabasz, 6) AS calinski_harabasz FROM ch""")
def calinski_harabasz_query(spark, sf_dir):
    return round_columns(calinski_harabasz(scaled_lines(spark, sf_dir), ["flag"]))


def _metrics_sql(model: str, label: str) -> str:
    source = f"SELECT vec_id AS id, embedding::DOUBLE[] AS f, {label} AS label FROM embeddings"
    return f"""(WITH {moments_sql(source)}, q AS (WITH {silhouette_sql(source)} SELECT avg(s) AS silhouette FROM point)
SELECT '{model}' AS model, round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin,
  round(calinski_harabasz, 6) AS calinski_harabasz FROM q, db, ch)"""


@query("metric_table", _metrics_sql("label", "label") + " UNION ALL " + _metrics_sql("half", "label // 2"))
def metric_table(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("half", F.floor(F.col("label") / 2).cast("int"))
    return round_columns(score(rows, ["label", "half"]))


# -- K-Means --------------------------------------------------------------------------------

@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    """Sizes and centres of five clusters of lineitem."""
    rows = scaled_lines(spark, sf_dir)
    fit = kmeans(rows, 5)
    sizes = fit.assign(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    centres = spark.createDataFrame(
        [(i, [float(v) for v in c], fit.inertia) for i, c in enumerate(fit.centres)],
        "label int, centre array<double>, inertia double")
    return sizes.join(F.broadcast(centres), "label")


def _lloyd_sql(k: int, steps: int) -> str:
    ctes = [f"p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings)",
            f"c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS c, f FROM p ORDER BY id LIMIT {k})"]
    for t in range(steps + 1):
        ctes.append(f"""a{t} AS (SELECT id, any_value(p.f) AS f, min_by(c, (list_distance(p.f, x.f), c)) AS c
  FROM p, c{t} x GROUP BY id)""")
        if t < steps:
            ctes.append(f"""c{t + 1} AS (SELECT x.c, coalesce(n.f, x.f) AS f FROM c{t} x LEFT JOIN (
  SELECT c, list(v ORDER BY i) AS f FROM (SELECT c, i, avg(v) AS v FROM (
    SELECT c, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM a{t}) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return "WITH " + ", ".join(ctes) + f"""
SELECT a.c AS label, count(*) AS n, round(sum(power(list_distance(a.f, x.f), 2)), 6) AS inertia,
  round(any_value(x.f[1]), 6) AS x0, round(any_value(x.f[64]), 6) AS x63
FROM a{steps} a JOIN c{steps} x USING (c) GROUP BY a.c"""


@query("kmeans_lloyd", _lloyd_sql(5, 4))
def kmeans_lloyd(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    start = [r["features"] for r in rows.orderBy("row_id").limit(5).collect()]
    centres = lloyd(rows, start, 4)
    table_ = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)],
                                   "label int, centre array<double>")
    labelled = assign_nearest(rows.select("features"), [centres], ["label"]).join(F.broadcast(table_), "label")
    gap = F.aggregate(F.zip_with("features", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                      lambda s, v: s + v)
    return round_columns(labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(gap).alias("inertia"),
        F.first(F.col("centre")[0]).alias("x0"), F.first(F.col("centre")[63]).alias("x63")))


# -- PCA ----------------------------------------------------------------------------------------

def _pca2_sql() -> str:
    def fixed(x, y):  # unit loadings with the larger entry positive
        return (f"CASE WHEN abs({x}) >= abs({y}) THEN sign({x}) ELSE sign({y}) END / sqrt({x} * {x} + {y} * {y})")
    return f"""p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity AS x,
  l_quantity * 0.5 + l_linenumber * 4 AS y FROM lineitem),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p),
l AS (SELECT *, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS v1 FROM m),
q AS (SELECT *, {fixed('b', '(v1 - a)')} AS n1, {fixed('(a - v1)', 'b')} AS n2 FROM l),
s AS (SELECT p.*, ((x - mx) * b + (y - my) * (v1 - a)) * n1 AS pc1,
  ((x - mx) * (a - v1) + (y - my) * b) * n2 AS pc2 FROM p, q)"""


def _two_columns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.array("l_quantity", F.col("l_quantity") * 0.5 + F.col("l_linenumber") * 4).alias("features"))


@query("pca_2col", f"""WITH {_pca2_sql()} SELECT l_orderkey, l_linenumber,
  {rounded_sql('pc1')} AS pc1, {rounded_sql('pc2')} AS pc2 FROM s""")
def pca_2col(spark, sf_dir):
    return round_columns(pca(_two_columns(spark, sf_dir), keep=["l_orderkey", "l_linenumber"]).scores)


@query("projection", f"""WITH {_pca2_sql()} SELECT l_orderkey, ascii(l_returnflag) AS kmeans,
  ascii(l_linestatus) AS hierarchical, {rounded_sql('pc1')} AS pc1, {rounded_sql('pc2')} AS pc2 FROM s""")
def projection_query(spark, sf_dir):
    rows = _two_columns(spark, sf_dir).select(
        "l_orderkey", "features", F.ascii("l_returnflag").alias("kmeans"),
        F.ascii("l_linestatus").alias("hierarchical"))
    return round_columns(projection(rows, ["kmeans", "hierarchical"], key="l_orderkey"))


@query("pca_eigenvalues", """WITH p AS (SELECT l_quantity AS x, l_quantity * 0.5 + l_linenumber * 4 AS y,
  l_discount * 100 + l_linenumber AS z FROM lineitem),
m AS (SELECT var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d,
  covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM p),
q AS (SELECT *, (a + b + c) / 3 AS t, d * d + e * e + f * f AS o FROM m),
r AS (SELECT *, sqrt((power(a - t, 2) + power(b - t, 2) + power(c - t, 2) + 2 * o) / 6) AS s FROM q),
u AS (SELECT *, acos(greatest(-1, least(1, (((a - t) * ((b - t) * (c - t) - f * f) - d * (d * (c - t) - f * e)
  + e * (d * f - (b - t) * e)) / (s * s * s)) / 2))) / 3 AS g FROM r),
v AS (SELECT t + 2 * s * cos(g) AS v1, t + 2 * s * cos(g + 2 * pi() / 3) AS v3, t FROM u)
SELECT 1 AS component, round(v1, 6) AS variance FROM v UNION ALL
SELECT 2, round(3 * t - v1 - v3, 6) FROM v UNION ALL SELECT 3, round(v3, 6) FROM v""")
def pca_eigenvalues(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array(
        "l_quantity", F.col("l_quantity") * 0.5 + F.col("l_linenumber") * 4,
        F.col("l_discount") * 100 + F.col("l_linenumber")).alias("features"))
    found = pca(rows, keep=[]).variances
    return round_columns(spark.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(found)], "component int, variance double"))
