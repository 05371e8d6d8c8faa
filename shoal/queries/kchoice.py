"""Choosing K: curves of indices, elbow, votes and consensus.

The curves of these queries are aggregates of lineitem, so that both engines can derive them:
a trial per line number, a model per line status, and K from the part key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.operators.choose_k import best_k, consensus, k_detail, kneedle, voting_history, weighted_vote
from shoal.queries.registry import query, table

_K = range(2, 11)


def line_curves(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("trial"),
        F.when(F.col("l_linestatus") == "O", "kmeans").otherwise("hierarchical").alias("model"),
        (F.col("l_partkey") % 9 + 2).cast("int").alias("k"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    grouped = lines.groupBy("trial", "model", "k").agg(
        F.avg("l_discount").alias("silhouette"), F.stddev_samp("l_tax").alias("davies_bouldin"),
        F.sum("l_extendedprice").alias("calinski_harabasz"))
    indices = grouped.select("trial", "model", "k", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("silhouette", "davies_bouldin", "calinski_harabasz")])).alias("m")).select(
        "trial", "model", "k", "m.metric", "m.value")
    inertia = line_inertia(spark, sf_dir).withColumn("metric", F.lit("inertia"))
    return indices.unionByName(inertia)


def line_inertia(spark, sf_dir):
    """Falling curve per line number: price of the lines of at least 5 (k - 2) units, times tax."""
    lines = table(spark, sf_dir, "lineitem")
    sums = [F.sum(F.when(F.col("l_quantity") >= 5 * (k - 2), F.col("l_extendedprice") / F.col("l_quantity")
                         * F.pow(F.col("l_tax") * 10 + 0.3, F.lit(float(k))))).alias(f"v{k}") for k in _K]
    curve = lines.groupBy(F.col("l_linenumber").alias("trial")).agg(*sums)
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("value")) for k in _K]))
    return curve.select("trial", F.lit("kmeans").alias("model"), points.alias("p")).select(
        "trial", "model", "p.k", "p.value")


_INERTIA_SQL = " UNION ALL ".join(
    f"SELECT l_linenumber AS trial, 'kmeans' AS model, {k} AS k, sum(CASE WHEN l_quantity >= {5 * (k - 2)} "
    f"THEN l_extendedprice / l_quantity * pow(l_tax * 10 + 0.3, {k}) END) AS value FROM lineitem "
    f"GROUP BY l_linenumber" for k in _K)

_CURVES_SQL = f"""g AS (SELECT l_linenumber AS trial,
  CASE WHEN l_linestatus = 'O' THEN 'kmeans' ELSE 'hierarchical' END AS model,
  (l_partkey % 9 + 2)::INT AS k, avg(l_discount) AS s, stddev_samp(l_tax) AS d, sum(l_extendedprice) AS c
  FROM lineitem GROUP BY 1, 2, 3),
inertia AS ({_INERTIA_SQL})"""

_KNEE_SQL = """scaled AS (SELECT trial, k, (k - 2) / 8.0::DOUBLE AS x,
  (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS y FROM inertia WINDOW w AS (PARTITION BY trial)),
dist AS (SELECT trial, k, max(y) OVER (PARTITION BY trial) - y - x AS d FROM scaled),
near AS (SELECT *, lag(d) OVER w AS b, lead(d) OVER w AS n FROM dist WINDOW w AS (PARTITION BY trial ORDER BY k)),
kind AS (SELECT *, (b IS NULL OR d >= b) AND (n IS NULL OR d >= n) AS peak,
  (b IS NULL OR d <= b) AND (n IS NULL OR d <= n) AS dip FROM near),
walk AS (SELECT trial, k, n,
  last_value(CASE WHEN dip THEN 0.0 WHEN peak THEN d - 1.0 / 8 END IGNORE NULLS) OVER w AS threshold,
  last_value(CASE WHEN peak THEN k END IGNORE NULLS) OVER w AS crest
  FROM kind WINDOW w AS (PARTITION BY trial ORDER BY k ROWS UNBOUNDED PRECEDING)),
knee AS (SELECT t.trial, min_by(crest, k) AS knee FROM (SELECT DISTINCT trial FROM inertia) t
  LEFT JOIN walk ON walk.trial = t.trial AND n < threshold AND crest IS NOT NULL GROUP BY t.trial)"""

_BEST_SQL = f"""{_CURVES_SQL}, {_KNEE_SQL},
best AS (SELECT trial, model, 'silhouette' AS metric, first(k ORDER BY s DESC, k) AS best_k FROM g GROUP BY trial, model
  UNION ALL SELECT trial, model, 'davies_bouldin', first(k ORDER BY d, k) FROM g GROUP BY trial, model
  UNION ALL SELECT trial, model, 'calinski_harabasz', first(k ORDER BY c DESC, k) FROM g GROUP BY trial, model
  UNION ALL SELECT trial, 'kmeans', 'elbow', coalesce(knee, 2) FROM knee)"""

_VOTES_SQL = f"""{_BEST_SQL},
ballot AS (SELECT trial, model, best_k AS k, sum(CASE metric WHEN 'silhouette' THEN 2 WHEN 'davies_bouldin' THEN 2
  ELSE 1 END) AS votes, min(CASE metric WHEN 'silhouette' THEN 0 WHEN 'davies_bouldin' THEN 1
  WHEN 'calinski_harabasz' THEN 2 ELSE 3 END) AS place FROM best GROUP BY 1, 2, 3),
vote AS (SELECT trial, model, first(k ORDER BY votes DESC, place)::INT AS k, max(votes)::BIGINT AS votes
  FROM ballot GROUP BY trial, model)"""


@query("kneedle", f"WITH inertia AS ({_INERTIA_SQL}), {_KNEE_SQL} SELECT trial, knee::INT AS knee FROM knee")
def kneedle_query(spark, sf_dir):
    return kneedle(line_inertia(spark, sf_dir), "k", "value", ["trial"])


@query("best_k", f"WITH {_BEST_SQL} SELECT trial, model, metric, best_k::INT AS best_k FROM best")
def best_k_query(spark, sf_dir):
    return best_k(line_curves(spark, sf_dir))


@query("weighted_vote", f"WITH {_VOTES_SQL} SELECT * FROM vote")
def weighted_vote_query(spark, sf_dir):
    return weighted_vote(best_k(line_curves(spark, sf_dir)))


@query("voting_history", f"""WITH {_VOTES_SQL} SELECT trial, max(CASE WHEN model = 'kmeans' THEN k END) AS kmeans_k,
  max(CASE WHEN model = 'hierarchical' THEN k END) AS hierarchical_k FROM vote GROUP BY trial""")
def voting_history_query(spark, sf_dir):
    return voting_history(weighted_vote(best_k(line_curves(spark, sf_dir))))


@query("consensus_k", f"""WITH {_VOTES_SQL},
tally AS (SELECT model, k, count(*) AS trials, min(trial) AS earliest FROM vote GROUP BY model, k)
SELECT model, first(k ORDER BY trials DESC, earliest) AS k, max(trials) AS trials FROM tally GROUP BY model""")
def consensus_query(spark, sf_dir):
    return consensus(weighted_vote(best_k(line_curves(spark, sf_dir))))


@query("k_detail", f"""WITH {_BEST_SQL}
SELECT CASE metric WHEN 'silhouette' THEN 'Silhouette' WHEN 'davies_bouldin' THEN 'Davies-Bouldin'
  WHEN 'calinski_harabasz' THEN 'Calinski-Harabasz' ELSE 'Elbow' END AS metric,
  max(CASE WHEN model = 'kmeans' THEN best_k END)::INT AS kmeans_k,
  max(CASE WHEN model = 'hierarchical' THEN best_k END)::INT AS hierarchical_k
FROM best WHERE trial = (SELECT max(trial) FROM g) GROUP BY best.metric""")
def k_detail_query(spark, sf_dir):
    return k_detail(best_k(line_curves(spark, sf_dir)))
