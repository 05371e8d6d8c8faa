"""The paths for large tables, forced by low thresholds, and fits of groups that any right fit must separate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shoal.operators.agglomerative import agglomerative
from shoal.operators.cleaning import impute, label_encode
from shoal.operators.kmeans import kmeans, kmeans_many
from shoal.operators.pca import pca_groups, projection
from shoal.operators.quality import adjusted_rand, score, silhouette_squared
from shoal.operators.statistics import correlation_matrix
from shoal.plans.analyze_k import analyze_k
from shoal.plans.group_fits import fit_groups
from shoal.plans.train import run_clustering
from shoal.queries.registry import ORACLES, query, round_columns, rounded_sql, table
from shoal.queries.clustering import _SCALED_LINES, moments_sql, scaled_lines, silhouette_sql
from shoal.queries.runs import _hac_sql, nations
from shoal.queries.tables import _correlation_sql, gappy_lineitem, preprocess_apply
from shoal.session import scratch_path
from shoal.sources.csv import load_csv_tables

# -- the same answers on the paths of large tables ----------------------------------------------------


@query("impute_median_narrowed", ORACLES["impute_median"])
def impute_median_narrowed(spark, sf_dir):
    """Exact medians by narrowing brackets: no task may hold more than 1,000 values."""
    gaps = gappy_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return round_columns(impute(gaps, "median", median_rows=1000))


@query("label_encode_ranges", ORACLES["label_encode"])
def label_encode_ranges(spark, sf_dir):
    """Vocabularies numbered by ranges and joined, hot values apart."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return label_encode(parts, max_values=5, window_values=50)[0]


for _linkage in ("ward", "complete", "average"):
    @query(f"hac_{_linkage}_rounds", _hac_sql(_linkage))
    def hac_rounds(spark, sf_dir, linkage=_linkage):
        """Merge rounds down to three clusters, in blocks of eight points."""
        tree = agglomerative(nations(spark, sf_dir), linkage, last_clusters=3, block_rows=8)
        return tree.cut([4], ["cluster"]).select("row_id", "cluster")


@query("hac_pruned", """WITH p AS (SELECT DISTINCT avg(l_extendedprice) / 1000 AS x, avg(l_quantity) AS y FROM lineitem GROUP BY l_partkey)
SELECT count(*) - 1 AS merges, round(count(*) * (var_pop(x) + var_pop(y)), 3) AS inertia, TRUE AS most_skipped FROM p""")
def hac_pruned(spark, sf_dir):
    """The ward tree over all ordered parts in about 64 blocks, round by round down to half of them. Half of the squared heights
    adds up to the inertia of the points, and less than half of the pairs were compared."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("row_id")).agg(
        F.avg("l_extendedprice").alias("x"), F.avg("l_quantity").alias("y"))
    points = means.groupBy((F.col("x") / 1000).alias("x"), "y").agg(F.min("row_id").alias("row_id"))
    n = points.count()
    tree = agglomerative(points.select("row_id", F.array("x", "y").alias("features")), "ward", last_clusters=n // 2, block_rows=-(-n // 64))
    skipped = tree.search.compared < 0.5 * tree.search.possible
    return tree.merges.agg(F.count("*").alias("merges"), F.round(F.sum(F.col("height") * F.col("height")) / 2, 3).alias("inertia")).withColumn(
        "most_skipped", F.lit(skipped))


_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_gaps_wide", _correlation_sql("""SELECT l_orderkey, l_partkey, l_linenumber, l_discount,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_linenumber = 3 AND l_orderkey % 100 = 7 THEN 1e12 ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_suppkey END AS l_suppkey,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax FROM lineitem""", _WIDE))
def correlation_gaps_wide(spark, sf_dir):
    """Eight columns with gaps; the huge prices stand where the quantity is missing."""
    line, lines = F.col("l_linenumber"), table(spark, sf_dir, "lineitem").select(*_WIDE)
    lines = lines.withColumns({
        "l_quantity": F.when(line != 3, F.col("l_quantity")), "l_suppkey": F.when(line != 5, F.col("l_suppkey")),
        "l_tax": F.when(line != 2, F.col("l_tax")),
        "l_extendedprice": F.when((line == 3) & (F.col("l_orderkey") % 100 == 7), F.lit(1e12)).otherwise(F.col("l_extendedprice"))})
    return round_columns(correlation_matrix(lines))


@query("scan_folder_headers", """SELECT l_linestatus AS side, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
  round(sum(l_discount), 2) AS discount, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_linestatus""")
def scan_folder_headers(spark, sf_dir):
    """One folder per line status, each with its own order of columns; read as one table."""
    folder, lines = scratch_path(spark, "headers"), table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_discount", "l_linenumber", "l_linestatus"]
    for i, side in enumerate(sorted(r[0] for r in lines.select("l_linestatus").distinct().collect())):
        order = names[i % len(names):] + names[:i % len(names)]
        lines.where(F.col("l_linestatus") == side).select(*order).write.option("header", True).csv(f"{folder}/part{i}")
    back = load_csv_tables(spark, folder)
    return back.groupBy(F.col("l_linestatus").alias("side")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum("l_discount"), 2).alias("discount"), F.sum("l_linenumber").alias("lines"))


_MANY_SQL = "SELECT [p_size::DOUBLE, p_partkey / 10] AS f, p_partkey // 5 AS label FROM part"


@query("quality_many", f"""WITH {moments_sql(_MANY_SQL)}
SELECT 'label' AS model, {rounded_sql('davies_bouldin')} AS davies_bouldin, {rounded_sql('calinski_harabasz')} AS calinski_harabasz FROM db, ch""")
def quality_many(spark, sf_dir):
    """Indices of a labeling with a cluster for every five parts."""
    rows = table(spark, sf_dir, "part").select(
        F.array(F.col("p_size").cast("double"), F.col("p_partkey") / 10).alias("features"),
        F.expr("CAST(p_partkey DIV 5 AS INT)").alias("label"))
    return round_columns(score(rows, ["label"], silhouette=None).drop("silhouette"))


_EACH_SQL = "SELECT [l_quantity, l_discount * 100, l_tax * 100] AS f, l_partkey AS label FROM lineitem"


@query("quality_tables", f"""WITH {moments_sql(_EACH_SQL)}
SELECT 'part' AS model, {rounded_sql('davies_bouldin', 4)} AS davies_bouldin, {rounded_sql('calinski_harabasz', 4)} AS calinski_harabasz FROM db, ch""")
def quality_tables(spark, sf_dir):
    """Indices of all of lineitem with a cluster for every part, whose centres are never collected."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("features"), F.col("l_partkey").cast("int").alias("part"))
    return round_columns(score(rows, ["part"], silhouette=None, centre_values=0).drop("silhouette"), 4)


# -- groups far apart ------------------------------------------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_APART_SQL = ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN {1000.0 + 100 * i} ELSE 0.0 END" for i, s in enumerate(_SEGMENTS))
_CUSTOMERS_SQL = f"SELECT c_custkey AS id, c_mktsegment AS label, [{_APART_SQL}, c_acctbal / 1000] AS f FROM customer"


def segments(spark, sf_dir):
    """Customers whose market segments lie far apart; the balance is the only spread inside one."""
    far = [F.when(F.col("c_mktsegment") == s, F.lit(1000.0 + 100 * i)).otherwise(F.lit(0.0)) for i, s in enumerate(_SEGMENTS)]
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("row_id"), F.array(*far, F.col("c_acctbal").cast("double") / 1000).alias("features"),
        F.struct(F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("kmeans")).alias("profile"),
        "c_mktsegment")


@query("kmeans_segments", """SELECT c_mktsegment AS lo, c_mktsegment AS hi, count(*) AS n, round(avg(c_acctbal / 1000), 6) AS balance
FROM customer GROUP BY c_mktsegment""")
def kmeans_segments(spark, sf_dir):
    """A fit of five clusters is the five market segments."""
    rows = segments(spark, sf_dir)
    fit = kmeans(rows, 5)
    found = fit.assign(rows).groupBy("label").agg(F.min("c_mktsegment").alias("lo"), F.max("c_mktsegment").alias("hi"), F.count("*").alias("n"))
    centres = spark.createDataFrame([(i, round(float(c[-1]), 6)) for i, c in enumerate(fit.centres)], "label int, balance double")
    return found.join(F.broadcast(centres), "label").drop("label")


@query("kmeans_same_seed", """SELECT count(*) AS n, TRUE AS same_centres, TRUE AS same_inertia FROM lineitem""")
def kmeans_same_seed(spark, sf_dir):
    """K = 6 alone is the 6 of a sweep over 2 to 10."""
    rows = scaled_lines(spark, sf_dir).withColumn("row_id", F.xxhash64("features", "flag", "line"))
    alone, among = kmeans_many(rows, [6], [42], max_iter=20)[42, 6], kmeans_many(rows, range(2, 11), [42], max_iter=20)[42, 6]
    return rows.agg(F.count("*").alias("n")).select(
        "n", F.lit(bool(np.allclose(alone.centres, among.centres))).alias("same_centres"),
        F.lit(bool(np.isclose(alone.inertia, among.inertia))).alias("same_inertia"))


@query("hac_micro_segments", "SELECT k, c_mktsegment AS segment, count(*) AS n FROM customer, (SELECT unnest([5]) AS k) GROUP BY ALL")
def hac_micro_segments(spark, sf_dir):
    """A ward tree over 40 micro-clusters of all customers, cut at five: no cluster mixes two segments."""
    labelled = agglomerative(segments(spark, sf_dir), "ward", micro=40).cut([5])
    return labelled.groupBy("k5").agg(F.min("c_mktsegment").alias("segment"), F.countDistinct("c_mktsegment").alias("m"),
                                      F.count("*").alias("n")).where("m = 1").select(F.lit(5).alias("k"), "segment", "n")


def _squared_sql(source: str, by: str) -> str:
    """Silhouettes of squared distances of ``source`` (f1, f2, ..., label and ``by``), a column list in ``by``."""
    return source + f"""m AS (SELECT {by}, label, count(*) AS n, list(f) AS fs FROM p GROUP BY {by}, label),
c AS (SELECT {by}, label, n, [list_avg(list_transform(fs, lambda v: v[i])) FOR i IN range(1, len(fs[1]) + 1)] AS f FROM m),
w AS (SELECT {", ".join("p." + b for b in by.split(", "))}, p.label, sum(power(list_distance(p.f, c.f), 2)) / any_value(n) AS w FROM p JOIN c USING ({by}, label) GROUP BY ALL),
d AS (SELECT p.*, c.label AS other, c.n, power(list_distance(p.f, c.f), 2) + w.w AS d2 FROM p JOIN c USING ({by}) JOIN w ON w.label = c.label AND {" AND ".join(f"w.{b} = p.{b}" for b in by.split(", "))}),
ab AS (SELECT {by}, id, label, max(CASE WHEN label = other THEN d2 * n / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN d2 END) AS b FROM d GROUP BY {by}, id, label),
point AS (SELECT {by}, label, (b - a) / greatest(a, b) AS s FROM ab)"""


_LINES_SQL = _SCALED_LINES.replace("AS f, ascii", "AS f, 0 AS part, row_number() OVER () AS id, ascii")


@query("silhouette_squared", _squared_sql(f"WITH p AS ({_LINES_SQL}), ", "part") + """
SELECT 'flag' AS model, label AS cluster, count(*) AS n, """ + rounded_sql("avg(s)") + " AS silhouette FROM point GROUP BY label")
def silhouette_squared_query(spark, sf_dir):
    """Silhouettes of squared distances of all of lineitem by return flag, without a pair of rows."""
    return round_columns(silhouette_squared(scaled_lines(spark, sf_dir), ["flag"]))


_GROUPED_SQL = f"SELECT c_custkey AS id, c_mktsegment AS label, c_nationkey % 3 AS part, [{_APART_SQL}, c_acctbal / 1000] AS f FROM customer"


def _datasets(spark, sf_dir):
    """The market segments in three datasets, by nation."""
    nations_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), (F.col("c_nationkey") % 3).cast("int").alias("dataset"))
    return segments(spark, sf_dir).join(nations_, "row_id")


@query("batch_fits", """SELECT (c_nationkey % 3)::INT AS dataset, c_mktsegment AS lo, c_mktsegment AS hi, count(*) AS n, round(avg(c_acctbal / 1000), 6) AS balance
FROM customer GROUP BY ALL""")
def batch_fits(spark, sf_dir):
    """Fits of five clusters in three datasets at once: in each they are the market segments."""
    rows = _datasets(spark, sf_dir)
    found = fit_groups(rows, "dataset", [5])
    labelled = found.assign(rows, 5)
    return round_columns(labelled.groupBy("dataset", "label").agg(
        F.min("c_mktsegment").alias("lo"), F.max("c_mktsegment").alias("hi"), F.count("*").alias("n"),
        F.avg(F.element_at("features", -1)).alias("balance")).drop("label"))


@query("batch_scores", " UNION ALL ".join(f"""(WITH s AS ({_squared_sql(f"WITH p AS ({_GROUPED_SQL}), ", "part")} SELECT avg(s) AS v FROM point WHERE part = {g}),
{moments_sql(_GROUPED_SQL + f" WHERE c_nationkey % 3 = {g}")}
SELECT {g} AS dataset, {rounded_sql('s.v')} AS silhouette_squared, {rounded_sql('davies_bouldin')} AS davies_bouldin, round(calinski_harabasz, 0) AS calinski_harabasz FROM s, db, ch)"""
    for g in range(3)))
def batch_scores(spark, sf_dir):
    """The three indices of these fits."""
    curves = fit_groups(_datasets(spark, sf_dir), "dataset", [5]).curves
    names = ["silhouette_squared", "davies_bouldin", "calinski_harabasz"]
    wide = curves.groupBy(F.col("group").alias("dataset")).agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    return round_columns(wide.withColumn("calinski_harabasz", F.round("calinski_harabasz", 0)))


@query("batch_components", """WITH p AS (SELECT l_returnflag AS dataset, l_quantity AS x, l_discount * 100 + l_quantity / 10 AS y FROM lineitem),
m AS (SELECT dataset, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM p GROUP BY dataset)
SELECT dataset, i::INT AS component, round((a + c) / 2 + CASE WHEN i = 1 THEN 1 ELSE -1 END * sqrt(power((a - c) / 2, 2) + b * b), 6) AS variance
FROM m, (SELECT unnest([1, 2]) AS i)""")
def batch_components(spark, sf_dir):
    """Variances along the principal components of two measures, for every return flag by itself."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.array(
        "l_quantity", F.col("l_discount") * 100 + F.col("l_quantity") / 10).alias("features"))
    return round_columns(pca_groups(rows, "dataset").select(F.col("group").alias("dataset"), "component", "variance"))


@query("adjusted_rand", """WITH c AS (SELECT label AS l, vec_id % 3 + label // 2 AS r, count(*) AS n FROM embeddings GROUP BY ALL),
s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS b FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY l)),
y AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY r))
SELECT CAST(n AS BIGINT) AS n, round((b - x.a * y.a / (n * (n - 1) / 2)) / ((x.a + y.a) / 2 - x.a * y.a / (n * (n - 1) / 2)), 6) AS adjusted_rand FROM s, x, y""")
def adjusted_rand_query(spark, sf_dir):
    """Agreement of two labelings of all embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3 + F.floor(F.col("label") / 2)).alias("other"))
    return round_columns(adjusted_rand(rows, "label", "other"))


@query("projection_sample", """SELECT ascii(l_returnflag) AS kmeans, least(count(*), 500) AS n, least(count(*), 500) AS n_keys, least(count(*), 500) AS n_of_table
FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber FROM lineitem) GROUP BY l_returnflag""")
def projection_sample(spark, sf_dir):
    """500 projected rows of every return flag, each once and with the flag that the table has for it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    rows = lines.select((F.col("l_orderkey") * 1024 + F.col("l_linenumber") * 128 + F.ascii("l_returnflag")).alias("row_id"), F.array("q", F.col("t") * 100).alias("features"),
                        F.ascii("l_returnflag").alias("kmeans"))
    found = projection(rows, ["kmeans"], 2, sample=500)
    known = found.join(rows.select("row_id", F.col("kmeans").alias("flag")), "row_id", "left")
    return known.groupBy("kmeans").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_keys"), F.count_if(F.col("flag") == F.col("kmeans")).alias("n_of_table"))


@query("preprocess_reloaded", ORACLES["preprocess_apply"])
def preprocess_reloaded(spark, sf_dir):
    """The fitted preprocessing written as tables and read back before it is applied."""
    return preprocess_apply(spark, sf_dir, reload=True)


@query("hac_copies", """WITH r AS (SELECT c_custkey AS key, c_mktsegment AS s, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer),
alone AS (SELECT key FROM r WHERE i > 1 ORDER BY key LIMIT 4),
own AS (SELECT r.*, CASE WHEN i = 1 OR key IN (SELECT key FROM alone) THEN key ELSE min(key) OVER (PARTITION BY s) END AS c FROM r)
SELECT key AS row_id, (dense_rank() OVER (ORDER BY c) - 1)::INT AS cluster FROM own""")
def hac_copies(spark, sf_dir):
    """Five distinct points cut at nine: copies are split off by their smallest keys."""
    code = F.array_position(F.array(*[F.lit(s) for s in _SEGMENTS]), F.col("c_mktsegment")).cast("double")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), F.array(code, code * code).alias("features"))
    return agglomerative(rows, "average").cut([9], ["cluster"]).select("row_id", "cluster")


@query("analyze_segments", """SELECT count(DISTINCT c_mktsegment)::INT AS kmeans_k, count(DISTINCT c_mktsegment)::INT AS hierarchical_k, count(*) AS n FROM customer""")
def analyze_segments(spark, sf_dir):
    """Both models suggest as many clusters as there are segments."""
    rows = segments(spark, sf_dir)
    found = analyze_k(rows.select("row_id", "features"), ks=range(2, 9))
    return rows.agg(F.count("*").alias("n")).select(F.lit(found.kmeans_k).alias("kmeans_k"), F.lit(found.hierarchical_k).alias("hierarchical_k"), "n")


@query("train_segments", """SELECT m.model, round_even(avg(c_acctbal), 2) AS c_acctbal, round_even(avg(c_nationkey), 2) AS kmeans
FROM customer, (SELECT unnest(['kmeans', 'hierarchical']) AS model) m GROUP BY m.model, c_mktsegment""")
def train_segments(spark, sf_dir):
    """Profiles of five clusters by both models, with a profiled column that is named like a model."""
    found = run_clustering(segments(spark, sf_dir).select("row_id", "features", "profile"), 5, 5)
    return found.profile_kmeans.select(F.lit("kmeans").alias("model"), "*").unionByName(
        found.profile_hierarchical.select(F.lit("hierarchical").alias("model"), "*")).drop("cluster")


@query("train_metrics_segments", f"""WITH {silhouette_sql(_CUSTOMERS_SQL)},
{moments_sql(_CUSTOMERS_SQL).replace("p AS (", "p2 AS (", 1).replace("FROM p)", "FROM p2)").replace("FROM p JOIN", "FROM p2 p JOIN")}
SELECT m.model, {rounded_sql('s.v')} AS silhouette, {rounded_sql('davies_bouldin')} AS davies_bouldin, round(calinski_harabasz, 0) AS calinski_harabasz
FROM (SELECT avg(s) AS v FROM point) s, db, ch, (SELECT unnest(['K-Means', 'Hierarchical']) AS model) m""")
def train_metrics_segments(spark, sf_dir):
    """The three indices of both models on the segments."""
    metrics = run_clustering(segments(spark, sf_dir).select("row_id", "features", "profile"), 5, 5).metrics
    return round_columns(metrics.select("model", "silhouette", "davies_bouldin", F.round("calinski_harabasz", 0).alias("calinski_harabasz")))
