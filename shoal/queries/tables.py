"""Sources, cleaning and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators.cleaning import (drop_missing, impute, label_encode, scale, zscore_filter)
from shoal.operators.columns import assemble, drop_columns, preview, shape_summary
from shoal.functions.columns import select_numeric
from shoal.operators.statistics import cluster_profile, correlation_matrix
from shoal.plans.preprocess import Preprocessed, load_preprocessed, preprocess
from shoal.queries.registry import query, round_columns, rounded, rounded_sql, table
from shoal.session import scratch_path
from shoal.sources.csv import infer_types, load_csv, load_csv_tables
from shoal.sources.results import read_results, write_results

# -- inputs with gaps, derived the same way in both engines --------------------------------

GAPPY_SQL = """SELECT l_orderkey, l_linenumber, l_discount, l_tax,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus FROM lineitem"""


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing cells in two numeric columns and one text column."""
    def gap(name, line):
        return F.when(F.col("l_linenumber") != line, F.col(name)).alias(name)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", gap("l_quantity", 3),
        gap("l_extendedprice", 5), gap("l_returnflag", 2), "l_linestatus")


def zscore_sql(source: str, cols: list[str], out: str = "*") -> str:
    """Rows of ``source`` whose cells, gaps filled with the mean, all lie within 3 sigmas."""
    means = ", ".join(f"avg({c}) AS m_{c}" for c in cols)
    devs = ", ".join(f"stddev_samp(coalesce({c}, m_{c})) AS s_{c}, avg(coalesce({c}, m_{c})) AS a_{c}"
                     for c in cols)
    keep = " AND ".join(f"(NOT coalesce(s_{c} > 0, false) OR "
                        f"abs((coalesce({c}, m_{c}) - a_{c}) / s_{c}) < 3)" for c in cols)
    return f"""raw AS ({source}), mean_of AS (SELECT {means} FROM raw),
dev_of AS (SELECT {devs} FROM raw, mean_of),
kept AS (SELECT raw.* FROM raw, mean_of, dev_of WHERE {keep})"""


# -- sources and sinks ---------------------------------------------------------------------

@query("csv_roundtrip", """SELECT doc_id, lang, source, n_chars, strlen(text) AS n_bytes,
  md5(text) AS digest FROM documents""")
def csv_roundtrip(spark, sf_dir):
    folder = scratch_path(spark, "csv")
    write_results({"documents": table(spark, sf_dir, "documents")}, folder)
    back = load_csv(spark, f"{folder}/documents")
    return back.select("doc_id", "lang", "source", "n_chars",
                       F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("digest"))


@query("infer_types", """SELECT l_orderkey AS whole,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS number,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE l_returnflag END AS word,
  strftime(l_shipdate, '%Y-%m-%d') AS day, l_tax > 0.04 AS flag,
  CAST(NULL AS DOUBLE) AS nothing, l_linestatus || ',"' || l_returnflag AS quoted FROM lineitem""")
def infer_types_query(spark, sf_dir):
    line = F.col("l_linenumber")
    text = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("whole"),
        F.when(line == 3, "N/A").otherwise(F.col("l_quantity").cast("string")).alias("number"),
        F.when(line == 4, "NA").otherwise(F.col("l_returnflag")).alias("word"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("l_tax") > 0.04, "True").otherwise("False").alias("flag"),
        F.when(line > 3, "null").otherwise("").alias("nothing"),
        F.concat("l_linestatus", F.lit(',"'), "l_returnflag").alias("quoted"))
    return infer_types(text)


@query("scan_folder", """SELECT l_returnflag AS dataset, count(*) AS n_rows,
  sum(l_orderkey)::BIGINT AS sum_orderkey, round(sum(l_quantity), 2) AS sum_quantity,
  round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY l_returnflag""")
def scan_folder(spark, sf_dir):
    folder = scratch_path(spark, "folder")
    (table(spark, sf_dir, "lineitem").withColumn("set", F.col("l_returnflag"))
     .write.partitionBy("set").option("header", True).csv(folder))
    files = load_csv_tables(spark, folder)
    return (files.groupBy(F.regexp_extract("dataset", "/set=([^/]+)/", 1).alias("dataset"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("sum_orderkey"),
                 F.round(F.sum("l_quantity"), 2).alias("sum_quantity"),
                 F.round(F.avg("l_extendedprice"), 4).alias("avg_price")))


@query("preview", """SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10)""")
def preview_query(spark, sf_dir):
    return preview(drop_columns(table(spark, sf_dir, "orders"), ["o_orderdate"]), order_by=["o_orderkey"])


@query("shape_summary", f"""WITH {zscore_sql("SELECT event_id, user_id, event_type, value FROM events",
                                            ["event_id", "user_id", "value"])}
SELECT 'raw' AS name, count(*) AS n_rows, 4::BIGINT AS n_cols FROM raw
UNION ALL SELECT 'processed', count(*), 4::BIGINT FROM kept""")
def shape_summary_query(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return shape_summary({"raw": raw, "processed": preprocess(raw).features})


@query("write_read_results", """SELECT 'profile' AS name, l_linenumber::BIGINT AS cluster,
  round_even(avg(l_quantity), 2) AS l_quantity, round_even(avg(l_extendedprice), 2) AS l_extendedprice
FROM lineitem GROUP BY l_linenumber""")
def write_read_results(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice")
    folder = scratch_path(spark, "results")
    write_results({"profile": cluster_profile(lines, label="l_linenumber")}, folder)
    back = read_results(spark, folder, ["profile"])["profile"]
    return back.select(F.lit("profile").alias("name"), "*")


@query("assemble_features", """SELECT vec_id, len(f)::INT AS n_features,
  round(list_sum(f), 6) AS total, round(sqrt(list_sum(list_transform(f, lambda v: v * v))), 6) AS norm
FROM (SELECT vec_id, list_append(embedding::DOUBLE[], label::DOUBLE) AS f FROM embeddings)""")
def assemble_features(spark, sf_dir):
    rows = assemble(table(spark, sf_dir, "embeddings"), ["embedding", "label"])
    zero = F.lit(0.0)
    return rows.select(
        "vec_id", F.size("features").alias("n_features"),
        F.round(F.aggregate("features", zero, lambda a, v: a + v), 6).alias("total"),
        F.round(F.sqrt(F.aggregate("features", zero, lambda a, v: a + v * v)), 6).alias("norm"))


# -- projections and filters ------------------------------------------------------------------

@query("drop_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem""")
def drop_columns_query(spark, sf_dir):
    return drop_columns(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_shipdate"])


@query("select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_numeric_query(spark, sf_dir):
    return select_numeric(table(spark, sf_dir, "part"))


@query("zscore_filter", f"""WITH {zscore_sql("SELECT * FROM events", ["value"])}
SELECT event_id, user_id, event_type, value FROM kept""")
def zscore_filter_query(spark, sf_dir):
    return zscore_filter(table(spark, sf_dir, "events"), ["value"]).select(
        "event_id", "user_id", "event_type", "value")


_EVENT_GAPS = "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events"


@query("zscore_filter_nulls", f"WITH {zscore_sql(_EVENT_GAPS, ['value'])} SELECT event_id, value FROM kept")
def zscore_filter_nulls(spark, sf_dir):
    gaps = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return zscore_filter(gaps, ["value"])


_EVENT_MANY = """SELECT event_id, user_id, value, value * value AS square, 1.0::DOUBLE AS same FROM events"""


@query("zscore_filter_multi", f"""WITH {zscore_sql(_EVENT_MANY, ["event_id", "user_id", "value", "square", "same"])}
SELECT event_id, user_id, value, round(square, 6) AS square, same FROM kept""")
def zscore_filter_multi(spark, sf_dir):
    many = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", (F.col("value") * F.col("value")).alias("square"),
        F.lit(1.0).alias("same"))
    return zscore_filter(many).withColumn("square", F.round("square", 6))


@query("dropna", f"""SELECT * FROM ({GAPPY_SQL}) WHERE l_quantity IS NOT NULL
  AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL""")
def dropna(spark, sf_dir):
    return drop_missing(gappy_lineitem(spark, sf_dir))


# -- imputing, encoding, scaling ----------------------------------------------------------------

@query("impute_mean", f"""WITH g AS ({GAPPY_SQL}),
m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM g)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, q), 6) AS l_quantity,
  round(coalesce(l_extendedprice, p), 6) AS l_extendedprice FROM g, m""")
def impute_mean(spark, sf_dir):
    gaps = gappy_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return round_columns(impute(gaps, "mean"))


@query("impute_median", f"""WITH g AS ({GAPPY_SQL}),
m AS (SELECT median(l_quantity) AS q, median(l_extendedprice) AS p FROM g)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, q), 6) AS l_quantity,
  round(coalesce(l_extendedprice, p), 6) AS l_extendedprice FROM g, m""")
def impute_median(spark, sf_dir):
    gaps = gappy_lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return round_columns(impute(gaps, "median"))


@query("impute_mode", """WITH g AS (SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_totalprice > 0 THEN NULL ELSE o_orderstatus END AS status FROM orders),
m AS (SELECT priority AS top FROM g WHERE priority IS NOT NULL GROUP BY priority
  ORDER BY count(*) DESC, priority LIMIT 1)
SELECT o_orderkey, coalesce(priority, top) AS priority, coalesce(status, 'Missing') AS status FROM g, m""")
def impute_mode(spark, sf_dir):
    gaps = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_totalprice") <= 0, F.col("o_orderstatus")).alias("status"))
    return impute(gaps)


@query("label_encode", """SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name,
  dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type
FROM part""")
def label_encode_query(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return label_encode(parts)[0]


@query("label_encode_unique", """SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name,
  dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer""")
def label_encode_unique(spark, sf_dir):
    return label_encode(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))[0]


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(method: str) -> str:
    if method == "standard":
        stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in _SCALED)
    else:
        stats = ", ".join(f"min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}" for c in _SCALED)
    out = ", ".join(f"{rounded_sql(f'({c} - a_{c}) / b_{c}')} AS {c}" for c in _SCALED)
    return f"""WITH s AS (SELECT {stats}, min(l_tax * 0) AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, {out}, z AS same FROM lineitem, s"""


def _scale(spark, sf_dir, method):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *_SCALED, F.lit(7.5).alias("same"))
    return round_columns(scale(lines, method, [*_SCALED, "same"]))


@query("standard_scale", _scale_sql("standard"))
def standard_scale(spark, sf_dir):
    return _scale(spark, sf_dir, "standard")


@query("minmax_scale", _scale_sql("minmax"))
def minmax_scale(spark, sf_dir):
    return _scale(spark, sf_dir, "minmax")


# -- the whole preprocessing --------------------------------------------------------------------

_NUMERIC = ["l_discount", "l_tax", "l_quantity", "l_extendedprice"]
_FEATURE_SOURCE = f"SELECT l_orderkey, l_linenumber, {', '.join(_NUMERIC)}, l_returnflag, l_linestatus FROM ({GAPPY_SQL})"


def _clean_sql() -> str:
    fills = ", ".join(f"avg({c}) AS f_{c}" for c in _NUMERIC)
    mode = ("(SELECT l_returnflag FROM kept WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag "
            "ORDER BY count(*) DESC, l_returnflag LIMIT 1)")
    clean = ", ".join(f"coalesce({c}, f_{c}) AS {c}" for c in _NUMERIC)
    return f"""{zscore_sql(_FEATURE_SOURCE, _NUMERIC)},
fill_of AS (SELECT {fills} FROM kept),
clean AS (SELECT l_orderkey, l_linenumber, {clean}, coalesce(l_returnflag, {mode}) AS l_returnflag,
  l_linestatus FROM kept, fill_of)"""


def _features_sql(method: str, clean: str = "clean") -> str:
    cols = [*_NUMERIC, "l_returnflag", "l_linestatus"]
    if method == "standard":
        stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in cols)
    else:
        stats = ", ".join(f"min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}" for c in cols)
    out = ", ".join(f"{rounded_sql(f'({c} - a_{c}) / b_{c}')} AS {c}" for c in cols)
    return f"""coded AS (SELECT l_orderkey, l_linenumber, {', '.join(_NUMERIC)},
  dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag,
  dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus FROM {clean}),
scale_of AS (SELECT {stats} FROM coded)
SELECT l_orderkey, l_linenumber, {out} FROM coded, scale_of"""


def lineitem_run(spark: SparkSession, sf_dir: str, **options) -> Preprocessed:
    gaps = gappy_lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", *_NUMERIC, "l_returnflag", "l_linestatus")
    return preprocess(gaps, key=["l_orderkey", "l_linenumber"], **options)


_PROFILE_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in _NUMERIC)


@query("preprocess_profile", f"""WITH {_clean_sql()}
SELECT l_orderkey, l_linenumber, {_PROFILE_OUT}, l_returnflag, l_linestatus FROM clean""")
def preprocess_profile(spark, sf_dir):
    return round_columns(lineitem_run(spark, sf_dir).profile)


@query("preprocess_features", f"WITH {_clean_sql()}, {_features_sql('standard')}")
def preprocess_features(spark, sf_dir):
    return round_columns(lineitem_run(spark, sf_dir).features)


_COMPLETE_SQL = f"""raw AS ({_FEATURE_SOURCE}), clean AS (SELECT * FROM raw WHERE l_quantity IS NOT NULL
  AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL)"""


@query("preprocess_drop_minmax", f"WITH {_COMPLETE_SQL}, {_features_sql('minmax')}")
def preprocess_drop_minmax(spark, sf_dir):
    return round_columns(lineitem_run(spark, sf_dir, imputer="drop", scaler="minmax",
                                      remove_outliers=False).features)


@query("preprocess_apply", f"""WITH fit AS (SELECT c_acctbal AS bal, c_nationkey AS nation FROM customer),
m AS (SELECT avg(bal) AS mb, stddev_samp(bal) AS sb, avg(nation) AS mn, stddev_samp(nation) AS sn FROM fit),
kept AS (SELECT fit.* FROM fit, m WHERE abs((bal - mb) / sb) < 3 AND abs((nation - mn) / sn) < 3),
p AS (SELECT avg(bal) AS ab, stddev_pop(bal) AS bb, avg(nation) AS an, stddev_pop(nation) AS bn FROM kept)
SELECT s_suppkey AS id, {rounded_sql('(s_acctbal - ab) / bb')} AS bal, {rounded_sql('(s_nationkey - an) / bn')} AS nation
FROM supplier, m, p WHERE abs((s_acctbal - mb) / sb) < 3 AND abs((s_nationkey - mn) / sn) < 3""")
def preprocess_apply(spark, sf_dir, reload=False):
    def shaped(name, prefix, key):
        return table(spark, sf_dir, name).select(
            F.col(key).alias("id"), F.col(f"{prefix}_acctbal").alias("bal"),
            F.col(f"{prefix}_nationkey").alias("nation"))
    fitted = preprocess(shaped("customer", "c", "c_custkey"), key="id")
    if reload:
        folder = scratch_path(spark, "fitted")
        fitted.write(folder)
        fitted = load_preprocessed(spark, folder)
    return round_columns(fitted.transform(shaped("supplier", "s", "s_suppkey")).features)


# -- statistics ---------------------------------------------------------------------------------

def _correlation_sql(source: str, cols: list[str], constant: str | None = None) -> str:
    parts = []
    for a in cols:
        for b in cols:
            if constant in (a, b):
                value = "CAST(NULL AS DOUBLE)"
            elif a == b:
                value = "1.0::DOUBLE"
            else:
                value = f"round(corr({a}, {b}), 6)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {value} AS r FROM t"
                         + (" LIMIT 1" if "corr" not in value else ""))
    return f"WITH t AS ({source}) " + " UNION ALL ".join(f"(SELECT * FROM ({p}))" for p in parts)


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"]


@query("correlation", _correlation_sql("SELECT * FROM lineitem", _LINE_NUMBERS))
def correlation(spark, sf_dir):
    return round_columns(correlation_matrix(table(spark, sf_dir, "lineitem")))


@query("correlation_nulls", _correlation_sql(
    f"SELECT *, 4.0 AS same FROM ({GAPPY_SQL})",
    ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "same"], constant="same"))
def correlation_nulls(spark, sf_dir):
    data = gappy_lineitem(spark, sf_dir).select(
        "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", F.lit(4.0).alias("same"))
    return round_columns(correlation_matrix(data))


@query("correlation_wide", """WITH e AS (SELECT embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.range::INT AS a, b.range::INT AS b FROM range(64) a, range(64) b)
SELECT 'x' || a AS col_a, 'x' || b AS col_b,
  CASE WHEN a = b THEN 1.0 ELSE """ + rounded_sql("corr(v[a + 1], v[b + 1])") + """ END AS r
FROM e, d GROUP BY a, b""")
def correlation_wide(spark, sf_dir):
    wide = table(spark, sf_dir, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    return round_columns(correlation_matrix(wide))


@query("cluster_profile", f"""WITH {_clean_sql()}
SELECT (dense_rank() OVER (ORDER BY l_returnflag) - 1)::INT AS cluster, {', '.join(
    f'round_even(avg({c}), 2) AS {c}' for c in _NUMERIC)} FROM clean GROUP BY l_returnflag""")
def cluster_profile_query(spark, sf_dir):
    """Outlier filter, imputing and scaling of lineitem, then a profile by coded return flag."""
    run = lineitem_run(spark, sf_dir)
    codes = run.vocab.filter("column = 'l_returnflag'").select(
        F.col("value").alias("l_returnflag"), F.col("code").alias("label"))
    labelled = run.profile.drop("l_orderkey", "l_linenumber").join(F.broadcast(codes), "l_returnflag")
    return cluster_profile(labelled)


@query("cluster_profile_join", """SELECT l.quality * 2 + l.toxic AS cluster,
  round_even(avg(d.n_chars), 2) AS n_chars FROM documents d JOIN labels l USING (doc_id) GROUP BY 1""")
def cluster_profile_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return cluster_profile(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), labels, "doc_id", unlabelled="skip")
