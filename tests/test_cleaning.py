import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoal.functions.columns import categorical_columns, numeric_columns
from shoal.operators.cleaning import (build_vocabulary, drop_missing, impute, label_encode, scale,
                                      value_counts, zscore_filter)
from shoal.operators.columns import assemble, drop_columns, preview
from shoal.operators.statistics import (cluster_profile, column_stats, correlation_matrix, exact_medians)
from shoal.plans.preprocess import preprocess


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def values(df, name="x"):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("data, kept", [
    ([0.0] * 10 + [1.0], 10),
    ([0.0] * 9 + [1.0], 10),
    ([0.0] * 9 + [1.0] + [None] * 10, 19),
    ([5.0] * 20, 20),
    ([1.0], 1),
    ([None] * 5, 5),
    ([float("nan")] * 10 + [0.0] * 9 + [1.0], 19),
])
def test_zscore(spark, data, kept):
    assert zscore_filter(column(spark, data)).count() == kept


def test_zscore_masks_are_simultaneous(spark):
    data = pd.DataFrame({"a": [0.0] * 30 + [100.0], "b": [float(i % 3) for i in range(30)] + [500.0]})
    keep = pd.Series(True, index=data.index)
    for c in data:
        keep &= ((data[c] - data[c].mean()) / data[c].std()).abs() < 3
    assert zscore_filter(spark.createDataFrame(data)).count() == keep.sum()


def test_scalers(spark):
    x = column(spark, [1.0, 2.0, 4.0, 8.0])
    assert values(scale(x, "standard")) == pytest.approx([-1.025755, -0.652753, 0.093250, 1.585258], abs=1e-6)
    assert values(scale(x, "minmax")) == pytest.approx([0, 1 / 7, 3 / 7, 1])
    same = column(spark, [0.1] * 7)
    assert values(scale(same, "standard")) == [0.0] * 7 == values(scale(same, "minmax"))
    with pytest.raises(ValueError):
        scale(x, "MinMaxx")


@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=30))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_scaled_moments(spark, data):
    stats = column_stats(scale(column(spark, data), "standard"), ["x"])["x"]
    assert abs(stats.mean) < 1e-6
    assert stats.std_pop == pytest.approx(1, abs=1e-6) or max(data) - min(data) < 1e-6
    bounded = values(scale(column(spark, data), "minmax"))
    assert min(bounded) >= 0 and max(bounded) <= 1 + 1e-12


def test_impute(spark):
    numbers = column(spark, [1.0, 2.0, 4.0, 8.0, None])
    assert values(impute(numbers, "median"))[-1] == 3.0
    assert values(impute(numbers, "mean"))[-1] == 3.75
    words = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "s string, t string")
    assert [r["s"] for r in impute(words).collect()].count("a") == 3
    assert values(impute(words), "t") == ["Missing"] * 5
    assert values(impute(column(spark, [None, None]))) == [None, None]
    with pytest.raises(ValueError):
        impute(numbers, "Mode")


@pytest.mark.parametrize("data", [
    [float(i) for i in range(1001)], [float(i % 2) for i in range(1000)], [1.0] * 600 + [2.0] * 400,
    [1.0] * 500 + [2.0] * 500, [(-1.0) ** i * 1.5 ** (i % 90) for i in range(997)], [3.0]])
def test_narrowed_median_is_exact(spark, data):
    df = column(spark, data).repartition(5)
    got = exact_medians(df, {"x": len(data)}, small=20)["x"]
    assert got == pytest.approx(pd.Series(data).median(), rel=1e-12)


def test_label_encode(spark):
    words = spark.createDataFrame([("b", "10"), ("Z", "2"), ("é", "10"), ("a", "2")], "s string, t string")
    coded, vocab = label_encode(words)
    assert [tuple(r) for r in coded.collect()] == [(2, 0), (0, 1), (3, 0), (1, 1)]
    assert {(r["column"], r["value"], r["code"]) for r in vocab.collect()} >= {("s", "Z", 0), ("t", "10", 0)}
    flags = spark.createDataFrame([(True,), (False,)], "f boolean")
    assert values(label_encode(flags)[0], "f") == [1, 0]


def test_vocabulary_over_ranges(spark):
    words = [(f"w{i * 7919 % 500:04d}" if i % 3 else "hot", f"v{i % 40}") for i in range(900)]
    df = spark.createDataFrame(words, "s string, t string")
    counts = value_counts(df, ["s", "t"])
    small = {(r["column"], r["value"]): r["code"] for r in build_vocabulary(counts).collect()}
    spread = {(r["column"], r["value"]): r["code"] for r in build_vocabulary(counts, window_values=100).collect()}
    assert small == spread


def test_large_vocabulary_joins_hot_values_apart(spark):
    from shoal.operators import cleaning
    words = [(i, f"w{i:05d}" if i % 3 else "hot") for i in range(900)]
    df = spark.createDataFrame(words, "id int, s string")
    vocab = build_vocabulary(value_counts(df, ["s"]))
    joined, codes = cleaning.apply_vocabulary(df, vocab, {"s": F.col("s")}, cleaning.vocabulary_sizes(vocab), 900,
                                              max_values=10)
    got = {r["id"]: r["c"] for r in joined.select("id", codes["s"].alias("c")).collect()}
    order = {w: i for i, w in enumerate(sorted({w for _, w in words}))}
    assert got == {i: order[w] for i, w in words}


def test_missing_rows(spark):
    rows = [(float(i), "t") for i in range(12)]
    rows[3] = (None, "t")
    rows[7] = (7.0, None)
    df = spark.createDataFrame(rows, "x double, s string")
    assert drop_missing(df).count() == 10
    assert preprocess(df, imputer="drop").features.count() == 10
    assert preprocess(df, imputer="mean").features.count() == 12


def test_types(spark):
    df = spark.sql("select true b, 1 i, cast(1.5 as decimal(5,2)) d, 'a' s, date'2024-01-01' t")
    assert numeric_columns(df) == ["i", "d"]
    assert categorical_columns(df) == ["b", "s", "t"]
    with pytest.raises(ValueError):
        categorical_columns(spark.sql("select array(1) a"))
    with pytest.raises(ValueError):
        drop_columns(df, ["nope"])


def test_assemble_names_the_bad_column(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="'b'"):
        assemble(df).collect()
    with pytest.raises(ValueError):
        assemble(df, [])


def test_preview_shows_null(spark):
    assert preview(column(spark, [float("nan"), 1.0])).filter("x is null").count() == 1


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 4.0), (4.0, 5.0, 6.0), (8.0, 5.0, 9.0)],
                               "a double, b double, c double")
    r = {(x["col_a"], x["col_b"]): x["r"] for x in correlation_matrix(df).collect()}
    assert r["a", "c"] == pytest.approx(0.997176, abs=1e-6) == r["c", "a"]
    assert r["a", "a"] == 1 and r["b", "b"] is None and r["a", "b"] is None
    assert correlation_matrix(spark.createDataFrame([("a",)], "s string")).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_correlation_does_not_depend_on_other_columns(spark, parts):
    """Gaps, a huge cell where the partner is missing, far means, a column constant where shared, and an empty one."""
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(60, 6)), columns=list("abcdef"))
    data["b"] = data["a"] * 0.9 + data["b"] * 0.1
    data.loc[7, "a"], data.loc[7, "b"] = 1e12, np.nan
    data["c"] += 1e9
    data.loc[::3, "d"] = np.nan
    data["e"] = np.where(data.index % 3 == 0, data["e"], 4.5)
    data["f"] = np.nan
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"{c} double" for c in data)).repartition(parts)
    want = data.corr()
    narrow = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(df, ["a", "b"]).collect()}
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(df).collect()}
    assert narrow["a", "b"] == pytest.approx(wide["a", "b"], abs=1e-12) == pytest.approx(want.loc["a", "b"], abs=1e-9)
    for (x, y), r in wide.items():
        if "f" in (x, y) or {x, y} == {"d", "e"}:
            assert r is None, (x, y)
        else:
            assert r == pytest.approx(want.loc[x, y], abs=1e-6), (x, y)


def test_profile_checks_labels_and_keeps_columns(spark):
    rows = spark.createDataFrame([(1, 2.0, 7), (2, 4.0, 8), (3, 9.0, 9)], "id long, x double, row_id int")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "id long, label int")
    with pytest.raises(Exception, match="no label for key 3"):
        cluster_profile(rows, labels, "id").collect()
    assert [tuple(r) for r in cluster_profile(rows, labels, "id", unlabelled="skip").collect()] == [(0, 3.0, 7.5)]
    with pytest.raises(Exception, match="more than one label for key 1"):
        cluster_profile(rows, labels.union(labels), "id").collect()
    named = spark.createDataFrame([(0, 1.0)], "label int, cluster double")
    assert cluster_profile(named).columns == ["cluster", "cluster_mean"]


def test_profile_rounds_half_even(spark):
    df = spark.createDataFrame([(1, 0.0, 9), (1, 0.25, 9)], "label int, x double, Cluster int")
    assert [tuple(r) for r in cluster_profile(df).collect()] == [(1, 0.12)]


def test_preprocess_against_pandas(spark):
    n = 200
    data = pd.DataFrame({
        "a": [float(i % 17) if i % 11 else None for i in range(n)], "b": [float(i * i % 101) for i in range(n)],
        "s": [["x", "y", None, "z"][i % 4] for i in range(n)], "k": range(n)})
    data.loc[5, "b"] = 5000.0
    got = preprocess(spark.createDataFrame(data).repartition(4), imputer="median", scaler="minmax", key="k")
    keep = pd.Series(True, index=data.index)
    for c in "ab":
        filled = data[c].fillna(data[c].mean())
        keep &= ((filled - filled.mean()) / filled.std()).abs() < 3
    want = data[keep].copy()
    want["a"] = want["a"].fillna(want["a"].median())
    want["s"] = want["s"].fillna(want["s"].mode()[0])
    profile = got.profile.toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(profile[["a", "b", "s", "k"]], want.reset_index(drop=True), check_dtype=False)
    want["s"] = want["s"].rank(method="dense") - 1
    for c in ("a", "b", "s"):
        want[c] = (want[c] - want[c].min()) / (want[c].max() - want[c].min())
    features = got.features.toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(features[["a", "b", "s", "k"]], want.reset_index(drop=True), check_dtype=False)


def test_transform_refuses_unseen_values(spark):
    fitted = preprocess(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "s string, x double"))
    assert fitted.transform(spark.createDataFrame([("b", None)], "s string, x double")).profile.first()["x"] == 1.5
    with pytest.raises(Exception, match="not seen"):
        fitted.transform(spark.createDataFrame([("c", 1.0)], "s string, x double")).features.collect()


def test_options_are_checked(spark):
    df = column(spark, [1.0, 2.0])
    for bad in (dict(imputer="Mean"), dict(scaler="x"), dict(drop_cols=["y"]), dict(drop_cols=["x"])):
        with pytest.raises(ValueError):
            preprocess(df, **bad)


def test_plan_prunes_and_keeps_rows_in_place(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_tax", "l_returnflag")
    plan = preprocess(df).features._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_vocabulary_paths_agree(spark):
    from shoal.operators.cleaning import fit_vocabulary
    df = spark.createDataFrame([(f"w{i % 7}" if i % 5 else None, None, "q") for i in range(100)],
                               "s string, t string, u string")
    few, fills = fit_vocabulary(value_counts(df, ["s", "t", "u"]), ["s", "t", "u"], True)
    many, same = fit_vocabulary(value_counts(df, ["s", "t", "u"]), ["s", "t", "u"], True, max_values=2)
    assert fills == same and dict(few.sizes) == dict(many.sizes)
    assert sorted(few.table.collect()) == sorted(many.table.select(few.table.columns).collect())
    for name, stats in few.stats.items():
        other = many.stats[name]
        assert (stats.rows, stats.maximum) == (other.rows, other.maximum)
        assert (stats.mean, stats.var_samp) == pytest.approx((other.mean, other.var_samp))


@pytest.mark.parametrize("imputer,scaler", [("mean", "standard"), ("drop", "minmax")])
def test_groups_equal_one_by_one(spark, imputer, scaler):
    from shoal.plans.grouped import preprocess_groups
    rng = np.random.default_rng(4)
    n = 150
    data = [(["x", "y", None][i % 3], i, None if i % 7 == 0 else float(rng.normal() * 10 + i % 3), 1e6 if i == 20 else float(i % 11),
             2.5, None if i % 5 == 0 else "pqr"[i % 4 % 3], None if i % 3 == 1 else "s") for i in range(n)]
    df = spark.createDataFrame(data, "g string, k long, a double, b double, flat double, t string, u string")
    got = {r["k"]: r for r in preprocess_groups(df, "g", imputer=imputer, scaler=scaler, key="k").collect()}
    seen = 0
    for g in ("x", "y", None):
        mine = df.where(F.col("g").eqNullSafe(F.lit(g))).drop("g")
        if imputer == "drop" and g == "y":
            continue  # every row lacks u
        for r in preprocess(mine, imputer=imputer, scaler=scaler, key="k").features.collect():
            seen += 1
            for c in ("a", "b", "flat", "t", "u"):
                assert got[r["k"]][c] == pytest.approx(r[c], abs=1e-9), (g, r["k"], c)
    assert seen == len(got)
