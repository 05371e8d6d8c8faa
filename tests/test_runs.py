import numpy as np
import pytest
from pyspark.sql import functions as F

import reference_math as ref
from shoal.plans.analyze_k import analyze_k, k_sweep
from shoal.plans.batch import analyze_batch, analyze_folder
from shoal.plans.report import Settings, analyze


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    return np.vstack([rng.normal(size=(30, 3)) * 0.3 + c for c in ((0, 0, 0), (8, 0, 0), (0, 8, 0), (8, 8, 8))])


def test_analysis_and_training(spark, groups):
    data = [(float(a), float(b), float(c), "even" if i % 2 else "odd") for i, (a, b, c) in enumerate(groups)]
    df = spark.createDataFrame(data, "a double, b double, c double, s string")
    report = analyze(df, Settings(n_trials=2, drop_cols=["s"]))
    assert report.analysis.kmeans_k == 4 == report.analysis.hierarchical_k
    assert report.analysis.history.count() == 2
    curves = report.analysis.curves
    assert curves.count() == 2 * 9 * 7
    tables = report.tables
    assert set(tables) == {"shape", "processed_data", "k_metrics_detail", "voting_history", "metrics", "k_curves",
                           "correlation", "projection", "profile_kmeans", "profile_hierarchical"}
    r = {(x["col_a"], x["col_b"]): x["r"] for x in tables["correlation"].collect()}
    assert len(r) == 9 and r["a", "c"] == pytest.approx(np.corrcoef(groups[:, 0], groups[:, 2])[0, 1])
    assert tables["k_curves"].count() == 2 * 9 * 7
    assert {r["model"] for r in tables["metrics"].collect()} == {"K-Means", "Hierarchical"}
    labels = report.result.labels.toPandas()
    assert len(labels) == 120 and labels["row_id"].is_unique
    x = np.array([r["features"] for r in report.rows.orderBy("row_id").collect()])
    given = labels.sort_values("row_id")["kmeans"].to_numpy()
    got = {r["model"]: r for r in tables["metrics"].collect()}["K-Means"]
    assert got["silhouette"] == pytest.approx(ref.silhouette(x, given).mean(), abs=1e-9)
    assert tables["profile_kmeans"].count() == 4 and tables["profile_kmeans"].columns == ["cluster", "a", "b", "c"]
    assert report.result.projection.columns == ["row_id", "kmeans", "hierarchical", "pc1", "pc2", "pc3"]
    assert sorted(map(tuple, tables["shape"].select("name", "n_rows", "n_cols").collect())) == [
        ("processed", 120, 3), ("raw", 120, 4)]


def test_report_correlates_the_raw_table(spark, groups):
    """A user's row_id column counts, codes of text and filled gaps do not."""
    rows = [(i, float(p[0]) if i % 5 else None, float(p[1]) if i else 1e6, "ab"[i % 2]) for i, p in enumerate(groups)]
    report = analyze(spark.createDataFrame(rows, "row_id long, a double, b double, s string"))
    r = {(x["col_a"], x["col_b"]): x["r"] for x in report.tables["correlation"].collect()}
    assert {a for a, _ in r} == {"row_id", "a", "b"}
    both = np.array([x[:3] for x in rows if x[1] is not None], float)
    assert r["a", "b"] == pytest.approx(np.corrcoef(both[:, 1], both[:, 2])[0, 1])
    assert r["row_id", "b"] == pytest.approx(np.corrcoef([x[0] for x in rows], [x[2] for x in rows])[0, 1])


def test_micro_sweep_agrees_on_separate_groups(spark, groups):
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(groups)],
                               "row_id long, features array<double>")
    found = analyze_k(df, micro=40)
    assert (found.kmeans_k, found.hierarchical_k) == (4, 4)


def test_sweep_needs_rows(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "row_id long, features array<double>")
    with pytest.raises(ValueError):
        k_sweep(df)


def test_batch_records_failures(spark, groups, tmp_path):
    good = tmp_path / "a" / "good.csv"
    bad = tmp_path / "b" / "few.csv"
    for path, rows in ((good, groups), (bad, groups[:3])):
        path.parent.mkdir()
        path.write_text("x,y,z\n" + "\n".join(",".join(str(v) for v in p) for p in rows) + "\n")
    done = analyze_folder(spark, str(tmp_path), Settings())
    status = {r["dataset"].rsplit("/", 1)[1]: r for r in done.status.collect()}
    assert status["good.csv"]["status"] == "completed" and status["good.csv"]["kmeans_k"] == 4
    assert status["few.csv"]["status"] == "failed" and "rows" in status["few.csv"]["error"]
    assert done.table("metrics").count() == 2
    paths = next(iter(done.reports.values())).write(str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(paths["metrics"]).count() == 2
    with pytest.raises(ValueError):
        analyze_batch(spark, {"few": spark.read.csv(str(bad), header=True, inferSchema=True)}, Settings(), fail_fast=True)


def test_small_answers_and_reserved_names(spark):
    """Three yes/no columns have eight distinct rows, and K goes to ten; columns are named like the models."""
    rows = [(i % 2, i // 2 % 2, i // 4 % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "kmeans int, hierarchical int, micro int")
    report = analyze(df, Settings(remove_outliers=False))
    profile = report.tables["profile_kmeans"]
    assert profile.columns == ["cluster", "kmeans", "hierarchical", "micro"] and profile.count() == report.analysis.kmeans_k
    assert report.tables["projection"].columns[:3] == ["row_id", "kmeans", "hierarchical"]


def test_empty_column_is_named(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(30)], "a double, gone double")
    with pytest.raises(ValueError, match="'gone'"):
        analyze(df)


def test_batch_keeps_the_whole_error(spark):
    class Odd(dict):
        def __getitem__(self, name):
            raise KeyError() if name == "silent" else ValueError("first line\nsecond line")
    done = analyze_batch(spark, Odd({"silent": None, "loud": None}), Settings())
    assert {r["dataset"]: r["error"] for r in done.status.collect()} == {"silent": "KeyError()", "loud": "first line\nsecond line"}
