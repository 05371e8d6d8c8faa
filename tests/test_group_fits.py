"""Many datasets in the scans of one, and silhouettes without pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import reference_math as ref
from shoal.operators import quality
from shoal.operators.kmeans import kmeans_groups, kmeans_many
from shoal.operators.pca import pca, pca_groups
from shoal.operators.quality import score, silhouette_squared
from shoal.plans.group_fits import fit_groups


def table(spark, groups):
    """groups: name -> points; keys count up inside each group."""
    rows = [(name, i, [float(v) for v in p]) for name, x in groups.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "dataset string, row_id long, features array<double>").repartition(5)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(2)
    made = {name: np.vstack([rng.normal(size=(12, 3)) * 0.4 + c for c in rng.uniform(-9, 9, size=(3, 3))]) for name in ("a", "b", None)}
    return made | {"few": rng.normal(size=(3, 3)), "one": np.full((4, 3), 7.0)}


def test_fits_are_those_of_each_group(spark, groups):
    df = table(spark, groups)
    found = kmeans_groups(df, "dataset", [2, 4], [42, 43])
    for name, x in groups.items():
        ks = [k for k in (2, 4) if k <= len(x)]
        alone = kmeans_many(df.where(F.col("dataset").eqNullSafe(F.lit(name))), ks, [42, 43])
        assert {(s, k) for n, s, k in found if n == name} == set(alone)
        for (s, k), fit in alone.items():
            assert np.allclose(found[name, s, k].centres, fit.centres) and found[name, s, k].inertia == pytest.approx(fit.inertia)


def test_curves_and_components(spark, groups):
    df = table(spark, groups)
    found = fit_groups(df, "dataset", [2, 3], n_trials=2)
    curves = {(r["group"], r["trial"], r["k"], r["metric"]): r["value"] for r in found.curves.collect()}
    labelled = found.assign(df, 3)
    assert labelled.count() == sum(map(len, groups.values())) and labelled.columns == [*df.columns, "label"]
    for name in ("a", None):
        mine = labelled.where(F.col("dataset").eqNullSafe(F.lit(name))).orderBy("row_id").collect()
        x, label = groups[name], np.array([r["label"] for r in mine])
        assert curves[name, 1, 3, "davies_bouldin"] == pytest.approx(ref.davies_bouldin(x, label))
        assert curves[name, 1, 3, "calinski_harabasz"] == pytest.approx(ref.calinski_harabasz(x, label))
        assert curves[name, 1, 3, "silhouette_squared"] == pytest.approx(plain_squared(x, label).mean())
        assert curves[name, 1, 3, "inertia"] == pytest.approx(sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in range(3)))
        parts = [r for r in found.components.collect() if r["group"] == name]
        want = pca(df.where(F.col("dataset").eqNullSafe(F.lit(name))))
        assert np.allclose([r["variance"] for r in sorted(parts, key=lambda r: r["component"])], want.variances)
        assert np.allclose([r["loading"] for r in sorted(parts, key=lambda r: r["component"])], want.loadings, atol=1e-6)
    # three rows in three clusters have no index, four equal rows no second cluster
    assert ("few", 1, 3, "inertia") in curves and ("few", 1, 3, "davies_bouldin") not in curves
    assert curves["one", 2, 2, "inertia"] == 0 and ("one", 1, 2, "davies_bouldin") not in curves


def plain_squared(x, labels):
    d, out = ref.pairwise(x) ** 2, []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(x)) != i)
        a = d[i][mine].mean() if mine.any() else 0
        b = min(d[i][labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b) if mine.any() and max(a, b) > 0 else 0.0)
    return np.array(out)


def test_squared_silhouettes(spark):
    """Several labelings, a cluster of one row, copies, far from the origin."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 2)), np.repeat([[3.0, 3]], 10, axis=0)]) + 1e4
    a, b = rng.integers(0, 4, 70), np.where(np.arange(70) == 5, 9, np.arange(70) % 2 - 3)
    rows = [(i, [float(v) for v in p], int(a[i]), int(b[i])) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, a int, b int").repartition(4)
    got = {(r["model"], r["cluster"]): (r["n"], r["silhouette"]) for r in silhouette_squared(df, ["a", "b"]).collect()}
    for name, label in (("a", a), ("b", b)):
        want = plain_squared(x, label)
        for c in set(label.tolist()):
            assert got[name, c][0] == (label == c).sum() and got[name, c][1] == pytest.approx(want[label == c].mean(), abs=1e-6)
    whole = {r["model"]: r["silhouette"] for r in score(df, ["a", "b"], silhouette="squared").collect()}
    assert whole["a"] == pytest.approx(plain_squared(x, a).mean(), abs=1e-6)
    with pytest.raises(ValueError, match="clusters"):
        silhouette_squared(df.withColumn("same", F.lit(1)), ["same"])


def test_jobs_do_not_grow_with_the_groups(spark):
    rng = np.random.default_rng(9)

    def jobs(n):
        df = table(spark, {f"d{g}": rng.normal(size=(12, 2)) for g in range(n)})
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        fit_groups(df, "dataset", [2, 3], max_iter=2)
        return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before
    assert jobs(3) == jobs(30)


def test_components_of_groups_with_few_rows(spark):
    df = table(spark, {"x": [[1.0, 2.0]], "y": [[0.0, 0], [3, 4]]})
    got = {(r["group"], r["component"]): (r["variance"], r["loading"]) for r in pca_groups(df, "dataset").collect()}
    assert got["x", 1][0] == 0 and got["y", 1][0] == pytest.approx(12.5) and np.allclose(got["y", 1][1], [0.6, 0.8])


@pytest.mark.parametrize("block", [4, 4096])
def test_indices_from_tables_of_centres(spark, monkeypatch, block):
    """Centres in blocks, a hot cluster over several copies of its centre, clusters of one row, coinciding centres."""
    monkeypatch.setattr(quality, "SALT_ROWS", 20)
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(150, 2)), np.zeros((4, 2)), [[1, 0], [-1, 0], [0, 1], [0, -1]]]) + 100
    a = np.concatenate([np.where(np.arange(150) < 60, 0, rng.integers(1, 12, 150)), [20] * 4, [21] * 4])
    b = np.arange(158) // 2
    rows = [(i, [float(v) for v in p], int(a[i]), int(b[i])) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, a int, b int").repartition(4)
    got = {r["model"]: r for r in quality._score_tables(quality._packed(df, ["a", "b"], "features", None), ["a", "b"], block).collect()}
    want = {r["model"]: r for r in score(df, ["a", "b"], silhouette=None).collect()}
    assert got["a"]["calinski_harabasz"] == pytest.approx(ref.calinski_harabasz(x, a))
    for m in "ab":
        assert got[m]["davies_bouldin"] == pytest.approx(want[m]["davies_bouldin"]) and got[m]["calinski_harabasz"] == pytest.approx(want[m]["calinski_harabasz"])
    same = spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 1), (2, [1.0], 1)], "row_id long, features array<double>, c int")
    flat = score(same, ["c"], silhouette=None, centre_values=0).first()
    assert flat["davies_bouldin"] == 0 and flat["calinski_harabasz"] == 1
    with pytest.raises(ValueError, match="clusters"):
        score(same, ["row_id"], silhouette=None, centre_values=0)
