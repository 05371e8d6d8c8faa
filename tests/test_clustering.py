import numpy as np
import pytest
from pyspark.sql import functions as F

import reference_math as ref
from shoal.operators.agglomerative import LINKAGES, agglomerative
from shoal.operators.kmeans import kmeans, kmeans_many, lloyd, summarise
from shoal.operators import micro
from shoal.operators.micro import compress, micro_clusters
from shoal.operators.pca import pca
from shoal.operators.quality import score, silhouette


def frame(spark, x, **labels):
    rows = [(i, [float(v) for v in p], *[int(labels[c][i]) for c in labels]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>"
                                 + "".join(f", {c} int" for c in labels)).repartition(5)


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], dtype=float), np.array([r["label"] for r in rows])


# -- quality ---------------------------------------------------------------------------------

def test_quality_of_four_points(spark):
    df = frame(spark, [[0], [2], [10], [12]], label=[0, 0, 1, 1])
    row = score(df, ["label"]).first()
    assert row["silhouette"] == pytest.approx(0.797980, abs=1e-6)
    assert row["davies_bouldin"] == pytest.approx(0.2)
    assert row["calinski_harabasz"] == pytest.approx(50)


def test_quality_of_several_labelings(spark, embeddings):
    x, label = embeddings
    x, label = x[:150], label[:150]
    other = np.where(np.arange(150) == 7, 9, label % 3)  # one cluster of a single row
    got = {r["model"]: r for r in score(frame(spark, x, a=label, b=other), ["a", "b"]).collect()}
    for name, given in (("a", label), ("b", other)):
        assert got[name]["silhouette"] == pytest.approx(ref.silhouette(x, given).mean(), abs=1e-9)
        assert got[name]["davies_bouldin"] == pytest.approx(ref.davies_bouldin(x, given))
        assert got[name]["calinski_harabasz"] == pytest.approx(ref.calinski_harabasz(x, given))


def test_silhouette_with_copies_and_small_blocks(spark, monkeypatch):
    from shoal.operators import quality
    monkeypatch.setattr(quality, "BLOCK_ROWS", 16)
    monkeypatch.setattr(quality, "STRIP_CELLS", 12)
    monkeypatch.setattr(quality, "TILE_ROWS", 5)
    rng = np.random.default_rng(3)
    x = np.vstack([np.repeat(rng.normal(size=(1, 3)), 40, axis=0), rng.normal(size=(80, 3)) + 1000])
    label = np.array([0] * 40 + [int(v) for v in rng.integers(1, 4, 80)])
    got = {r["cluster"]: (r["n"], r["silhouette"]) for r in silhouette(frame(spark, x, label=label), ["label"]).collect()}
    want = ref.silhouette(x, label)
    for c in set(label):
        assert got[c][0] == (label == c).sum() and got[c][1] == pytest.approx(want[label == c].mean(), abs=1e-8)


def test_quality_limits(spark):
    df = frame(spark, [[0], [1], [2]], one=[0, 0, 0], all=[0, 1, 2], two=[0, 0, 1])
    for bad in ("one", "all"):
        with pytest.raises(ValueError):
            score(df, [bad])
    with pytest.raises(ValueError, match="compress"):
        silhouette(df, ["two"], max_pairs=4)


# -- K-Means -----------------------------------------------------------------------------------

def costs(x, centres):
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1).sum()


def test_kmeans_fits(spark, embeddings):
    x, _ = embeddings
    x = x[:200]
    df = frame(spark, x)
    many = kmeans_many(df, [2, 5], [42, 43])
    again = kmeans_many(df.repartition(3, "row_id"), [2, 5], [42, 43])
    for (seed, k), fit in many.items():
        label, inertia = costs(x, fit.centres)
        assert len(fit.centres) == k and fit.inertia == pytest.approx(inertia)
        assert np.allclose(fit.centres, again[seed, k].centres)
        assert [tuple(c) for c in fit.centres] == sorted(tuple(c) for c in fit.centres)
        got = {r["row_id"]: r["label"] for r in fit.assign(df).collect()}
        assert [got[i] for i in range(len(x))] == list(label)
    single = kmeans(df, 5)
    assert single.inertia == pytest.approx(costs(x, single.centres)[1])
    assert many[42, 5].inertia <= single.inertia * 1.05 and single.inertia <= many[42, 5].inertia * 1.05
    with pytest.raises(ValueError):
        kmeans(df, 201)
    with pytest.raises(ValueError):
        kmeans_many(df, [201], [1])


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(50, 2)) * 0.1 + c for c in ((0, 0), (10, 0), (0, 10), (10, 10))])
    fit = kmeans_many(frame(spark, x), [4], [1])[1, 4]
    corners = {tuple(np.abs(np.round(c))) for c in fit.centres}
    assert corners == {(0, 0), (0, 10), (10, 0), (10, 10)}


def test_kmeans_of_copies(spark):
    fit = kmeans_many(frame(spark, [[0.0], [0.0], [5.0], [5.0]]), [3], [1])[1, 3]
    assert fit.inertia == 0 and sorted(c[0] for c in fit.centres) == [0, 5]


def test_lloyd(spark):
    centres = lloyd(frame(spark, [[0], [2], [10], [12]]), [[0.0], [9.0], [100.0]], 3)
    assert centres.ravel().tolist() == [1.0, 11.0, 100.0]


def test_compress_counts_every_row(spark, embeddings):
    x, label = embeddings
    rows = compress(frame(spark, x[:200], label=label[:200]), 20)
    centres = summarise(rows, by=["label"])
    assert rows.count() == 200 and centres.agg(F.sum("weight")).first()[0] == 200
    total = np.sum([np.array(r["features"]) * r["weight"] for r in centres.collect()], axis=0)
    assert np.allclose(total, x[:200].sum(0))


# -- PCA --------------------------------------------------------------------------------------------

def test_pca_of_a_line(spark):
    found = pca(frame(spark, [[0, 0], [2, 2], [4, 4]]))
    assert np.allclose(found.loadings[0], [0.707107, 0.707107], atol=1e-6)
    assert np.allclose(found.variances, [8, 0], atol=1e-9)
    scores = sorted(found.scores.collect(), key=lambda r: r["row_id"])
    assert [r["pc1"] for r in scores] == pytest.approx([-2.828427, 0, 2.828427], abs=1e-6)
    with pytest.raises(ValueError):
        pca(frame(spark, [[1], [2]]))


def test_pca_against_numpy(spark, embeddings):
    x, _ = embeddings
    found = pca(frame(spark, x[:300] + 5))
    assert np.allclose(found.loadings @ found.loadings.T, np.eye(3), atol=1e-9)
    values, vectors = np.linalg.eigh(np.cov(x[:300].T))
    assert np.allclose(found.variances, values[::-1][:3])
    for i in range(3):
        v = vectors[:, -1 - i] * np.sign(vectors[np.abs(vectors[:, -1 - i]).argmax(), -1 - i])
        assert np.allclose(found.loadings[i], v, atol=1e-6)


# -- agglomerative --------------------------------------------------------------------------------

@pytest.mark.parametrize("linkage", LINKAGES)
@pytest.mark.parametrize("options", [{}, {"last_clusters": 12, "block_rows": 10}])
def test_trees(spark, embeddings, linkage, options):
    x = embeddings[0][:48]
    heights, parts = ref.agglomerate(x, linkage)
    tree = agglomerative(frame(spark, x), linkage, **options)
    assert np.allclose(sorted(r["height"] for r in tree.merges.collect()), np.sort(heights))
    cut = sorted(tree.cut(range(1, 11)).collect(), key=lambda r: r["row_id"])
    for k in range(1, 11):
        assert [r[f"k{k}"] for r in cut] == ref.numbered(parts[k]), (linkage, k)


@pytest.mark.parametrize("linkage", LINKAGES)
def test_blocks_too_far_apart_are_not_compared(spark, linkage):
    """Eight groups of points far from the origin: the tree is that of all pairs, over half of which are never looked at."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(20, 2)) + c for c in rng.uniform(-60, 60, size=(8, 2))]) + 1e4
    heights, parts = ref.agglomerate(x, linkage)
    tree = agglomerative(frame(spark, x), linkage, last_clusters=70, block_rows=10)
    assert np.allclose(sorted(r["height"] for r in tree.merges.collect()), np.sort(heights))
    assert [r["k8"] for r in sorted(tree.cut([8]).collect(), key=lambda r: r["row_id"])] == ref.numbered(parts[8])
    assert 0 < tree.search.compared < 0.5 * tree.search.possible


def test_rounds_down_to_one_cluster(spark, embeddings):
    x = embeddings[0][:24, :3]
    heights, parts = ref.agglomerate(x, "ward")
    tree = agglomerative(frame(spark, x), "ward", last_clusters=1)
    assert np.allclose(sorted(r["height"] for r in tree.merges.collect()), np.sort(heights))
    cut = sorted(tree.cut([3]).collect(), key=lambda r: r["row_id"])
    assert [r["k3"] for r in cut] == ref.numbered(parts[3])


def test_ward_heights(spark):
    tree = agglomerative(frame(spark, [[0], [2], [10], [12]]))
    assert sorted(r["height"] for r in tree.merges.collect()) == pytest.approx([2, 2, 14.142136], abs=1e-6)
    assert [r["k2"] for r in sorted(tree.cut([2]).collect(), key=lambda r: r["row_id"])] == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        tree.cut([5])


@pytest.mark.parametrize("linkage", LINKAGES)
def test_copies_and_ties(spark, linkage):
    """A grid has equal distances everywhere, and a third of the rows are one point."""
    x = [[i % 4, i // 4] for i in range(16)] + [[1, 1]] * 8
    heights, _ = ref.agglomerate(np.array(x, dtype=float), linkage)
    tree = agglomerative(frame(spark, x), linkage, last_clusters=3)
    assert tree.n_points == 16 and tree.merges.count() == 15
    if linkage == "single":  # other linkages have several valid trees
        assert np.allclose(sorted(r["height"] for r in tree.merges.collect()), np.sort(heights)[8:])
    labelled = tree.cut([2, 5])
    assert labelled.count() == 24 and labelled.select("k5").distinct().count() == 5
    assert labelled.filter("features = array(1d, 1d)").select("k5").distinct().count() == 1


def test_labels_reach_rows_without_broadcast(spark, embeddings, monkeypatch):
    from shoal.operators import agglomerative as module
    x = np.vstack([embeddings[0][:20], np.repeat(embeddings[0][:1], 30, axis=0)])
    tree = agglomerative(frame(spark, x))
    want = sorted(map(tuple, tree.cut([4]).select("row_id", "k4").collect()))
    monkeypatch.setattr(module, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(module, "HOT_SHARE", 10)
    assert sorted(map(tuple, tree.cut([4]).select("row_id", "k4").collect())) == want and len(want) == 50


def _moments(parts, x):
    middle = x.mean(0)
    assert parts.sizes.sum() == len(x)
    assert (parts.sizes[:, None] * parts.centres).sum(0) / len(x) == pytest.approx(middle)
    between = (parts.sizes * ((parts.centres - middle) ** 2).sum(1)).sum()
    assert parts.inertias.sum() + between == pytest.approx(((x - middle) ** 2).sum())


@pytest.mark.parametrize("merge_rows,parts", [(16_000, 1), (16_000, 7), (100, 23)])
def test_micro_clusters_add_up(spark, monkeypatch, merge_rows, parts):
    """Features add up to the table, through one task or several levels of merges, far from the origin, with copies."""
    monkeypatch.setattr(micro, "MERGE_ROWS", merge_rows)
    monkeypatch.setattr(micro, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(parts)
    x = np.vstack([rng.normal(size=(900, 3)), np.repeat([[5.0, 5, 5]], 400, axis=0), rng.normal(size=(5, 3)) + 300]) + 1e5
    found = micro_clusters(frame(spark, x).repartition(parts, "row_id"), 12)
    assert len(found.sizes) == 12 and (np.diff(found.centres[:, 0]) >= 0).all()
    _moments(found, x)
    rest = found.centres[:, 0] < 1e5 + 100
    assert found.sizes[~rest].sum() == 5  # what lies far off is not mixed with the rest
    assert found.inertias.sum() < 0.5 * ((x[:900] - x[:900].mean(0)) ** 2).sum()


def test_micro_clusters_of_few_rows(spark):
    x = np.array([[0.1, 7], [3, 4], [0.1, 7], [-1, 0]])
    found = micro_clusters(frame(spark, x), 5)
    assert found.centres.tolist() == [[-1, 0], [0.1, 7], [3, 4]] and found.sizes.tolist() == [1, 2, 1] and not found.inertias.any()
    one = micro_clusters(frame(spark, x), 1)
    _moments(one, x)
    assert found.table(spark).columns == ["micro", "weight", "features", "inertia"]
    with pytest.raises(ValueError, match="no rows"):
        micro_clusters(frame(spark, x).limit(0), 3)
    with pytest.raises(ValueError, match="micro-clusters"):
        micro_clusters(frame(spark, x), 0)


def test_micro_clusters_are_nearly_as_tight_as_kmeans(spark, embeddings):
    x = embeddings[0]
    df = frame(spark, x)
    labels = np.array([r["micro"] for r in compress(df, 20).orderBy("row_id").collect()])
    inertia = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels))
    assert inertia < 1.15 * kmeans(df, 20, max_iter=20).inertia


def test_micro_clusters_agree_on_separate_groups(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 2)) * 0.2 + c for c in ((0, 0), (9, 0), (0, 9))])
    got = {r["row_id"]: r["k3"] for r in agglomerative(frame(spark, x), micro=15).cut([3]).collect()}
    groups = [{got[i] for i in range(a, a + 60)} for a in (0, 60, 120)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_agglomerative_limits(spark):
    df = frame(spark, [[0], [1], [2]])
    with pytest.raises(ValueError, match="micro"):
        agglomerative(df, max_pairs=4)
    with pytest.raises(ValueError):
        agglomerative(df, "centroid")


# -- one answer, however it is computed ---------------------------------------------------------

def test_fit_does_not_depend_on_the_other_k(spark):
    x = np.random.default_rng(5).normal(size=(300, 3))
    df = frame(spark, x)
    alone = kmeans_many(df, [6], [42])[42, 6]
    among = kmeans_many(df, range(2, 11), [42])
    assert np.array_equal(alone.centres, among[42, 6].centres) and alone.inertia == among[42, 6].inertia
    assert sorted(among) == [(42, k) for k in range(2, 11)]


def test_fit_does_not_depend_on_input_splits(spark):
    x = np.random.default_rng(6).normal(size=(400, 2))
    fits = [kmeans(frame(spark, x).repartition(p), 5) for p in (1, 3, 8)]
    for fit in fits[1:]:
        assert fit.centres == pytest.approx(fits[0].centres) and fit.inertia == pytest.approx(fits[0].inertia)


@pytest.mark.parametrize("linkage", ["ward", "single"])
def test_cut_splits_copies(spark, linkage):
    x = [[0.0], [5.0], [0.0], [9.0], [5.0], [0.0]]
    tree = agglomerative(frame(spark, x), linkage)
    got = {r["row_id"]: tuple(r)[-4:] for r in tree.cut([2, 3, 4, 6]).select("row_id", "k2", "k3", "k4", "k6").collect()}
    assert [got[i][1] for i in range(6)] == [0, 1, 0, 2, 1, 0]
    assert [got[i][2] for i in range(6)] == [0, 1, 2, 3, 1, 0]
    assert [got[i][3] for i in range(6)] == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="3 distinct points and 3 copies"):
        tree.cut([7])


def test_davies_bouldin_in_tiles(spark, monkeypatch):
    from shoal.operators import quality
    monkeypatch.setattr(quality, "TILE_ROWS", 5)
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(90, 3)) + 100, np.arange(90) % 23
    got = score(frame(spark, x, label=label), ["label"], silhouette=None).first()
    assert got["davies_bouldin"] == pytest.approx(ref.davies_bouldin(x, label))
    monkeypatch.setattr(quality, "MAX_CENTRE_VALUES", 68)
    with pytest.raises(ValueError, match="23 clusters of 3 features"):
        score(frame(spark, x, label=label), ["label"], silhouette=None)
