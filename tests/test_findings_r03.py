"""What the findings of round 3 asked for: bounded memory and shuffles, with the same results."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest

import reference_math as ref
from shoal.functions.arrays import distance_tiles, distances, nearest
from shoal.llm import lm_score as scoring
from shoal.operators import agglomerative as trees
from shoal.operators import kmeans as fits
from shoal.operators import micro, quality


def frame(spark, x, **columns):
    rows = [(i, [float(v) for v in p], *[int(c[i]) for c in columns.values()]) for i, p in enumerate(np.asarray(x, float))]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>" + "".join(f", {n} int" for n in columns))


def test_last_clusters_are_few_whatever_is_asked_for(spark, monkeypatch):
    """hac_pruned: the matrix of the last clusters had half of the table in its rows."""
    x = np.random.default_rng(1).normal(size=(60, 2))
    monkeypatch.setattr(trees, "LAST_CLUSTERS", 20)
    seen = []
    finish = trees._finish

    def watched(items, linkage, *rest):
        seen.append(items.count())
        return finish(items, linkage, *rest)
    monkeypatch.setattr(trees, "_finish", watched)
    merges = trees.agglomerative(frame(spark, x), "ward", last_clusters=50).merges.collect()
    assert seen[0] <= 20
    assert len(merges) == 59
    assert sum(r["height"] ** 2 for r in merges) / 2 == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_davies_bouldin_holds_a_bounded_tile(spark, monkeypatch):
    """quality_many: a tile of centres met all centres at once."""
    monkeypatch.setattr(quality, "TILE_ROWS", 5)
    monkeypatch.setattr(quality, "BLOCK_ROWS", 7)

    def small(x, y, plain=quality.distances):
        assert len(x) <= 5 and len(y) <= 7
        return plain(x, y)
    monkeypatch.setattr(quality, "distances", small)
    x, label = np.random.default_rng(8).normal(size=(90, 3)) + 100, np.arange(90) % 23
    got = quality.score(frame(spark, x, label=label), ["label"], silhouette=None).first()
    assert got["davies_bouldin"] == pytest.approx(ref.davies_bouldin(x, label))
    x[3, 0] = np.nan
    assert np.isnan(quality.score(frame(spark, x, label=label), ["label"], silhouette=None).first()["davies_bouldin"])


def test_silhouette_shuffles_blocks_of_points(spark, monkeypatch):
    """analyze_segments, full_run_summary: every point was a row of its own, sent to every block."""
    monkeypatch.setattr(quality, "BLOCK_ROWS", 16)
    monkeypatch.setattr(quality, "TILE_ROWS", 5)
    written = {}

    def kept(df, name="table", plain=quality.materialise):
        written[name] = plain(df, name)
        return written[name]
    monkeypatch.setattr(quality, "materialise", kept)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(70, 3)), rng.normal(size=(50, 3)) + 4])
    a, b = np.arange(120) % 3, np.arange(120) // 70
    got = {(r["model"], r["cluster"]): r["silhouette"] for r in quality.silhouette(frame(spark, x, a=a, b=b), ["a", "b"]).collect()}
    for name, given in (("a", a), ("b", b)):
        want = ref.silhouette(x, given)
        for c in set(given.tolist()):
            assert got[name, c] == pytest.approx(want[given == c].mean(), abs=1e-9)
    assert written["blocks"].count() < 60


def test_kmeans_passes_read_packed_rows(spark):
    """kmeans_same_seed, kmeans_fit: every pass sent each number of each row to Python by itself."""
    x = np.random.default_rng(2).normal(size=(500, 3))
    rows = frame(spark, x, part=np.arange(500) % 2).selectExpr("part", "row_id AS id", "features", "1.0D AS weight").coalesce(1)
    packed = fits._packed(rows, {0: np.zeros(3), 1: np.ones(3)})
    assert packed.count() == 2
    parts = {p: (ids, points, w) for p, ids, points, w in fits._by_part(packed.toArrow().to_batches())}
    assert parts[1][0].tolist() == list(range(1, 500, 2)) and (parts[1][2] == 1).all()
    assert np.allclose(parts[1][1], x[1::2] - 1) and np.allclose(parts[0][1], x[::2])


def test_bigrams_that_occur_once_are_not_joined(spark, monkeypatch):
    """op10_lm_score: every bigram of a single document was written, shuffled and joined, only to find no other document."""
    written = {}

    def kept(df, name="table", plain=scoring.materialise):
        written[name] = plain(df, name)
        return written[name]
    monkeypatch.setattr(scoring, "materialise", kept)
    texts = ["a b c a b", "b c d a", None, "d c b a a", "c x a y d x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = [(t or "").split() for t in texts]
    pairs = [Counter(zip(w, w[1:])) for w in words]
    single, double = Counter(x for w in words for x in w), sum(pairs, Counter())
    for hot in (0, 2, 100):
        got = {r["doc_id"]: r for r in scoring.lm_scores(docs, hot=hot, hot_pairs=0).collect()}
        for i, w in enumerate(words):
            micro, backoff = 0, 0
            for at, x in enumerate(w):
                own = pairs[i][w[at - 1], x] if at else 0
                left = double[w[at - 1], x] - own if at else 0
                backoff += at > 0 and left == 0
                share = left / single[w[at - 1]] if left else (0.4 if at else 1) * single[x] / single.total()
                micro += math.floor(math.log(share) * 1e6 + 0.5)
            assert (got[i]["n_words"], got[i]["n_backoff"]) == (len(w), backoff)
            assert got[i]["log_score"] == pytest.approx(micro / 1e6, abs=1.5e-6 * max(1, len(w)))
    assert sorted(r["c"] for r in written["bigrams"].collect()) == sorted(n for n in double.values() if n > 1)


def test_distance_tiles_share_their_memory():
    """analyze_k, k_sweep, train_*: every tile of the silhouette took fresh memory and two more passes for the norms."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(23, 3)), rng.normal(size=(11, 3)) * 5
    places, seen = set(), []
    for a, d in distance_tiles(x, y, 5):
        places.add(d.__array_interface__["data"][0])
        assert a == len(seen) and len(d) <= 5
        seen.extend(d.copy())
    assert len(places) == 1
    assert np.allclose(seen, distances(x, y)) and np.allclose(seen, np.sqrt(((x[:, None] - y[None, :]) ** 2).sum(2)))
    assert trees.TILE_ROWS * trees.BLOCK_ROWS <= 1 << 18


@pytest.mark.parametrize("given, left", [("64m", 1 << 23), ("1g", 1 << 23), ("1024k", "1024k"), ("4096b", "4096b"), ("1000", "1000")])
def test_blocks_of_the_silhouette_come_in_bounded_batches(spark, given, left):
    """batch_run: one batch held all blocks that a task of the silhouette read; it grew with the table."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    x, a = np.random.default_rng(3).normal(size=(40, 2)), np.arange(40) % 3
    try:
        spark.conf.set(name, given)
        got = {r["cluster"]: r["silhouette"] for r in quality.silhouette(frame(spark, x, a=a), ["a"]).collect()}
        assert spark.conf.get(name) == str(left)
    finally:
        spark.conf.set(name, before)
    want = ref.silhouette(x, a)
    assert got == pytest.approx({c: want[a == c].mean() for c in range(3)}, abs=1e-9)


def test_rows_meet_many_centres_in_bounded_memory():
    """batch_run: a batch met all pivots of the tree at once, whose number grows with the table."""
    rng = np.random.default_rng(5)
    x, centres = rng.normal(size=(10_000, 2)), rng.normal(size=(3_000, 2))
    held = micro.Features(2_000, x[0])
    held.append(np.ones(7_000), rng.normal(size=(7_000, 2)), np.zeros(7_000))
    rows = held.mean[:micro.CHUNK_ROWS].copy()
    tracemalloc.start()
    found = nearest(x, centres)
    held._add(rows, np.ones(len(rows)))
    partner, _ = held._partners()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20
    for i in range(0, 10_000, 1_000):
        assert (found[i:i + 1_000] == distances(x[i:i + 1_000], centres).argmin(1)).all()
    assert (held.n[:len(rows)] == 2).all() and (held.n[len(rows):] == 1).all()
    for i in (0, 3_000, 6_999):
        cost = ((held.mean - held.mean[i]) ** 2).sum(1) * held.n * held.n[i] / (held.n + held.n[i])
        cost[i] = np.inf
        assert partner[i] == cost.argmin()
