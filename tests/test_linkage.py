import numpy as np

from changelens.operators import linkage, mining

DDL = "g STRING, pos LONG, embedding ARRAY<DOUBLE>"


def by_group(df):
    return sorted(map(tuple, df.select("g", "pos", "cluster", "size", "medoid").collect()))


def test_rounds_give_the_clusters_of_one_task(spark):
    threshold, block = 0.6, 7
    rng = np.random.default_rng(3)
    data = []
    for g, n in (("a", 45), ("b", 20), ("c", 1)):
        middles = rng.normal(0, 1, (5, 8))
        data += [(g, 3 * i, (middles[rng.integers(5)] + rng.normal(0, 0.5, 8)).tolist()) for i in range(n)]
    rows = spark.createDataFrame(data, DDL).repartition(3)
    want = by_group(mining.clusters(rows, "g", threshold))
    assert by_group(linkage.linked_clusters(rows, "g", threshold, block)) == want
    assert by_group(mining.clusters(rows, "g", threshold, in_task=30)) == want


def test_equal_and_empty_vectors(spark):
    data = [("a", i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(9)] + [("a", 20, [0.0, 0.0])]
    rows = spark.createDataFrame(data, DDL)
    got = by_group(linkage.linked_clusters(rows, "g", 0.9, 3))
    assert [(c, s) for _, _, c, s, _ in got] == [(i % 2, 5 - i % 2) for i in range(9)] + [(2, 1)]
    assert linkage.linked_clusters(spark.createDataFrame([], DDL), "g", 0.5).count() == 0


def test_a_group_of_few_clusters_left_is_ended_in_one_task(spark, monkeypatch):
    # every vector is nearest to the one before it: a round joins one pair
    angles = np.cumsum([0.001 * 1.08**i for i in range(50)])
    data = [("a", i, [float(np.cos(x)), float(np.sin(x))]) for i, x in enumerate(angles)]
    rows = spark.createDataFrame(data, DDL)
    want = by_group(mining.clusters(rows, "g", 0.9, in_task=50))
    rounds, nearest = [], linkage.nearest_clusters
    monkeypatch.setattr(linkage, "nearest_clusters", lambda *x: rounds.append(1) or nearest(*x))
    assert by_group(mining.clusters(rows, "g", 0.9, in_task=46)) == want
    assert 1 <= len(rounds) <= 4


def test_thousands_of_clusters_take_no_round(spark, monkeypatch):
    v = np.random.default_rng(5).normal(size=(2300, 6))
    v[7] = np.nan  # near to nothing
    rows = spark.createDataFrame([("a", 2 * i, x.tolist()) for i, x in enumerate(v)], DDL)
    monkeypatch.setattr(linkage, "nearest_clusters", lambda *x: 1 / 0)
    got = {}
    for _, pos, cluster, _, _ in by_group(mining.clusters(rows, "g", 0.8)):
        got.setdefault(cluster, []).append(pos // 2)
    assert [got[c] for c in sorted(got)] == mining.average_linkage(v, 0.8)
    assert [7] in got.values()


def test_blocks_are_multiplied_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = np.r_[rng.normal(size=(40, 3)), rng.integers(-1, 2, (40, 3)) + 0.0, np.full((1, 3), np.nan)]  # with equal means
    rows = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)], DDL)
    monkeypatch.setattr(linkage, "ROWS", 4, raising=False)
    got = {}
    for _, pos, cluster, _, _ in by_group(linkage.linked_clusters(rows, "g", 0.7, 11)):
        got.setdefault(cluster, []).append(pos)
    assert [got[c] for c in sorted(got)] == mining.average_linkage(v, 0.7)


def test_equal_vectors_take_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = np.r_[np.repeat(rng.normal(size=(6, 4)), 7, 0), np.zeros((3, 4)), np.full((2, 4), 1e-13)]
    v = v[rng.permutation(len(v))]
    rows = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)], DDL)
    rounds, nearest = [], linkage.nearest_clusters
    monkeypatch.setattr(linkage, "nearest_clusters", lambda *x: rounds.append(1) or nearest(*x))
    got = {}
    for _, pos, cluster, _, _ in by_group(linkage.linked_clusters(rows, "g", 0.9)):
        got.setdefault(cluster, []).append(pos)
    assert [got[c] for c in sorted(got)] == mining.average_linkage(v, 0.9)
    assert len(rounds) <= 2
