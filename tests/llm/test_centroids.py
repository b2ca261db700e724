import hashlib

import numpy as np

from pagelake.llm import centroids as module
from pagelake.llm.centroids import DIMENSIONS, Bounds, centroid_clusters, squared


def lloyd(rows, k=16, rounds=3):
    """(cluster, distance, inertia of it, inertia, digest) by row of (id, components), with every distance."""
    kept = []
    for ident, x in rows:
        if x is not None and len(x) == DIMENSIONS and all(c is not None and np.isfinite(c) for c in x):
            scaled = [max(-(1 << 27), min(1 << 27, int(np.floor(64 * float(c))))) for c in x]
            kept.append((ident, scaled))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centers)):
            own = [v for (_, v), (_, to) in zip(kept, found, strict=True) if to == j]
            if own:
                centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, to in found if to == j) for j in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def rows_of(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def made(rng, n, spread=0.3):
    centers = rng.normal(size=(9, DIMENSIONS))
    return [(i, (centers[rng.integers(0, 9)] + spread * rng.normal(size=DIMENSIONS)).astype(np.float32).tolist()) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>"


def test_against_all_distances(spark):
    rows = made(np.random.default_rng(5), 400)
    assert rows_of(centroid_clusters(spark.createDataFrame(rows, SCHEMA).repartition(5))) == lloyd(rows)
    many = centroid_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), k=25, rounds=7)
    assert rows_of(many) == lloyd(rows, 25, 7)
    assert rows_of(centroid_clusters(spark.createDataFrame(rows, SCHEMA), k=5, rounds=0)) == lloyd(rows, 5, 0)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = made(rng, 30)
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [0.5] * 63 + [None]), (105, [float("nan")] + [0.0] * 63), (106, [float("-inf")] * 64)]
    ties = [(200 + i, [0.25] * DIMENSIONS) for i in range(6)]  # equal vectors, so equal first centroids and empty clusters
    rows = [*good, *bad, *ties, good[0], good[1], (None, good[2][1]), (None, [0.0] * DIMENSIONS), (300, [3e38] * 2 + [-3e38] * 62)]
    wide = spark.createDataFrame([(*r, -1, "x", -1, -1) for r in rows], SCHEMA + ", cluster int, v string, sums long, id long").repartition(4)
    # sums of squares beyond 64 bits are NULL
    expected = [tuple(None if isinstance(x, int) and x >= 1 << 63 else x for x in r) for r in lloyd(rows)]
    assert rows_of(centroid_clusters(wide)) == sorted(expected, key=str)


def test_few_and_no_vectors(spark):
    rows = made(np.random.default_rng(7), 3)
    assert rows_of(centroid_clusters(spark.createDataFrame(rows, SCHEMA))) == lloyd(rows)
    empty = centroid_clusters(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroid_clusters(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(8)
    centers = rng.integers(-200, 200, (12, DIMENSIONS))
    rows = (centers[rng.integers(0, 12, 3000)] + rng.integers(-20, 20, (3000, DIMENSIONS))).astype(np.int64)
    history = [rows[rng.choice(3000, 12, replace=False)]]
    state, scanned = Bounds.first(rows, history[0]), []
    for _ in range(8):
        moved = [rows[state.cluster == j].sum(0) // max(1, (state.cluster == j).sum()) if (state.cluster == j).any() else c for j, c in enumerate(history[-1])]
        history.append(np.array(moved))
        scanned.append(state.advance(rows, history))
        exact = squared(rows, history[-1])
        assert (state.cluster == exact.argmin(1)).all()
        gone = module.displacements(history)
        assert (state.lower - gone[state.lower_seen, np.arange(12)] <= np.sqrt(exact) * (1 + 1e-9)).all()
        own = np.sqrt(exact[np.arange(3000), state.cluster])
        assert (state.upper + gone[state.upper_seen, state.cluster] >= own * (1 - 1e-9)).all()
    assert scanned[-1] < 0.1 * rows.shape[0] * 12


def test_distances_are_exact_for_large_components():
    rng = np.random.default_rng(9)
    rows, centers = (rng.integers(-(1 << 27), 1 << 27, (5, DIMENSIONS)) for _ in range(2))
    expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in centers] for r in rows]
    assert squared(rows, centers).tolist() == expected


def test_older_rounds_are_deleted(spark):
    centroid_clusters(spark.createDataFrame(made(np.random.default_rng(10), 40), SCHEMA)).count()
    rounds = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/cluster-round-*")
    assert not rounds.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(rounds)
