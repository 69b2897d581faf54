"""Hard negatives and clustering against brute force, on random, clustered and awkward vectors."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrain.llm import clustering, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def f32(v):
    import numpy as np

    return [float(np.float32(x)) for x in v]


def mined(rows, every=10, n_pos=5, n_neg=10):
    """Rows as (id, vector, label), ids distinct."""
    rows = [(i, [math.floor(256 * x) for x in f32(v)], lab) for i, v, lab in rows if i is not None and lab is not None and good(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, v, lab in rows:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for j, w, other in rows if j != i)
        for minus_p, p, _ in [s for s in scored if s[2] == lab][:n_pos]:
            fits = [(-m, j) for m, j, other in scored if other != lab and 30 * -minus_p <= 100 * -m <= 90 * -minus_p]
            out += [(i, p, rank, j, -minus_p, s) for rank, (s, j) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def cloud(n, width, seed, centres=0, spread=0.05):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    rows = []
    for i in range(n):
        v = [r.gauss(0, 0.3) for _ in range(width)] if not centres else [x + r.gauss(0, spread) for x in middle[i % centres]]
        rows.append((i, v, r.randrange(4)))
    return rows


def run(df, **more):
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("centres", [0, 6])
def test_negatives_are_those_of_brute_force(spark, centres):
    rows = cloud(240, 8, 3 + centres, centres)
    # Small groups and parts, so that anchors, cells and rows are split.
    assert run(table(spark, rows), n_pivots=12, group_anchors=5, part_rows=50) == mined(rows)


def test_negatives_of_awkward_rows(spark):
    r = random.Random(4)
    rows = cloud(60, 4, 9)
    rows += [(100, None, 1), (110, [1.0, None, 0.0, 0.0], 1), (120, [1.0, float("nan"), 0.0, 0.0], 1), (130, [float("inf"), 0.0, 0.0, 0.0], 2), (None, [0.1] * 4, 1), (140, [0.1] * 4, None)]
    rows += [(200 + i, [0.25, 0.5, 0.0, 0.0], r.randrange(2)) for i in range(40)]  # ties
    rows += [(300, [0.0] * 4, 1), (310, [], 2), (311, [0.5], 2)]  # a vector of zeros, and shorter ones
    full = [(i, v + [0.0] * (4 - len(v)) if good(v) else v, lab) for i, v, lab in rows]
    assert run(table(spark, rows), n_pivots=6, group_anchors=3, part_rows=20) == mined(full)
    assert run(table(spark, [])) == []
    assert run(table(spark, [(10, [1.0, 0.0], 1)])) == []


def test_a_repeated_row_is_a_candidate_each_time(spark):
    rows = [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [0.5, 0.0], 2), (12, [0.5, 0.0], 2), (10, [1.0, 0.0], 1)]
    assert run(table(spark, rows)) == [(10, 11, 1, 12, 65536, 32768), (10, 11, 2, 12, 65536, 32768)]


def test_a_row_goes_only_where_it_may_serve(spark):
    import numpy as np

    rows = cloud(400, 8, 5, 8, 0.01)
    df = negatives.participants(table(spark, rows))
    anchors = F.col("vec_id") % 10 == 0
    s = negatives.space(df, anchors, 16, 5)
    cells = negatives.in_cells(df, s, False)
    close = np.zeros((1, len(s.pivots)))
    n_bundles = int(s.bundle.max()) + 1
    every = negatives._served(cells, s, np.full((1, len(s.pivots)), np.inf), close, close, np.ones((1, n_bundles), int), 1).count()
    near = negatives._served(cells, s, np.full((1, len(s.pivots)), 60.0), close + 30, close, np.ones((1, n_bundles), int), 1).count()
    assert near < every / 3


def lloyd(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * x) for x in f32(v)]) for i, v, _ in rows if good(v) and len(v) == width]
    key = lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (key(r), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))  # noqa: B905, E731
    for step in range(rounds + 1):
        owner = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step == rounds:
            break
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, o) in zip(kept, owner, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = sum(d for d, _ in owner)
    of = {j: sum(d for d, o in owner if o == j) for j in range(len(centroids))}
    return sorted(((-1 if i is None else i), o, d, of[o], inertia, hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(kept, owner, strict=True))


def clusters(df):
    got = clustering.digests(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)


@pytest.mark.parametrize("centres", [0, 10])
def test_clusters_are_those_of_whole_rounds(spark, centres):
    rows = cloud(150, 64, 21 + centres, centres)
    assert clusters(table(spark, rows)) == lloyd(rows)


def test_clusters_of_awkward_rows(spark):
    rows = cloud(30, 64, 2) + [(50 + i, [0.5] * 64, 1) for i in range(25)]
    rows += [(90, None, 1), (91, [], 1), (92, [0.1] * 63, 1), (93, [0.1] * 63 + [float("nan")], 1), (94, [None] + [0.1] * 63, 1), (95, [float("-inf")] + [0.1] * 63, None), (None, [0.25] * 64, 1), (50, [0.5] * 64, 1)]
    assert clusters(table(spark, rows)) == lloyd(rows)
    assert clusters(table(spark, [])) == []
    few = [(3, [0.1] * 64, None), (4, [-0.9] * 64, 2)]
    assert clusters(table(spark, few)) == lloyd(few)


def test_rounds_of_any_number_and_width(spark):
    rows = cloud(200, 3, 8, 5, 0.4)
    state, _ = clustering.clustered(table(spark, rows), k=7, rounds=6, width=3)
    got = sorted((r.vec_id, r.cluster, r.distance) for r in state.collect())
    assert got == [(i, c, d) for i, c, d, *_ in lloyd(rows, 7, 6, 3)]


def test_only_vectors_of_a_centroid_that_went_away_meet_all(spark):
    x = [[0, 0], [10, 0], [4, 0]]
    state = spark.createDataFrame([(1, x[0], 0, 1), (2, x[1], 1, 4), (3, x[2], 0, 9)], "vec_id long, q array<int>, cluster int, distance long")
    # Centroid 1 stands still; 0 went from (1, 0) to (-3, 0).
    got = {r.vec_id: (r.cluster, r.distance, r.was) for r in clustering.reassigned(state, {0: [-3, 0], 1: [8, 0]}, [0]).collect()}
    assert got == {1: (0, 9, 0), 2: (1, 4, 1), 3: (1, 16, 0)}
