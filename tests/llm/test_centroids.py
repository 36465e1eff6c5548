"""Clustering against plain scans of all centroids, in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from fieldledger.llm import centroids
from pyspark.sql import functions as F


def plain(rows, k, rounds, dims, scale):
    """rows are (vec_id, vector); everything by the definition."""
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    chosen = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [list(x) for _, x in chosen]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        places = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            own = [x for (_, x), p in zip(kept, places, strict=True) if p == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=str)


def found(frame):
    return sorted((tuple(r)[:-1] for r in frame.collect()), key=str)


def test_against_plain_scans(spark):
    rng = random.Random(4)
    middle = [[rng.uniform(-3, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.4) for m in rng.choice(middle)]) for i in range(400)]
    # grids, so that distances tie; one vector in a third of all rows; repeated ids, null ids, and what takes no part
    rows += [(1000 + i, [float(rng.randint(-1, 1)) for _ in range(6)]) for i in range(200)]
    rows += [(2000 + i, [0.5] * 6) for i in range(300)]
    rows += [rows[0], (3, [1.0] * 6), (None, [0.25] * 6), (None, [-0.25] * 6)]
    rows += [(5000, None), (5001, []), (5002, [1.0] * 5), (5003, [1.0] * 5 + [None]), (5004, [1.0] * 5 + [float("nan")]), (5005, [1.0] * 5 + [float("inf")]), (5006, [1.0] * 7)]
    frame = spark.createDataFrame([(i, v, 7, "y") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(5)
    for k, rounds in ((7, 3), (16, 5), (1, 2), (2, 0)):
        got = centroids.cluster(frame, k, rounds, dims=6, scale=8)
        assert found(got) == plain(rows, k, rounds, 6, 8)
    # three means of two: fewer vectors than centroids, and none at all
    few = frame.where("vec_id < 3")
    assert found(centroids.cluster(few, 16, 3, 6, 8)) == plain([r for r in rows if r[0] is not None and r[0] < 3], 16, 3, 6, 8)
    assert centroids.cluster(frame.limit(0), dims=6).count() == 0


def test_balls_find_what_full_scans_find():
    rng = np.random.default_rng(2)
    for trial in range(60):
        k, spread = int(rng.integers(1, 12)), int(rng.integers(1, 40))
        x = rng.integers(-spread, spread + 1, (150, 4))
        before = rng.integers(-spread, spread + 1, (k, 4))
        centres = before + rng.integers(-2, 3, (k, 4)) * (trial % 3)
        cluster, upper, lower, _, _ = centroids.scan_all(x, centroids.Geometry.of(before))
        wanted = centroids.scan_all(x, centroids.Geometry.of(centres))
        got = centroids.scan_balls(x, centroids.Geometry.of(centres, before), cluster, upper, lower)
        assert (got[0] == wanted[0]).all()
        exact, near = np.sqrt(wanted[3]), wanted[2]
        assert (got[1] >= exact).all() and (got[2] <= near / centroids.DOWN).all()
        assert ((got[3] == wanted[3]) | (got[3] < 0)).all()


def test_bounds_spare_most_distances(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (16, 64))
    rows = [(i, (middle[i % 16] + rng.normal(0, 0.05, 64)).tolist()) for i in range(800)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    scanned = got.agg(F.sum("scanned")).first()[0]
    assert scanned < 0.5 * 4 * 16 * 800  # four assignments, sixteen centroids


def test_components_beyond_the_range_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(frame)
