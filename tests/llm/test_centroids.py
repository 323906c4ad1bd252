import hashlib
import math
import random

from vantage.llm import centroids


def brute(rows, k, rounds, size=64):
    """(vec_id, cluster, distance) sorted, and the centroids, in plain Python."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    close = [(i, v) for i, v in kept if max(map(abs, v)) <= centroids.MOST]
    centres = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "z", v) for i, v in close)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in close:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, centres)]
    found = [(i, *(near(v)[::-1] if max(map(abs, v)) <= centroids.MOST else (None, None))) for i, v in kept]
    return found, centres


def _key(x):
    return tuple((y is None, y or 0) for y in x)


def test_kmeans(spark):
    rng = random.Random(4)
    blob = lambda m: [rng.gauss(m, 0.3) for _ in range(64)]
    rows = [(i, blob(i % 3 - 1.0)) for i in range(90)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(5, rows[7][1]), (5, rows[8][1]), (None, rows[9][1])]  # a hot vector, a repeated id, no id
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.1] * 63), (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63), (207, [0.0] * 64), (208, [-1e30] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "c", "v", i) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v string, label long").repartition(5)
    out, centres = centroids.kmeans(df)
    assert out.columns == ["vec_id", "embedding", "label", *centroids.OUTPUTS]
    got = out.collect()
    want, want_centres = brute(rows, 8, 10)
    assert centres == want_centres
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=_key) == sorted(want, key=_key)
    total = sum(d for _, c, d in want if c is not None)
    for r in got:
        if r.vec_id == 208:
            assert r[-5:] == (None,) * 5
        else:
            assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
            assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centres[r.cluster])).encode()).hexdigest()


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [float(i)] * 64) for i in (3, 4, 3)]
    out, centres = centroids.kmeans(spark.createDataFrame(rows, schema))
    assert len(centres) == 3 and sorted(r.distance for r in out.collect()) == [0, 0, 0]
    for none in ([], [(1, None)]):
        out, centres = centroids.kmeans(spark.createDataFrame(none, schema))
        assert out.collect() == [] and centres == [] and out.columns == ["vec_id", "embedding", *centroids.OUTPUTS]


def test_plan_has_no_python(spark):
    v = [[0.1 * i] * 64 for i in range(9)]
    out, _ = centroids.kmeans(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"))
    assert "Python" not in out._jdf.queryExecution().toString() and "Exchange" not in out._jdf.queryExecution().toString()
