import hashlib
import math
import random

import numpy as np
import pytest

from streamscore.llm import clustering
from streamscore.llm.queries import QUERIES


def plain(vectors, clusters=40, rounds=5):
    """The contract in Python integers; vectors are (id, components)."""
    points = []
    for key, x in vectors:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            points.append((key, [math.floor(256 * v) for v in x]))
    by_hash = lambda p: hashlib.sha256(f"2:{p[0]}".encode()).hexdigest()
    order = sorted((p for p in points if p[0] is not None), key=by_hash)
    centroids = [p[1] for p in [*order, *(p for p in points if p[0] is None)][:clusters]]

    def assign():
        out = []
        for _, x in points:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [x for (_, x), (c, _) in zip(points, found) if c == k]
            if own:
                centroids[k] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    inertia = sum(d for _, d in found)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        (str(key), c, d, sum(e for o, e in found if o == c), inertia, names[c])
        for (key, _), (c, d) in zip(points, found)
    )


def test_transform_is_exact_and_ordered():
    x = np.random.default_rng(1).integers(-300, 300, (50, 64))
    y = clustering.transform(x)
    assert (clustering.inverse(y) == x).all() and ((y**2).sum(1) == 64 * (x**2).sum(1)).all()
    signs = clustering.inverse(np.eye(64, dtype=np.int64) * 64)
    assert [(a[1:] != a[:-1]).sum() for a in signs] == list(range(64))


@pytest.mark.parametrize("spread", [3, 300, 1 << 20])
def test_nearest_against_all_distances(spread):
    rng = np.random.default_rng(spread)
    x, c = rng.integers(-spread, spread, (500, 64)), rng.integers(-spread, spread, (40, 64))
    c[7] = c[3]  # a tie goes to the smaller number
    x[:100] = c[rng.integers(0, 40, 100)] + rng.integers(-1, 2, (100, 64))
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    number, distance = clustering.nearest(clustering.transform(x), clustering.transform(c))
    assert (number == all_.argmin(1)).all() and (distance == 64 * all_.min(1)).all()


SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, n string, coefficients string"


def table(spark, vectors):
    return spark.createDataFrame([(k, x, "a", "b", "c", "d") for k, x in vectors], SCHEMA)


def rows_of(df):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in df.collect())


def test_odd_vectors(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1, 0, 0.25, rng.random()]) for _ in range(64)]
    same = vector()
    vectors = [(k, vector()) for k in range(60)] + [(60 + k, same) for k in range(300)]
    vectors += [(7, vector()), (8, same), (8, same), (None, vector()), (None, same), (400, None), (401, [])]
    vectors += [(402, vector()[:63]), (403, [*vector(), 1.0]), (404, [None, *vector()[1:]])]
    vectors += [(405, [math.nan, *vector()[1:]]), (406, [-math.inf, *vector()[1:]])]
    vectors = [(k, x and [None if v is None else float(np.float32(v)) for v in x]) for k, x in vectors]
    df = clustering.cluster(table(spark, vectors).repartition(5))
    assert rows_of(df) == plain(vectors)


def test_fewer_vectors_than_clusters_and_empty_tables(spark):
    rng = random.Random(6)
    vectors = [(k, [rng.randint(-9, 9) / 4 for _ in range(64)]) for k in (3, 1, None)]
    assert rows_of(clustering.cluster(table(spark, vectors))) == plain(vectors)
    assert clustering.cluster(table(spark, [])).count() == 0
    assert clustering.cluster(table(spark, [(1, [1.0])])).count() == 0
    with pytest.raises(Exception, match="below 8192"):
        clustering.cluster(table(spark, [(1, [9000.0] * 64)])).collect()


def test_query(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    want = plain([tuple(r) for r in vectors.collect()])
    assert rows_of(QUERIES["op13_centroids"](spark, sf_dir)) == want
