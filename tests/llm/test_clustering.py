"""Centroid clusters against a literal version."""

import hashlib
import math
import random

import pytest

from spanwave.llm import clustering, queries

FOLDER = "/root/testdata/sf0.01"


def brute(rows: list[tuple], clusters=8, rounds=10, width=64, scale=1024, seed=3) -> list[tuple]:
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centroids = [v for _, v in sorted(named)[:clusters]]
    if not centroids:
        return []
    gap = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    assign = lambda: [min((gap(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, of) in zip(kept, near, strict=True) if of == k]
            if own:
                centroids[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    near = assign()
    inertia = {k: sum(d for d, of in near if of == k) for k in range(len(centroids))}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return [(i, k, d, inertia[k], sum(inertia.values()), digest(centroids[k])) for (i, _), (d, k) in zip(kept, near, strict=True)]


def same(got: list, want: list) -> None:
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    same(queries.op11_centroid_clusters(spark, FOLDER).collect(), brute(rows))


@pytest.mark.parametrize("n", [3, 40])
def test_edges(spark, n):
    rng = random.Random(n)
    vector = lambda: [rng.choice([-0.5, 0.25, 1.0, rng.random()]) for _ in range(4)]
    rows = [(i, vector()) for i in range(n)]
    rows += [rows[0], rows[0], (1, vector()), (1, [0.0] * 4), (None, vector()), (None, None), (90, None), (91, [])]
    rows += [(92, [1.0, None, 0.0, 0.0]), (93, [float("nan")] * 4), (94, [float("-inf"), 0.0, 0.0, 0.0]), (95, [1.0] * 5)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    same(clustering.cluster(table, width=4).collect(), brute(rows, width=4))


def test_none_and_out_of_range(spark):
    fields = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], fields)).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, None), (None, [1.0, 2.0])], fields), width=2).collect() == []
    with pytest.raises(Exception, match="out of range"):
        clustering.cluster(spark.createDataFrame([(1, [1e30, 0.0])], fields), width=2).collect()


def test_plan_has_no_python(spark):
    plan = queries.op11_centroid_clusters(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
