"""Centroid clustering of integer vectors with JVM expressions only.

Vectors are staged once as integer arrays. A round is one pass: every vector meets the centroids, which
stand in the plan as literal arrays (``zip_with`` and ``aggregate`` give the squared distances,
``array_min`` of structs the nearest), and one sum a component and cluster is added up inside the
tasks before anything is shuffled. Only those sums, clusters x components, come to the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwave.llm.storage import discard, quoted, stage

CLUSTERS = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024
SEED = 3
#: Squared distances of components within this bound fit a 64-bit integer.
MAX_COMPONENT = 1 << 27


def scaled(values: Column, scale: int) -> Column:
    """Components as the integers ``floor(scale * x)``; one beyond ``MAX_COMPONENT`` fails the query."""
    whole = F.transform(values, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    inside = (F.array_max(whole) <= MAX_COMPONENT) & (F.array_min(whole) >= -MAX_COMPONENT)
    return F.when(inside, whole).otherwise(F.raise_error(F.lit("a vector component is out of range")).cast("array<bigint>"))


def usable(values: Column, width: int) -> Column:
    """Whether a vector has exactly ``width`` components, none null or non-finite."""
    number = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce((F.size(values) == width) & F.forall(values, number), F.lit(False))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0).cast("long"), lambda total, p: total + p)


def nearest(vector: Column, square: Column, centroids: list[list[int]]) -> Column:
    """``struct(distance, cluster)`` of the nearest centroid, the smaller number on ties.

    The squared distance is ``square``, the vector's product with itself, less its product with the
    centroid doubled, plus the centroid's own square: the same integer with one product a component.
    """

    def gap(c: list[int]) -> Column:
        twice = F.expr(f"array({', '.join(f'{2 * int(y)}L' for y in c)})")
        return square - dot(vector, twice) + F.lit(sum(int(y) ** 2 for y in c))

    pairs = [F.struct(gap(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]
    return F.array_min(F.array(*pairs))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:id``, in the order of the hashes."""
    named = vectors.where("id is not null").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "v"
    )
    return [list(r.v) for r in named.orderBy("hash", "v").limit(clusters).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid replaced by the exact floor of its vectors' mean."""
    assigned = vectors.select("v", nearest(F.col("v"), F.col("square"), centroids)["cluster"].alias("cluster"))
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    means = {r.cluster: [s // r.n for s in r[2:]] for r in found}
    return [means.get(i, c) for i, c in enumerate(centroids)]


def cluster(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per usable vector: ``id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Usable vectors have exactly ``width`` components, none null, NaN or infinite; other rows, null
    and empty vectors among them, have no row. Components become ``floor(scale * x)``. Ties go to the
    centroid of the smaller number. Rows that repeat an id are vectors of their own; such rows
    stand at the start in the order of their components. Rows without an id are clustered but never
    start a centroid. With fewer vectors than ``clusters`` there are as many centroids as vectors;
    without a vector that has an id, or from an empty table, no row comes out. Other columns are not read. A component beyond
    ``MAX_COMPONENT`` after scaling fails the query, as a distance might not fit 64 bits.

    A round that moves no centroid ends the rounds, as all later ones would repeat it.
    """
    given = table.select(quoted(id_col).alias("id"), quoted(vector_col).alias("v"))
    kept = given.where(usable(F.col("v"), width))
    whole = kept.select("id", scaled(F.col("v"), scale).alias("v"))
    vectors = stage(whole.withColumn("square", dot(F.col("v"), F.col("v"))))
    centroids = first_centroids(vectors, clusters, seed)
    kind = table.schema[id_col].dataType
    if not centroids:
        fields = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        none = table.sparkSession.createDataFrame([], f"id int, {fields}")
        return none.select(F.col("id").cast(kind).alias(id_col), *none.columns[1:])
    for _ in range(rounds):
        before, centroids = centroids, moved(vectors, centroids)
        if centroids == before:
            break
    done = stage(vectors.select("id", nearest(F.col("v"), F.col("square"), centroids).alias("near")).select("id", "near.*"))
    discard(vectors)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    totals = done.groupBy(F.col("cluster").alias("of")).agg(F.sum("distance").alias("cluster_inertia"))
    # One row a cluster.
    report = totals.withColumn("inertia", totals.agg(F.sum("cluster_inertia")).scalar())
    return done.join(F.broadcast(report), done["cluster"] == report["of"]).select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )
