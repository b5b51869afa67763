"""Centroid clustering of integer vectors in Spark expressions.

``zip_with`` and ``aggregate`` give the squared integer distance of a vector to each centroid, which is a literal array;
``array_min`` over structs of distance and number chooses the cluster, so that a tie goes to the smaller number. A round
is one aggregation with one sum for each component; at most ``clusters`` rows of sums come to the driver, where whole
numbers give the exact floors. Vectors are turned into integers once and stored; every round reads that table.

Defined results: a vector that is null, has another number of components, or a component that is null, NaN or infinite
is left out. Components beyond +-10**17 after scaling count as that. Where squares or sums could leave 64 bits, all is
counted in decimals of 38 digits; a distance or inertia that then does not fit into a long is null. Repeated rows are
vectors of their own. Start vectors come in the order of their digests, equal ids by their components, null ids last;
with fewer vectors than ``clusters`` there are as many clusters as vectors. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, "3:"
FARTHEST, LONG_SQUARES, LONG_SUMS, WIDE = 10 ** 17, 1 << 27, 1 << 62, "decimal(38,0)"


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Stored: vec_id, v (array of long) of the vectors that count."""
    finite = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where((F.size("x") == components) & finite)
    held = lambda x: F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), x * scale))
    return stored(rows.select("vec_id", F.transform("x", lambda x: F.floor(held(x))).alias("v")), "integer-vectors")


def number_kind(rows: DataFrame) -> str:
    """Type in which no square or sum can overflow."""
    size = F.greatest(F.array_max("v"), -F.array_min("v"))
    most = rows.agg(F.max(size).alias("size"), F.count("*").alias("n")).first()
    return "bigint" if (most["size"] or 0) <= LONG_SQUARES and (most["size"] or 0) * most["n"] < LONG_SUMS else WIDE


def nearest(v: Column, centroids: list[list[int]], kind: str) -> Column:
    """Struct of squared distance and number of the nearest centroid."""
    def distance(centroid: list[int]) -> Column:
        literal = F.array(*[F.lit(c).cast(kind) for c in centroid])
        squares = F.zip_with(v, literal, lambda x, c: ((x.cast(kind) - c) * (x.cast(kind) - c)).cast(kind))
        return F.aggregate(squares, F.lit(0).cast(kind), lambda total, s: (total + s).cast(kind))

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def start_vectors(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in rows.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(clusters).collect()]


def moved(rows: DataFrame, centroids: list[list[int]], kind: str) -> list[list[int]]:
    """The centroids after one round; one without vectors stays where it is."""
    sums = [F.sum(F.get("v", F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(len(centroids[0]))]
    assigned = rows.select("v", nearest(F.col("v"), centroids, kind)["cluster"].alias("cluster"))
    out = list(centroids)
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(len(centroids[0]))]
    return out


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    components: int = COMPONENTS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts, and the final
    centroids."""
    rows = integer_vectors(vectors, vec_id, embedding, components, scale)
    kind = number_kind(rows)
    centroids = start_vectors(rows, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids, kind)
    best = nearest(F.col("v"), centroids, kind) if centroids else F.lit(None).cast(f"struct<distance:{kind},cluster:int>")
    assigned = rows.select("vec_id", best.alias("best")).select("vec_id", "best.cluster", "best.distance")
    assigned = stored(assigned, "assigned-vectors")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(WIDE)).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    of_cluster = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
    out = assigned.select(
        "vec_id", "cluster", F.col("distance").try_cast("bigint").alias("distance"),
        of_cluster([fits(sums.get(k, 0)) for k in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(fits(sum(sums.values()))).cast("bigint").alias("inertia"), of_cluster([centroid_digest(c) for c in centroids], "string").alias("centroid_sha256"))
    return out, centroids
