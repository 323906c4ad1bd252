"""Centroid clustering (Lloyd's rounds) in integers, with column expressions alone.

* A vector becomes integers: ``floor(SCALE * x)`` of each component, x as double.
* The start: the ``k`` vectors with the smallest lowercase-hex sha256 of ``<seed>:<vec_id>``, in the order of the hashes.
* A round: ``zip_with`` and ``aggregate`` give a vector's squared distance to each centroid, which stands in the plan as a
  literal array; ``array_min`` over structs of (distance, number) chooses, so ties go to the smaller number; one sum for
  each component and cluster, combined before the shuffle, moves the centroids to the exact ``floor(sum / count)``.  A
  cluster without vectors keeps its centroid.
* A round sends ``k`` rows to the driver, however many vectors there are, and no vector is ever shuffled: a cluster with a
  third of all rows is summed where its rows lie.

Vectors that are null, of another size, or hold null or non-finite components take no part and don't come out.  Neither
clashing columns (those named as outputs are replaced) nor further ones matter.  Rows that repeat an id or a vector each
count.  A row without an id is clustered but starts no centroid while rows with an id are left; ties of the hash go to the
smaller vector.  Fewer than ``k`` vectors give as many centroids as vectors; an empty table gives an empty result.

Distances must fit in 64 bits, so a vector with a component beyond ``MOST`` after scaling (131,072 before it) comes out
with null as cluster, distance and digest, and moves no centroid.  An inertia that no 64-bit integer holds is null.
Component sums are exact below 2**36 vectors a cluster at the largest components, and below 2**53 at unit length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.base import scratch, table

SIZE = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
MOST = 1 << 27
OUTPUTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
_EXACT = "decimal(38,0)"


def usable(vector: Column, size: int) -> Column:
    """Of ``size`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def squared_distance(v: Column, centroid: list[int]) -> Column:
    """Of an array of integers to a literal one."""
    other = F.lit(centroid).cast("array<bigint>")
    return F.aggregate(F.zip_with(v, other, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda total, x: total + x)


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct of distance and number of the nearest centroid; ties go to the smaller number."""
    return F.array_min(F.array(*[F.struct(squared_distance(v, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def _start(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    first = rows.where(F.col("comparable")).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return [r.v for r in first.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()]


def _moved(rows: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The centroids after one round."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(size)]
    found = rows.where(F.col("comparable")).select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    out = list(centroids)
    for r in found:
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
    return out


def _by_number(values: list, kind: str) -> Column:
    """The value of a row's cluster."""
    return F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))


def _long(total: int) -> int | None:
    return total if total < 1 << 63 else None


def kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """``vectors`` (vec_id, embedding and more) with cluster, distance and inertias, and the final centroids.

    The rows come from a folder of the shared path, which stays until the result is no longer needed.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "integers")
    comparable = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) <= MOST)
    kept = vectors.drop("v", "comparable", *OUTPUTS).where(usable(F.col("embedding"), size)).withColumn("comparable", comparable)
    kept = kept.withColumn("v", F.when(F.col("comparable"), integers(F.col("embedding"), scale)))
    kept.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    centroids = _start(rows, k, seed)
    if not centroids:
        empty = [F.lit(None).cast(t).alias(c) for c, t in zip(OUTPUTS, ("int", "bigint", "bigint", "bigint", "string"), strict=True)]
        return rows.drop("v", "comparable").select("*", *empty), []
    for _ in range(rounds):
        centroids = _moved(rows, centroids, size)
    assigned = rows.withColumn("nearest", F.when(F.col("comparable"), nearest(F.col("v"), centroids)))
    assigned = assigned.select("*", F.col("nearest.cluster").alias("cluster"), F.col("nearest.distance").alias("distance")).drop("v", "comparable", "nearest")
    totals = {r.cluster: int(r.total) for r in assigned.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast(_EXACT)).alias("total")).collect()}
    digests = [_sha256(",".join(map(str, c))) for c in centroids]
    out = assigned.select(
        "*",
        _by_number([_long(totals.get(i, 0)) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.when(F.col("cluster").isNotNull(), F.lit(_long(sum(totals.values()))).cast("bigint")).alias("inertia"),
        _by_number(digests, "string").alias("centroid_sha256"),
    )
    return out, centroids


def _sha256(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", *OUTPUTS)


def _oracle() -> str:
    """The rounds one after the other, each over (row, component) pairs."""
    rows = f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {SIZE} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {SIZE}),
        parts AS MATERIALIZED (SELECT rn, vec_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {SIZE + 1}) AS t(i)),
        picked AS (SELECT rn, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {CLUSTERS}),
        c0 AS MATERIALIZED (SELECT k, i, x FROM picked JOIN parts USING (rn))"""
    for r in range(ROUNDS + 1):
        rows += f""",
        d{r} AS MATERIALIZED (SELECT p.rn, c.k, sum((p.x - c.x) * (p.x - c.x)) AS d FROM parts p JOIN c{r} c USING (i) GROUP BY p.rn, c.k),
        n{r} AS MATERIALIZED (SELECT rn, arg_min(k, d * {CLUSTERS} + k) AS k, min(d) AS d FROM d{r} GROUP BY rn)"""
        if r < ROUNDS:
            rows += f""",
        s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM parts JOIN n{r} USING (rn) GROUP BY k, i),
        c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{r} c LEFT JOIN s{r} USING (k, i))"""
    last = ROUNDS
    return f"""WITH {rows},
        totals AS (SELECT k, CAST(sum(d) AS BIGINT) AS t FROM n{last} GROUP BY k),
        digests AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{last} GROUP BY k)
        SELECT vec_id, CAST(n{last}.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, t AS cluster_inertia,
            CAST((SELECT sum(t) FROM totals) AS BIGINT) AS inertia, h AS centroid_sha256
        FROM kept JOIN n{last} USING (rn) JOIN totals USING (k) JOIN digests USING (k)"""


ORACLE = _oracle()
