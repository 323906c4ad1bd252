"""Approximate maximum-inner-product search with score-aware (anisotropic) quantisation.

* Fit: on at most ``MOST_FITTED`` rows (those with the smallest hash of the id) a product quantiser with 16
  centres for each pair of dimensions is learned.  Its loss weighs the part of the residual that is
  parallel to the vector ``PARALLEL`` times as much as the rest, as only that part moves high inner
  products; assignment is by coordinate descent under this loss.
* Index: every valid row is encoded, four bits for each pair of dimensions, and kept with the length of what its code leaves out.
* Scan: queries come in blocks of about ``QUERY_BLOCK``, which are broadcast; the rows are read where they lie.  16-entry
  tables give every row's rough score from its code.  Of a batch the ``SHORT`` best by the tables are scored exactly, which
  gives each query a floor that as many rows as it needs reach; it rises from batch to batch of a task.
* Check: a rough score is off by no more than the length of the query times that of what the code leaves out.  Rows that
  can't reach the floor by that go; all others are scored exactly, in double precision, on the original vectors.

So no true neighbour is lost, whatever the rows are like: codes that fit them badly (tight clusters, a few long rows, rows
unlike those fitted) only let more rows through to the check.  Neither rows nor codes are shuffled, and a task returns no
more than a few times ``TOP`` rows of a batch for a query.  ``exact=True`` scores all rows without codes.

Equal vectors are one class that keeps its smallest ids, so a vector shared by a third of all rows costs one
code; its members are spread again only within the answer.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
no part; nor do rows without an id.  Ties go to the smaller id.  Rows that repeat id and vector count once, as
query and as neighbour; an id that repeats with different vectors is a query for each of them (their answers stand
under one id), and a neighbour with each, also of its other vectors.  An empty table gives an empty result.  Extra columns don't matter.  Vectors pass for equal by a
64-bit hash; two others share one with a chance of about 1 in 10**19 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.llm.base import cut, delete, scratch, stored, table

MOST_FITTED = 8_192
PARALLEL = 4.0
CENTRES = 16
ROUNDS = 8
TOP = 20
SHORT = 64
QUERY_BLOCK = 16_384
AT_ONCE = 128
PAIRS_AT_ONCE = 65_536
ROUNDING = 1e-5
EVERY = 20


@dataclass
class Quantiser:
    """centres[s, c]: centre c of subspace s."""

    centres: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        return _padded(x, self.centres.shape[0] * self.width).reshape(len(x), self.centres.shape[0], self.width)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, subspaces) under the anisotropic loss: nearest centres first, then two sweeps of coordinate descent."""
        parts = self.parts(x)
        norm = np.maximum((x * x).sum(axis=1), 1e-30)
        plain = ((parts[:, :, None, :] - self.centres[None]) ** 2).sum(axis=3)
        along = (parts[:, :, None, :] * (parts[:, :, None, :] - self.centres[None])).sum(axis=3)  # share of <x, residual>
        codes = plain.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(2):
            for s in range(codes.shape[1]):
                rest = total - along[rows, s, codes[:, s]]
                loss = plain[:, s] + (PARALLEL - 1) * (rest[:, None] + along[:, s]) ** 2 / norm[:, None]
                codes[:, s] = loss.argmin(axis=1)
                total = rest + along[rows, s, codes[:, s]]
        return codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all centres: (subspaces, 16, queries)."""
        return np.einsum("qsw,scw->scq", self.parts(q), self.centres).astype(np.float32)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.zeros((len(x), width - x.shape[1]), x.dtype)])


def train(sample: np.ndarray) -> Quantiser:
    """Alternates assignment under the anisotropic loss and weighted least squares for the centres of each subspace."""
    rng = np.random.default_rng(7)
    subspaces = -(-sample.shape[1] // 2)
    parts = _padded(sample, 2 * subspaces).reshape(len(sample), subspaces, 2)
    picks = rng.choice(len(sample), CENTRES, replace=len(sample) < CENTRES)
    q = Quantiser(parts[picks].transpose(1, 0, 2).astype(np.float64).copy())
    norm = np.maximum((sample * sample).sum(axis=1), 1e-30)
    for _ in range(ROUNDS):
        codes = q.encode(sample)
        chosen = q.centres[np.arange(subspaces)[None], codes]
        along = (parts * (parts - chosen)).sum(axis=2)
        total = along.sum(axis=1)
        for s in range(subspaces):
            x = parts[:, s]
            rest = total - along[:, s]
            # loss of a row: |x - c|^2 + (h - 1) (rest + <x, x - c>)^2 / |v|^2, quadratic in c
            w = (PARALLEL - 1) / norm
            for c in range(CENTRES):
                own = codes[:, s] == c
                if own.any():
                    xo, wo = x[own], w[own]
                    a = np.eye(2) * own.sum() + (xo * wo[:, None]).T @ xo
                    b = xo.sum(axis=0) + (xo * (wo * (rest[own] + (xo * xo).sum(axis=1)))[:, None]).sum(axis=0)
                    q.centres[s, c] = np.linalg.solve(a + 1e-9 * np.eye(2), b)
    return q


def usable(vector: Column, size: int | None = None) -> Column:
    """Not null, not zero, all components finite."""
    ok = vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vector, lambda v: v != 0)
    ok = ok if size is None else ok & (F.size(vector) == size)
    return F.coalesce(ok, F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().values if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(-1, size)


def _index(classes: DataFrame, quantiser: Quantiser, size: int) -> DataFrame:
    """h, first, vector, packed code of every class, and the most that a rough score can be off for a query of length 1."""
    shared = classes.sparkSession.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, q = _matrix(batch.column("v"), size), shared.value
            codes = q.encode(x)
            coded = q.centres[np.arange(codes.shape[1])[None], codes]
            # what the code leaves out, and a share of the lengths for sums in single precision
            off = np.sqrt(((q.parts(x) - coded) ** 2).sum(axis=(1, 2))) + ROUNDING * (np.sqrt((x * x).sum(axis=1)) + np.sqrt((coded**2).sum(axis=(1, 2))))
            if codes.shape[1] % 2:
                codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
            packed = codes[:, ::2] | (codes[:, 1::2] << 4)
            columns = [batch.column("h"), batch.column("first"), batch.column("v"), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(off)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "first", "v", "code", "off"])

    return classes.select("h", "first", "v").mapInArrow(encode, "h long, first long, v array<double>, code binary, off double")


def _table_scores(batch: pa.RecordBatch, q: np.ndarray, quantiser: Quantiser) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores of all rows of the batch for the queries from there on)."""
    raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    codes = np.stack([raw & 15, raw >> 4], axis=2).reshape(batch.num_rows, -1)
    for at in range(0, len(q), AT_ONCE):
        tables = quantiser.tables(q[at : at + AT_ONCE])
        scores = np.zeros((batch.num_rows, tables.shape[2]), np.float32)
        for s in range(len(tables)):
            scores += tables[s][codes[:, s]]
        yield at, scores


def _products(x: np.ndarray, row: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (row, own)."""
    out = np.zeros(len(row))
    for i in range(0, len(row), PAIRS_AT_ONCE):
        out[i : i + PAIRS_AT_ONCE] = (x[row[i : i + PAIRS_AT_ONCE]] * q[own[i : i + PAIRS_AT_ONCE]]).sum(axis=1)
    return out


def _passing(codes: DataFrame, qh: np.ndarray, q: np.ndarray, quantiser: Quantiser, size: int, top: int, short: int) -> DataFrame:
    """query, found, first and exact score of each batch's rows that may be among the ``top + 1`` best of a query."""
    shared = codes.sparkSession.sparkContext.broadcast((qh, q, quantiser))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qh, q, quantiser = shared.value
        length, floors = np.sqrt((q * q).sum(axis=1)), np.full(len(q), -np.inf)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, h, first, off = _matrix(batch.column("v"), size), np.asarray(batch.column("h")), np.asarray(batch.column("first")), np.asarray(batch.column("off"))
            for at, rough in _table_scores(batch, q, quantiser):
                some, floor = rough.shape[1], floors[at : at + rough.shape[1]]
                if n > top:
                    best = np.argpartition(-rough, min(short, n) - 1, axis=0)[:short] if n > short else np.tile(np.arange(n)[:, None], some)
                    known = _products(x, best.ravel(), q, np.tile(np.arange(at, at + some), len(best))).reshape(best.shape)
                    floor[:] = np.fmax(floor, -np.partition(-known, top, axis=0)[top])
                # what isn't finite can't be ruled out
                row, own = np.nonzero(~(rough + off[:, None] * length[None, at : at + some] < floor) | ~np.isfinite(rough))
                score = _products(x, row, q, own + at)
                reach = ~(score < floor[own])
                row, own, score = row[reach], own[reach], score[reach]
                order = np.lexsort((first[row], -score, own))
                rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
                kept = order[rank <= top]
                yield pa.RecordBatch.from_arrays([pa.array(qh[at + own[kept]]), pa.array(h[row[kept]]), pa.array(first[row[kept]]), pa.array(score[kept])], names=["query", "found", "first", "score"])

    return codes.mapInArrow(read, "query long, found long, first long, score double")


def _exact_best(classes: DataFrame, qh: np.ndarray, q: np.ndarray, size: int, top: int) -> DataFrame:
    """query, found, first and score of each batch's best by the vectors themselves."""
    shared = classes.sparkSession.sparkContext.broadcast((qh, q))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qh, q = shared.value
        for batch in batches:
            if batch.num_rows:
                x, h, first = _matrix(batch.column("v"), size), np.asarray(batch.column("h")), np.asarray(batch.column("first"))
                for i in range(len(q)):
                    score = (x * q[i]).sum(axis=1)
                    own = np.lexsort((first, -score))[: top + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), qh[i])), pa.array(h[own]), pa.array(first[own]), pa.array(score[own])], names=["query", "found", "first", "score"])

    return classes.select("h", "v", "first").mapInArrow(read, "query long, found long, first long, score double")


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, short: int = SHORT, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest found of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    sizes = vectors.where(usable(F.col("embedding"))).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    size = sizes.n
    valid = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), size)).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # one class for each distinct vector, with as many of its smallest ids as an answer can use
    rank, salted = Window.partitionBy("h").orderBy("vec_id"), Window.partitionBy("h", "salt").orderBy("vec_id")
    hashed = valid.withColumn("h", F.xxhash64("v"))
    classes = stored(
        hashed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        .withColumns({"r": F.dense_rank().over(salted), "again": F.lag("vec_id").over(salted).eqNullSafe(F.col("vec_id"))})
        .where((F.col("r") <= top + 1) & ~F.col("again"))
        .withColumn("r", F.row_number().over(rank))
        .where(F.col("r") <= top + 1)
        .groupBy("h")
        .agg(F.min_by("v", "r").alias("v"), F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids")),
        "vectors",
    )
    asked = hashed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("query")).distinct()
    queries = cut(classes.join(asked.select(F.col("query").alias("h")).distinct(), "h").select("h", "v"))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    if not exact:
        sample = np.array([r.v for r in classes.orderBy(F.xxhash64("h"), "h").limit(MOST_FITTED).select("v").collect()])
        quantiser = train(sample)
        codes = stored(_index(classes, quantiser, size), "codes")
    to = scratch(spark, "passing")
    for part in range(parts):
        block = queries.where(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(parts)) == part).collect()
        qh, q = np.array([r.h for r in block], np.int64), np.array([r.v for r in block]).reshape(-1, size)
        if exact:
            found = _exact_best(classes, qh, q, size, top)
        else:
            found = _passing(codes, qh, q, quantiser, size, top, max(short, top + 1))
        found.write.mode("append").parquet(to)
    scored = spark.read.schema("query long, found long, first long, score double").parquet(to)
    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    kept = cut(scored.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= top + 1).drop("r", "first"))
    delete(spark, to)
    # classes back to rows: at most top + 1 classes of at most top + 1 ids each for a query vector
    spread = kept.join(classes.select(F.col("h").alias("found"), "ids"), "found").select("query", "score", (F.col("query") == F.col("found")).alias("own"), F.explode("ids").alias("vec_id"))
    answer = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "own")
    listed = spread.withColumn("r", F.row_number().over(answer)).where(F.col("r") <= top + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "own"))).alias("x"))
    others = F.slice(F.filter("x", lambda e: ~(e["own"] & (e["vec_id"] == F.col("query_id")))), 1, top)
    return (
        asked.join(lists, "query")
        .select("query_id", F.posexplode(others).alias("pos", "e"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
    )


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
