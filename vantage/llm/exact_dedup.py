"""Exact deduplication in two passes over a Bloom filter.

Pass one turns every text into three probe positions of a bit table and finds the positions that were
hit at least twice.  Pass two sends only rows whose three positions are all among those through a
shuffle; every other row is certainly alone and passes straight through.  The table has 16 bits a row
up to ``most_bits`` (8 MB); beyond that more rows shuffle, and the result stays the same.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space; null
counts as empty.  Of equal texts the row with the smallest ``doc_id`` stays.  ``doc_id`` is the key:
rows that repeat both id and text share one decision, and ``survivors`` takes one row of them.  An empty
table gives an empty result; columns with the names of this operator's outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType

from vantage.llm.arrays import mix
from vantage.llm.base import SPACE, cut, table

PROBES = 3
SEGMENT_BITS = 13
MOST_BITS = 26
MOST_HOT, SALTS = 1_000, 32
OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each key, one row for each probe."""
    keys = keys.astype(np.int64).view(np.uint64)
    return np.stack([(mix(keys + np.uint64(i + 1)) >> np.uint64(64 - bits)).astype(np.int64) for i in range(PROBES)])


def repeated_positions(keys: DataFrame, bits: int) -> bytes:
    """The bit table of positions that at least two rows hit.  Its size is fixed by ``bits``."""
    low = (1 << SEGMENT_BITS) - 1

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(probes(batch.column(0).to_numpy(zero_copy_only=False), bits), return_counts=True)
            at = np.repeat(at, np.minimum(n, 2))
            edges = np.flatnonzero(np.diff(at >> SEGMENT_BITS, prepend=-1, append=-1))
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array(at[edges[:-1]] >> SEGMENT_BITS, pa.int64()),
                        "hits": pa.array([(at[a:b] & low).astype(np.uint16).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    }
                )

    def merge(group: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(x, np.uint16) for x in group.column("hits").to_pylist()])
        twice = np.bincount(at, minlength=low + 1) >= 2
        return pa.table({"segment": group.column("segment").slice(0, 1), "twice": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    found = keys.mapInArrow(hit, "segment long, hits binary").groupBy("segment").applyInArrow(merge, "segment long, twice binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (low + 1) // 8
    for row in found.toLocalIterator():
        out[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.twice, np.uint8)
    return out.tobytes()


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 for every row."""
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUTS)
    key = F.xxhash64(normalised(F.col(text_column)))
    total = max(docs.count(), 1)
    bits = min(most_bits, max(SEGMENT_BITS, (16 * total).bit_length()))
    twice = spark.sparkContext.broadcast(repeated_positions(docs.select(key.alias("key")), bits))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        at, have = probes(keys.to_numpy(), bits), np.frombuffer(twice.value, np.uint8)
        return pd.Series(((have[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    marked = docs.withColumn("_maybe", maybe(key))
    sha = F.sha2(normalised(F.col(text_column)), 256)
    alone = marked.where(~F.col("_maybe")).select(
        *docs.columns, F.col(id_column).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256")
    )
    rest = marked.where(F.col("_maybe")).select(*docs.columns, sha.alias("text_sha256"))
    groups = cut(
        rest.groupBy(F.col("text_sha256").alias("_sha")).agg(F.min(id_column).alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    )
    # at most MOST_HOT groups hold that share of all rows; their rows meet their group in SALTS places
    large = F.col("_size") > total / MOST_HOT
    hot = groups.where(large).select(F.col("_sha").alias("_hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(id_column, F.spark_partition_id()), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = rest.join(F.broadcast(hot), F.col("text_sha256") == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    spread = groups.withColumn("_at", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    decided = salted.join(spread, (F.col("text_sha256") == F.col("_sha")) & (F.col("_salt") == F.col("_at")), "left").select(
        *docs.columns,
        F.when(F.col("_sha").isNull(), F.col(id_column)).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_sha").isNull() | F.col(id_column).eqNullSafe(F.col("_keep"))).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(decided)


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind)
    return not isinstance(kind, (MapType, VariantType, CalendarIntervalType))


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of equal texts: of the smallest id and, where that id repeats, the row that sorts first.

    Columns without an order (maps and what holds them) sort by their JSON text.
    """
    own = docs.drop(*OUTPUTS).columns
    kept = exact_dedup(docs, id_column, text_column).where("kept")
    order = [F.col(f.name) if _orderable(f.dataType) else F.to_json(F.struct(f.name)) for f in kept.select(*own).schema]
    tied = kept.where("group_size > 1").groupBy("text_sha256").agg(F.min_by(F.struct(*own), F.struct(*order)).alias("_row"))
    return kept.where("group_size = 1").select(*own).unionByName(tied.select("_row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *OUTPUTS)


ORACLE = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""
