"""Length buckets that minimise padding, and token-budget batches inside each bucket.

The exact histogram of lengths over all rows (one row for each distinct length) goes to the driver, where
dynamic programming finds the bucket bounds that minimise total padding.  Lengths of texts are numbers of ids of
a byte-level BPE, counted once and written down.  The cost of a bucket is Monge, so
the best split only moves up with the length and divide and conquer takes buckets * n log n steps for n
distinct lengths.  In a bucket of bound b a batch takes ``budget // b`` rows, at least one.

Rows get their place in a bucket from hashed shards of bounded size: the place in the shard plus the rows
of the shards before it.  So a bucket that holds most of the corpus is never in one task, and only the
last batch of a bucket can be short.

Null and empty texts have length 0 and go to the first bucket; a row takes at least one place, so no bucket
is shorter than 1.  Ids are only hashed and sorted by, so null
and repeated ids and repeated rows are fine.  An empty table gives an empty result; input columns with the
names of outputs are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.llm.base import cut, stored, table
from vantage.llm.bpe import count_tokens

BUCKETS = 12
BUDGET = 65_536
SHARD_ROWS = 5_000
MOST_SHARDS = 100_000
OUTPUTS = ("n_tokens", "bucket", "bucket_length", "batch", "slot", "padding")


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` bounds (the last is the longest length) with the least total padding of the histogram."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(lengths)
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    # cost[i, j]: lengths i..j-1 padded to lengths[j-1]
    worst = np.iinfo(np.int64).max // 2
    best = np.full(n + 1, worst)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        now, source = best.copy(), np.full(n + 1, -1)
        todo = [(1, n, 0, n - 1)]
        while todo:
            first, last, least, most = todo.pop()
            j = (first + last) // 2
            i = np.arange(least, min(most, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            k = int(cost.argmin())
            if cost[k] < now[j]:
                now[j], source[j] = cost[k], i[k]
            if first < j:
                todo.append((first, j - 1, least, int(i[k])))
            if j < last:
                todo.append((j + 1, last, int(i[k]), most))
        back.append(source)
        best = now
    out, j = [], n
    for source in reversed(back):
        if j > 0 and source[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(source[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = BUDGET, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with n_tokens, bucket, bucket_length, batch and slot (from 0), and padding."""
    sized = docs.withColumn("_length", F.coalesce(length, F.lit(0)).cast("long")).drop(*OUTPUTS).withColumnRenamed("_length", "n_tokens")
    own = [c for c in docs.columns if c.lower() not in OUTPUTS]
    histogram = sized.groupBy(F.greatest("n_tokens", F.lit(1)).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = bounds(np.array([r.l for r in histogram]), np.array([r.n for r in histogram]), buckets) if histogram else [1]
    at = F.lit(len(found) - 1)
    for i in reversed(range(len(found) - 1)):
        at = F.when(F.col("n_tokens") <= found[i], F.lit(i)).otherwise(at)
    edges = F.array(*map(F.lit, found))
    bucketed = sized.withColumn("bucket", at).withColumn("bucket_length", F.element_at(edges, F.col("bucket") + 1).cast("long"))
    shards = min(MOST_SHARDS, 1 + sum(r.n for r in histogram) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64(id_column, "n_tokens"), F.lit(shards)).cast("int")
    dealt = bucketed.withColumn("_shard", shard)
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    sizes = cut(dealt.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_n")))
    offsets = sizes.select("bucket", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("bucket", "_shard").orderBy(F.col(id_column), "n_tokens")
    place = F.col("_offset") + F.row_number().over(within) - 1
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1))
    return (
        dealt.join(offsets, ["bucket", "_shard"])
        .withColumn("_place", place)
        .withColumn("batch", F.floor(F.col("_place") / room).cast("long"))
        .withColumn("slot", (F.col("_place") % room).cast("int"))
        .withColumn("padding", F.col("bucket_length") - F.col("n_tokens"))
        .select(*own, *OUTPUTS)
    )


def pack_texts(docs: DataFrame, tokenizer: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``docs`` (doc_id, text and more) packed by the number of ids that the byte-level BPE of ``tokenizer`` gives."""
    counted = stored(count_tokens(docs.drop(*OUTPUTS), tokenizer), "counted")
    return pack(counted, F.col("n_tokens"), buckets, budget)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = stored(count_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "n_tokens"), "lengths")
    return pack(counted, F.col("n_tokens")).select("doc_id", *OUTPUTS)
