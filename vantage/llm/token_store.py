"""A content-addressed store of token ids.

A rolling hash over the last 16 ids cuts each document's ids into chunks (512 ids on average, 64 to 4096),
so equal passages give equal chunks wherever they stand.  A store is a folder of Parquet files:

* ``chunks/kind=0``: digest (blake2b, 16 bytes) and body (unsigned little-endian ids of 16 bits, or of
  32 where the vocabulary needs them) of each distinct chunk, once;
* ``recipes``: doc_id, start (ids of all documents before it), n_tokens and the digests of its chunks, in
  ascending doc_id order over numbered parts;
* ``manifest``: a Merkle tree over the recipes: blocks of up to 1,024 documents, parts, and one root.

Ids are those of the tokenizers library's plain call: strings of added tokens in a text become their ids.
A chunk's row has its number of ids, which tells the width of its body.

A task sends a chunk on once however often its texts repeat it, so a passage in a third of all documents
costs one row a task.  Reading checks every body against its digest and the recipes against the manifest; a
store that fails either raises ValueError.

Null text is an empty document: only the end id.  Rows without an id come first; rows that repeat an id
each are a document.  An empty table gives an empty store.  Extra columns are not kept.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.llm.arrays import grams, mix, slices
from vantage.llm.base import delete, scratch, table
from vantage.llm.pretokens import Ids

END_ID = 0
ROLL = 16
MEAN, LEAST, MOST = 512, 64, 4096
DIGEST = 16
BLOCK = 1024
SEEN_CHUNKS = 500_000


class Encoder:
    """Ids of texts: pretokens through a cache, texts that hold an added token through the library as a whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 and END_ID < 1 << 16 else 4
        self.cached = Ids(lambda words: [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)], kind=np.uint16 if self.width == 2 else np.uint32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the first of each text (and the end)."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self.cached(texts)
        apart = set(whole)
        flat, edge = self.cached(["" if i in apart else t for i, t in enumerate(texts)])
        found = {i: np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in whole}
        parts = [found[i] if i in apart else flat[edge[i] : edge[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def chunk_ends(ids: np.ndarray, edge: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document ids[edge[i]:edge[i+1]]."""
    roll = np.full(len(ids), 1, np.uint64)
    full = grams(mix(ids.astype(np.uint64) + np.uint64(1)), ROLL)
    roll[ROLL - 1 :] = full[: len(ids) - ROLL + 1] if len(ids) >= ROLL else roll[ROLL - 1 :]
    cuts = np.flatnonzero(roll % np.uint64(MEAN) == 0) + 1
    first = np.searchsorted(cuts, edge)
    out = []
    for d, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        ends, at = [], a
        for c in [*cuts[first[d] : first[d + 1]].tolist(), b]:
            if c - ROLL < a and c != b:
                continue  # the window would reach into the document before
            while c - at > MOST:
                at += MOST
                ends.append(at)
            if c == b or c - at >= LEAST:
                at = c
                ends.append(c)
        out.append([e for i, e in enumerate(ends) if i == 0 or e > ends[i - 1]])
    return out


def _pieces(docs: DataFrame, path: str) -> DataFrame:
    """Rows of kind 0 (a chunk: key, body) and kind 1 (a recipe: doc_id, n_tokens, body of digests)."""
    names = ["kind", "key", "doc_id", "n_tokens", "body"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, n_rows, part = _encoder(path), set(), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            flat, edge = encode([t or "" for t in batch.column("text").to_pylist()])
            ids = np.insert(flat, edge[1:], END_ID)
            edge = edge + np.arange(len(edge))
            width = encode.width
            raw = ids.astype(f"<u{width}").tobytes()
            rows = []
            for doc, a, b, ends in zip(batch.column("doc_id").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), chunk_ends(ids, edge), strict=True):
                digests, at = [], a
                for e in ends:
                    body = raw[width * at : width * e]
                    key = hashlib.blake2b(body, digest_size=DIGEST).digest()
                    digests.append(key)
                    if key not in seen:
                        if len(seen) >= SEEN_CHUNKS:
                            seen.clear()
                        seen.add(key)
                        rows.append((0, key, None, e - at, body))
                    at = e
                rows.append((1, struct.pack(">qq", part, n_rows), doc, b - a, b"".join(digests)))
                n_rows += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut_up, "kind int, key binary, doc_id long, n_tokens long, body binary")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key of a partition once; equal keys stand side by side."""
    last = None
    for batch in batches:
        keep = []
        for key in batch.column("key").to_pylist():
            keep.append(key != last)
            last = key
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, tokenizer: str, to: str) -> None:
    """Writes the store of ``docs`` (doc_id, text) to the new folder ``to``."""
    spark = docs.sparkSession
    pieces = _pieces(docs, tokenizer).repartition("key").sortWithinPartitions("key")
    schema = "kind int, key binary, doc_id long, n_tokens long, body binary"
    pieces.mapInArrow(_once, schema).write.option("compression", "zstd").partitionBy("kind").parquet(f"{to}/chunks")
    recipes = spark.read.schema(schema).parquet(f"{to}/chunks").where("kind = 1").select("doc_id", "n_tokens", F.col("body").alias("digests"), "key")
    parts = recipes.repartitionByRange("doc_id", "key").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "key")
    parts.write.parquet(f"{to}/ordered")
    ordered = spark.read.schema(parts.schema).parquet(f"{to}/ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    placed = (
        ordered.join(offsets, "part")
        .withColumn("start", F.col("offset") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .withColumn("place", F.row_number().over(within))
        .select("part", "place", "doc_id", "start", "n_tokens", "digests")
    )
    placed.write.parquet(f"{to}/recipes")
    delete(spark, f"{to}/ordered")
    merkle(spark, to).write.parquet(f"{to}/manifest")


_RECIPE = "part int, place int, doc_id long, start long, n_tokens long, digests binary"


def read_recipes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_RECIPE).parquet(f"{store}/recipes")


def merkle(spark: SparkSession, store: str) -> DataFrame:
    """(part, block, n_docs, hash): hashes of blocks, of parts (block null) and of the whole (part null too), from the recipes."""
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.hex("digests")), 256)

    def up(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "hash"))), lambda x: x["hash"]), "")
        return rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sha2(listed, 256).alias("hash"))

    leaves = read_recipes(spark, store).select("part", "place", F.floor((F.col("place") - 1) / BLOCK).cast("int").alias("block"), F.lit(1).cast("long").alias("n_docs"), leaf.alias("hash"))
    blocks = up(leaves, ["part", "block"], "place")
    parts = up(blocks, ["part"], "block")
    root = up(parts, [], "part").where("n_docs is not null")
    null = F.lit(None).cast("int")
    return (
        blocks.select("part", "block", "n_docs", "hash")
        .unionByName(parts.select("part", null.alias("block"), "n_docs", "hash"))
        .unionByName(root.select(null.alias("part"), null.alias("block"), "n_docs", "hash"))
    )


def broken(spark: SparkSession, store: str) -> DataFrame:
    """Manifest entries that the recipes don't bear out; empty for a whole store."""
    kept = spark.read.schema("part int, block int, n_docs long, hash string").parquet(f"{store}/manifest")
    both = kept.select("*", F.lit(1).alias("x")).unionByName(merkle(spark, store).select("*", F.lit(-1).alias("x")))
    return both.groupBy("part", "block", "n_docs", "hash").agg(F.sum("x").alias("x")).where("x <> 0").drop("x")


def verify(spark: SparkSession, store: str) -> None:
    """Raises ValueError where the recipes don't bear out the manifest."""
    wrong = broken(spark, store).limit(5).collect()
    if wrong:
        raise ValueError(f"manifest and recipes of {store} differ: {wrong}")


def _bodies(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("kind int, key binary, n_tokens long, body binary").parquet(f"{store}/chunks").where("kind = 0").select("key", F.col("n_tokens").alias("n"), "body")


def _checked(key: bytes, n: int, body: bytes) -> np.ndarray:
    """Ids of a body that its digest bears out."""
    if hashlib.blake2b(body, digest_size=DIGEST).digest() != key:
        raise ValueError(f"chunk {key.hex()} doesn't match its digest")
    return np.frombuffer(body, f"<u{len(body) // n}")


def _chunk_list(spark: SparkSession, store: str) -> DataFrame:
    """part, place, doc_id, start, n_tokens, nth and digest of every chunk of every document."""
    digests = F.transform(F.sequence(F.lit(0), (F.length("digests") / DIGEST - 1).cast("int")), lambda i: F.substring("digests", (i * DIGEST + 1).cast("int"), F.lit(DIGEST)))
    return read_recipes(spark, store).select("part", "place", "doc_id", "start", "n_tokens", F.posexplode(digests).alias("nth", "digest"))


@lru_cache(maxsize=8192)
def _shift(n: int) -> tuple[tuple[int, ...], ...]:
    """Tables that carry a crc32 over n further bytes."""
    zeros = bytes(n)
    base = zlib.crc32(zeros)
    bits = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
    tables = []
    for k in range(4):
        row = [0] * 256
        for v in range(1, 256):
            low = v & -v
            row[v] = row[v ^ low] ^ bits[8 * k + low.bit_length() - 1]
        tables.append(tuple(row))
    return tuple(tables)


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of byte strings in a row, from the crc32 and size of each."""
    out = 0
    for crc, n in zip(crcs, sizes, strict=True):
        a, b, c, d = _shift(n)
        out = a[out & 255] ^ b[out >> 8 & 255] ^ c[out >> 16 & 255] ^ d[out >> 24] ^ crc
    return out


def checksums(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the bodies in the store's files.

    The recipes are checked against the manifest first.  Each distinct body is read and checked once; what
    travels to the documents is its checksum and length.
    """
    verify(spark, store)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [
                zlib.crc32(_checked(key, n, body).astype("<u4").tobytes())
                for key, n, body in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("body").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sums, pa.int64()), batch.column("n")], names=["key", "crc", "n"])

    sums = _bodies(spark, store).mapInArrow(read, "key binary, crc long, n long")

    @F.pandas_udf("long")
    def join(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([joined_crc([int(x) for x in c], [4 * int(x) for x in n]) for c, n in zip(crcs, sizes, strict=True)], dtype="int64")

    listed = F.array_sort(F.collect_list(F.struct("nth", "crc", "n")))
    docs = (
        _chunk_list(spark, store)
        .join(sums, F.col("digest") == F.col("key"), "left")
        .groupBy("part", "place", "doc_id", "start", "n_tokens")
        .agg(listed.alias("x"))
    )
    return docs.select("doc_id", "start", "n_tokens", join(F.transform("x", lambda x: x["crc"]), F.transform("x", lambda x: x["n"])).alias("ids_crc32"))


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start and ids (array of long, with the end id) of every document; checked as in checksums()."""
    verify(spark, store)

    @F.pandas_udf("array<long>")
    def numbers(parts: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([_checked(p["key"], p["n"], p["body"]) for p in own]).astype(np.int64) for own in parts])

    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "key", "n", "body"))), lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"), x["body"].alias("body")))
    docs = _chunk_list(spark, store).join(_bodies(spark, store), F.col("digest") == F.col("key"), "left").groupBy("part", "place", "doc_id", "start").agg(listed.alias("x"))
    return docs.select("doc_id", "start", numbers("x").alias("ids"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), store)
    return checksums(spark, store)
