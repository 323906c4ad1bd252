"""Repeated passages: seed on winnowed anchors, extend over the shared words, cut what an earlier document has.

A window is 50 consecutive words.  Each window names one anchor, the smallest hash among its 25-word
grams, so two equal windows name equal anchors and documents that share no anchor share no window.

* Seed: each document's distinct anchors meet by hash; those of two or more documents come back to
  their documents.
* Extend: a shared seed is carried on to both sides in every way that makes up 50 words, so each extension is
  one window; each is hashed as a whole and compared with the smallest ``doc_id`` that has it.  Adjacent repeated
  windows join to maximal repeats.  Extending from seeds pair by pair would find the same windows, but by
  comparing every two documents of a passage.
* Cut: words under a repeated window go, judged on the input and not on what is left.

No pairs of documents are made.  A passage that is common within a task's batch is settled there and
only its smallest document travels on, so a passage in a third of all rows costs one entry a batch.

Buckets follow the bytes of text.  Windows are told apart by 64-bit hashes; two different ones pass for equal
with a chance of about 1 in 10**19 a pair.

Null text has no words.  Rows that repeat a ``doc_id`` with other texts are documents of equal id: none is a source for the
other, each loses what a smaller id has, and repeated identical rows get the same answer.  What is found is keyed by id and 32 bits
of a hash of the text, so two texts of one id pass for one with a chance of about 1 in 4 * 10**9.  Rows
without an id are neither source nor copy and stay whole.  An empty table gives an empty result.
Columns of the input with the names of outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.arrays import by_row, grams, mix, pack, runs, slices, unpack, utf8, window_min, words
from vantage.llm.base import stored, table

GRAM = 25
WINDOW = 50
BYTES_PER_BUCKET = 4_000_000
OUTPUTS = ("kept_text", "n_words", "n_removed", "removed")
_BLOB = pa.schema([("bucket", pa.int32()), ("local", pa.bool_()), ("payload", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("found", pa.binary())])


def _blobs(shipped: Iterator[tuple[int, bytes]], local: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = [(b, False, p) for b, p in shipped] + [(b, True, p) for b, p in local]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_BLOB.types)], schema=_BLOB)


def _found(owner: np.ndarray, *columns: np.ndarray) -> Iterator[pa.Table]:
    """One row for each owner, its items side by side."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    items = np.stack([c[order] for c in columns], axis=1)
    edges = runs(owner)
    blobs = [items[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    yield pa.table([pa.array(owner[edges[:-1]], pa.int64()), pa.array(blobs, pa.binary())], schema=_FOUND)


def _joined(owner: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive positions of one text as (owner, tag, first, length)."""
    order = np.lexsort((at, tag, owner))
    owner, tag, at = owner[order], tag[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return owner[first], tag[first].astype(np.uint32), at[first].astype(np.uint32), (at[last] - at[first] + 1).astype(np.uint32)


def _short(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 more bits of a hash; what differs only beyond them is told apart by whole windows later."""
    return ((keys >> np.uint64(32)) % np.uint64(n)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _anchor_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    bucket, low = _short(window_min(grams(hashes, GRAM), WINDOW - GRAM + 1), n)
    return (bucket.astype(np.uint64) << np.uint64(32)) | low


def shared_anchors(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and found: the anchors (uint64) that another document has too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            w = words(*utf8(batch.column("text")), lower=False)
            ok = w.room(WINDOW)
            key, owner = by_row(_anchor_keys(w.hashes, n)[ok], ids[w.rows()[ok]])
            edges = runs(key)
            size = np.diff(edges)
            first = np.zeros(len(key), bool)
            first[edges[:-1]] = len(key) > 0
            many = np.repeat(size > 1, size)
            yield _blobs(
                pack((key[first] >> np.uint64(32)).astype(np.int64), owner[first], (key[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)),
                pack((mix(owner[many].view(np.uint64)) % np.uint64(n)).astype(np.int64), owner[many], key[many]),
            )

    def meet(group: pa.Table) -> pa.Table:
        local = np.asarray(group.column("local"))
        blobs = group.column("payload").to_pylist()
        owner, key = unpack([b for b, x in zip(blobs, local, strict=True) if x], np.uint64)
        other, low = unpack([b for b, x in zip(blobs, local, strict=True) if not x], np.uint32)
        low, other = by_row(low, other)
        many = np.repeat(np.diff(runs(low)) > 1, np.diff(runs(low)))
        bucket = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(32)
        key, owner = by_row(np.concatenate([key, low[many].astype(np.uint64) | bucket]), np.concatenate([owner, other[many]]))
        return pa.concat_tables(_found(owner, key))

    return (
        docs.select("doc_id", "text").mapInArrow(emit, "bucket int, local boolean, payload binary").groupBy("bucket").applyInArrow(meet, "doc_id long, found binary")
    )


def repeated_windows(docs: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """doc_id and found: (tag of the text, first window, number of windows), each uint32, that a document with a smaller id has."""
    seeds = anchors.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("found").alias("anchors"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            w = words(*utf8(batch.column("text")), lower=False)
            key = _anchor_keys(w.hashes, n)
            shared = np.unique(np.frombuffer(b"".join(x for row in batch.column("anchors").to_pylist() for x in row), np.uint64))
            at = np.flatnonzero(w.room(WINDOW) & np.isin(key, shared))
            rows = w.rows()[at]
            tags = np.asarray(batch.column("tag")).astype(np.uint32)
            whole, owner, tag, place, key = grams(w.hashes, WINDOW)[at], ids[rows], tags[rows], at - w.offsets[rows], key[at]
            order = np.lexsort((owner, whole))
            whole, owner, tag, place, key = whole[order], owner[order], tag[order], place[order], key[order]
            edges = runs(whole)
            later = owner != np.repeat(owner[edges[:-1]], np.diff(edges))
            mine, text, start, length = _joined(owner[later], tag[later], place[later])
            yield _blobs(
                pack((key[~later] >> np.uint64(32)).astype(np.int64), owner[~later], whole[~later], tag[~later], place[~later].astype(np.uint32)),
                pack((mix(mine.view(np.uint64)) % np.uint64(n)).astype(np.int64), mine, text, start, length),
            )

    def meet(group: pa.Table) -> pa.Table:
        local = np.asarray(group.column("local"))
        blobs = group.column("payload").to_pylist()
        owner, text, start, length = unpack([b for b, x in zip(blobs, local, strict=True) if x], np.uint32, np.uint32, np.uint32)
        other, whole, tag, place = unpack([b for b, x in zip(blobs, local, strict=True) if not x], np.uint64, np.uint32, np.uint32)
        order = np.lexsort((other, whole))
        other, whole, tag, place = other[order], whole[order], tag[order], place[order]
        edges = runs(whole)
        later = other != np.repeat(other[edges[:-1]], np.diff(edges))
        mine, own, first, span = _joined(other[later], tag[later], place[later])
        return pa.concat_tables(_found(*(np.concatenate(x) for x in ((owner, mine), (text, own), (start, first), (length, span)))))

    return (
        docs.select("doc_id", "text", _tag().alias("tag"))
        .join(seeds, F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", "tag", "anchors")
        .mapInArrow(emit, "bucket int, local boolean, payload binary")
        .groupBy("bucket")
        .applyInArrow(meet, "doc_id long, found binary")
    )


def _tag() -> Column:
    """32 bits that tell the texts of one id apart."""
    return F.xxhash64("text", F.lit(9)).bitwiseAND(F.lit(0xFFFFFFFF))


def _covered(found: list[bytes], tag: int, n: int) -> np.ndarray:
    spans = np.frombuffer(b"".join(found), np.uint32).reshape(-1, 3).astype(np.int64)
    spans = spans[spans[:, 0] == tag, 1:]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1] + WINDOW - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_words, n_removed and removed, the removed ranges of words (end exclusive)."""
    docs = docs.drop(*OUTPUTS)
    known = docs.where(F.col("doc_id").isNotNull())
    n = max(1, -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_PER_BUCKET))
    repeats = repeated_windows(known, shared_anchors(known, n), n)
    cuts = stored(repeats, "repeats").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("found").alias("_found"))
    marked = known.join(cuts, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    marked = marked.unionByName(docs.where(F.col("doc_id").isNull()).withColumn("_found", F.lit(None).cast("array<binary>"))).withColumn("_tag", _tag())
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8_000_000):
            kept, total, gone, spans = [], [], [], []
            for text, found, tag in zip(*(batch.column(c).to_pylist() for c in ("text", "_found", "_tag")), strict=True):
                own = (text or "").encode().split()
                total.append(len(own))
                if found:
                    cover = _covered(found, tag, len(own))
                    edges = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0)).tolist()
                    spans.append([{"first": a, "last": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    gone.append(int(cover.sum()))
                    own = [own[i] for i in np.flatnonzero(~cover).tolist()]
                else:
                    spans.append([])
                    gone.append(0)
                kept.append(b" ".join(own).decode())
            base = batch.drop_columns(["_found", "_tag"])
            new = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*base.columns, *new], names=[*base.schema.names, *OUTPUTS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return marked.mapInArrow(apply, f"{kinds}, kept_text string, n_words long, n_removed long, removed array<struct<first: long, last: long>>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
