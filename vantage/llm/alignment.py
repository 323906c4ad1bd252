"""Alignment of two tokenizers' tokens over the same texts.

A text, with a space before it, is encoded by a byte-level BPE (A) and by a piece model (B).  Both cut the same bytes, so
tokens are compared by byte ranges:

* Overlaps: for each batch, ``pandas.merge_asof`` on the byte offset, keyed by document, finds the B token that covers
  each A token's start, and the A token that covers each B token's start.  Of two overlapping tokens one starts inside
  the other, so the union of both directions is all overlaps.
* Links are the overlaps whose ranges end together; their ends cut a document into groups.
* Counts of linked id pairs over the whole corpus: a task sums the pairs of its documents block by block (about
  ``BLOCK_BYTES`` of text), the blocks' sums meet by pair, and each block gets the counts of its own pairs back.  What is
  shuffled is a block's distinct pairs, not its tokens; a pair that stands in every document is one row a block.

Texts that are null, empty, or that either vocabulary can't give back byte by byte (a text with U+2581, for one) have no
tokens: zeros and no groups.  Strings of special tokens in a text are plain text.  Repeated rows and ids each count as a
document.  Texts are read whole, a very long one as a batch of its own; of the rest ``BATCH_BYTES`` are compared at a time.  An empty table gives an empty result.  Further
columns are carried by ``align``, those named as its outputs are replaced.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.llm import arrays
from vantage.llm.base import cut, scratch, table
from vantage.llm.pretokens import Ids, split_at_spaces

BLOCK_BYTES = 16_000_000
#: What a worker holds at once: bytes of text whose tokens are compared, and pretokens of each side whose ids are kept.
BATCH_BYTES = 500_000
PRETOKENS = 300_000
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
MARK = "▁"


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    return arrays.slices(batches, text, BATCH_BYTES)


class Side:
    """One vocabulary: ids of texts, and the bytes that each id stands for."""

    def __init__(self, ids: Ids, strings: list[bytes]) -> None:
        self.ids = ids
        self.length = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids in a row, and the end of each."""
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.begin[ids] - (ends - n), n) + np.arange(total)], ends


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where that is a visible sign of Latin-1, the rest in order from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    sign = _byte_of_sign()
    strings = [b""] * library.get_vocab_size()
    for entry, i in library.get_vocab().items():
        strings[i] = bytes(sign[c] for c in entry)
    ids = Ids(lambda words: [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)], most=PRETOKENS, kind=np.uint16 if len(strings) <= 1 << 16 else np.uint32)
    return Side(ids, strings)


@lru_cache(maxsize=2)
def piece_model(path: str) -> Side:
    """Where no piece spans a space after another sign, merges stay within a run of spaces and what follows it, so those are encoded one by one."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    size = library.get_piece_size()
    pieces = [library.id_to_piece(i) for i in range(size)]
    strings = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    apart = not any(MARK in p.lstrip(MARK) for p in pieces)
    alone = [library.piece_to_id(MARK)]

    def encode(words: list[str]) -> list[list[int]]:
        # the library adds the first space itself, but not to an empty text
        found = library.encode([w[1:] for w in words], num_threads=1)
        return [f if w != " " else alone for w, f in zip(words, found, strict=True)]

    return Side(Ids(encode, most=PRETOKENS, kind=np.uint16 if size <= 1 << 16 else np.uint32, cut=split_at_spaces if apart else _whole), strings)


def _whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``split``, each text one piece."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), at, np.arange(len(texts) + 1)


@dataclass
class Tokens:
    """Tokens of the documents of a batch that both sides give back: ids, byte ends over all, and documents."""

    ids: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    edge: np.ndarray  # tokens of document d: edge[d] .. edge[d+1]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends


def _own(side: Side, texts: list[str], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, edges of the texts, and which texts the ids give back."""
    ids, edge = side.ids(texts)
    joined, ends = side.joined(ids)
    to = np.concatenate(([0], ends))[edge]
    good = np.diff(to) == np.diff(at)
    if good.all():
        differ = np.flatnonzero(joined != data)
        good[np.searchsorted(at, differ, side="right") - 1] = False
    else:
        good = np.array([bool(g) and np.array_equal(joined[a:b], data[c:d]) for g, a, b, c, d in zip(good, to[:-1], to[1:], at[:-1], at[1:], strict=True)], bool)
    return ids, edge, good


def tokens_of(texts: list[str | None], a: Side, b: Side) -> tuple[Tokens, Tokens]:
    """Tokens of both sides; a text without tokens has none on either."""
    spaced = [" " + t if t else "" for t in texts]
    coded = [t.encode("utf-8", "surrogatepass") for t in spaced]
    data, at = np.frombuffer(b"".join(coded), np.uint8), np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int64)
    found = [_own(side, spaced, data, at) for side in (a, b)]
    good = found[0][2] & found[1][2]
    out = []
    for side, (ids, edge, _) in zip((a, b), found, strict=True):
        count = np.diff(edge)
        if not good.all():
            ids, count = ids[np.repeat(good, count)], np.where(good, count, 0)
        out.append(Tokens(ids, np.cumsum(side.length[ids]), np.repeat(np.arange(len(texts)), count), np.concatenate(([0], np.cumsum(count)))))
    return out[0], out[1]


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all overlapping pairs: each A token's start with its covering B token, then each B token's start strictly inside an A token with that."""
    left = pd.DataFrame({"start": a.starts, "doc": a.doc, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"start": b.starts, "doc": b.doc, "b": np.arange(len(b.ids))})
    covering_b = pd.merge_asof(left, right, on="start", by="doc")
    covering_a = pd.merge_asof(right, left, on="start", by="doc", allow_exact_matches=False).dropna()  # equal starts have met already
    if not len(covering_b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = a.ends[covering_a["a"].to_numpy(np.int64)] > covering_a["start"].to_numpy()
    covering_a = covering_a[inside]
    return np.concatenate([covering_b["a"], covering_a["a"]]).astype(np.int64), np.concatenate([covering_b["b"], covering_a["b"]]).astype(np.int64)


class Decimals:
    """Ids as decimal numbers, each with a sign after it."""

    SIGNS = ",|;"

    def __init__(self, size: int) -> None:
        strings = [f"{i}{s}".encode() for i in range(size) for s in self.SIGNS]
        self.length = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, ids: np.ndarray, sign: np.ndarray) -> tuple[bytes, np.ndarray]:
        at = ids.astype(np.int64) * len(self.SIGNS) + sign
        n = self.length[at]
        to = np.concatenate(([0], np.cumsum(n)))
        return self.pool[np.repeat(self.begin[at] - to[:-1], n) + np.arange(to[-1])].tobytes(), to


@lru_cache(maxsize=2)
def _decimals(size: int) -> Decimals:
    return Decimals(size)


def groups_text(a: Tokens, b: Tokens, link_a: np.ndarray, link_b: np.ndarray, size: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document; link_a and link_b are the ascending numbers of the tokens that end groups."""
    group_a, group_b = (np.searchsorted(x, np.arange(len(t.ids))) for x, t in ((link_a, a), (link_b, b)))
    # in a group A's tokens come first: an A token stands behind the B tokens of earlier groups, a B token behind the A tokens up to its own group
    before_a = np.concatenate(([0], link_b + 1))[group_a]
    before_b = (link_a + 1)[group_b] if len(link_a) else group_b
    place_a, place_b = np.arange(len(a.ids)) + before_a, np.arange(len(b.ids)) + before_b
    ids = np.zeros(len(a.ids) + len(b.ids), np.int64)
    sign = np.zeros(len(ids), np.int64)
    ids[place_a], ids[place_b] = a.ids, b.ids
    sign[place_a[link_a]], sign[place_b[link_b]] = 1, 2
    text, to = _decimals(size)(ids, sign)
    edge = to[a.edge + b.edge].tolist()
    return [text[x : max(x, y - 1)] for x, y in zip(edge[:-1], edge[1:], strict=True)]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    distinct, place = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, place, counts)
    return distinct, out


def _lists(values: np.ndarray, edge: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, kind))


_MADE = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"


def _aligned(docs: DataFrame, a_path: str, b_path: str, text_column: str) -> DataFrame:
    """Rows of kind 0 for documents, with their distinct linked pairs, and of kind 1 for blocks, with the pairs of all their documents."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = byte_level(a_path), piece_model(b_path)
        size = max(len(a_side.length), len(b_side.length))
        task, block, held, met = TaskContext.get().partitionId() << 32, 0, 0, []
        schema = None

        def closed(schema: pa.Schema) -> pa.RecordBatch:
            pairs, counts = summed(np.concatenate([k for k, _ in met]), np.concatenate([c for _, c in met]))
            none = [pa.nulls(1, schema.field(n).type) for n in names]
            row = [pa.array([task + block]), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), _lists(pairs, np.array([0, len(pairs)]), pa.int64()), _lists(counts, np.array([0, len(counts)]), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array([1], pa.int32()), *row], names=[*names, "kind", *_made_names()])

        for batch in slices(batches, text_column):
            schema = batch.schema
            texts = batch.column(text_column).to_pylist()
            a, b = tokens_of(texts, a_side, b_side)
            of_a, of_b = overlaps(a, b)
            together = a.ends[of_a] == b.ends[of_b]
            link_a = np.sort(of_a[together])
            link_b = np.sort(of_b[together])
            doc = a.doc[link_a]
            n_links = np.bincount(doc, minlength=len(texts))
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups_text(a, b, link_a, link_b, size)]
            pair = (a.ids[link_a].astype(np.int64) << 32) | b.ids[link_b].astype(np.int64)
            order = np.lexsort((pair, doc))
            doc, pair = doc[order], pair[order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else np.zeros(0, bool))
            counts = np.diff(np.concatenate((first, [len(doc)])))
            edge = np.searchsorted(doc[first], np.arange(len(texts) + 1))
            pair = pair[first]
            new = [
                pa.array(np.full(len(texts), task + block), pa.int64()),
                pa.array(np.diff(a.edge), pa.int64()),
                pa.array(np.diff(b.edge), pa.int64()),
                pa.array(n_links, pa.int64()),
                pa.array(n_links, pa.int64()),
                pa.array(digests, pa.string()),
                _lists(pair, edge, pa.int64()),
                _lists(counts, edge, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(len(texts)), pa.int32()), *new], names=[*names, "kind", *_made_names()])
            met.append(summed(pair, counts))
            held += sum(len(t or "") for t in texts)
            if len(met) > 8:
                met = [summed(np.concatenate([k for k, _ in met]), np.concatenate([c for _, c in met]))]
            if held > BLOCK_BYTES:
                yield closed(schema)
                block, held, met = block + 1, 0, []
        if met:
            yield closed(schema)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, kind int, {_MADE}")


def _made_names() -> list[str]:
    return [x.split()[0] for x in _MADE.split(", ")]


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a_id, b_id, count over the corpus of every linked pair of ``blocks`` (pair, n), and whether it is its B id's highest (ties included)."""
    counted = blocks.groupBy("pair").agg(F.sum("n").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # at most as many pairs an id of B as A has ids
    best = F.col("count") == F.max("count").over(Window.partitionBy("b_id"))
    return counted.withColumns({"a_id": F.shiftright("pair", 32), "b_id": b_id}).withColumn("best", best)


def align(docs: DataFrame, a_path: str, b_path: str, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with counts of tokens, groups and links, the digest of the groups and the links' support in the corpus; and the corpus counts of all linked pairs."""
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUTS)
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # names that clash with nothing below
    text = f"c{columns.index(text_column)}"
    path = scratch(spark, "aligned")
    _aligned(plain, a_path, b_path, text).drop(text).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    carried = plain.drop(text).schema
    made = spark.createDataFrame([], _MADE).schema
    rows = lambda kind: spark.read.schema(type(carried)([*carried.fields, *made.fields])).parquet(f"{path}/kind={kind}") if _there(spark, f"{path}/kind={kind}") else None
    found, blocks = rows(0), rows(1)
    if found is None:
        none = docs.select("*", *[F.lit(None).cast("string" if n == "groups_sha256" else "long").alias(n) for n in OUTPUTS]).where("false").drop(text_column)
        return none, spark.createDataFrame([], "a_id long, b_id long, count long, best boolean")
    in_blocks = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = cut(pair_counts(in_blocks))
    known = in_blocks.select("block", "pair").join(counts.select("pair", "count", "best"), "pair")
    carried_names = carried.names

    def support(found: pa.Table, known: pa.Table) -> pa.Table:
        pairs = found.column("pairs").combine_chunks()
        at = np.asarray(pairs.offsets) if len(found) else np.zeros(1, np.int64)
        flat, n = np.asarray(pairs.flatten()), np.asarray(found.column("counts").combine_chunks().flatten())
        at = at - at[0]
        keys = np.asarray(known.column("pair"))
        order = np.argsort(keys)
        where = order[np.searchsorted(keys, flat, sorter=order)]
        count, best = np.asarray(known.column("count"))[where], known.column("best").to_numpy()[where]
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
        kept = [found.column(c) for c in [*carried_names, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]]
        return pa.Table.from_arrays([*kept, pa.array(total(n * best), pa.int64()), pa.array(total(n * count), pa.int64())], names=[*carried_names, *OUTPUTS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    kinds = f"{kinds}, " if kinds else ""
    out = found.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(support, f"{kinds}n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    names = [c for c in columns if c != text_column]
    return out.toDF(*names, *OUTPUTS), counts.select("a_id", "b_id", "count", "best")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def token_overlaps(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each pair of overlapping tokens: their places in the document, ids, byte ranges (of space and text) and whether they end together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = byte_level(a_path), piece_model(b_path)
        for batch in slices(batches, text_column):
            a, b = tokens_of(batch.column(text_column).to_pylist(), a_side, b_side)
            of_a, of_b = overlaps(a, b)
            order = np.lexsort((of_b, of_a))
            of_a, of_b = of_a[order], of_b[order]
            doc = a.doc[of_a]
            base = np.concatenate(([0], a.ends))[a.edge][doc]
            columns = [of_a - a.edge[doc], of_b - b.edge[doc], a.ids[of_a], b.ids[of_b], a.starts[of_a] - base, a.ends[of_a] - base, b.starts[of_b] - base, b.ends[of_b] - base]
            ids = batch.column(id_column).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in columns), pa.array(a.ends[of_a] == b.ends[of_b])], names=[id_column, "a_at", "b_at", "a_id", "b_id", "a_start", "a_end", "b_start", "b_end", "end_together"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, a_at long, b_at long, a_id long, b_id long, a_start long, a_end long, b_start long, b_end long, end_together boolean")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
