"""Byte-level BPE by replaying merges over a corpus of words.

A task takes the distinct pretokens of its texts that it has not met yet as one corpus.  All their bytes
stand in one doubly linked list; an inverted index maps each adjacent pair that has a rank to the
positions where it begins.  Merges are replayed in rank order: the lowest rank with entries is taken, all
its positions merge from left to right, and only the pairs on either side of a merged position are
entered anew.  Entries that an earlier merge has overtaken no longer match and are skipped.  The outcome for
a word is that of merging its lowest-ranked pair first, again and again.

Decoding maps ids to byte strings and joins them.  Null text counts as empty and gives no ids.  Ids of
documents are carried, not used; repeated rows, an empty table and extra columns are fine; input columns
with the names of outputs are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.arrays import slices
from vantage.llm.base import table
from vantage.llm.pretokens import Ids

OUTPUTS = ("ids", "n_tokens", "decoded")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids from a file of base64 strings and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Merges:
    """The vocabulary as merges: which pair of ids gives which id."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.byte = [vocabulary[bytes([i])] for i in range(256)]
        self.strings = {i: s for s, i in vocabulary.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        for s, i in vocabulary.items():
            for cut in range(1, len(s)):
                a, b = vocabulary.get(s[:cut]), vocabulary.get(s[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        byte, pairs = self.byte, self.pairs
        ids: list[int] = []
        after: list[int] = []
        before: list[int] = []
        first: list[int] = []
        index: dict[tuple[int, int], list[int]] = defaultdict(list)
        for w in words:
            at, n = len(ids), len(w)
            first.append(at if n else -1)
            ids.extend([byte[x] for x in w])
            before.extend(range(at - 1, at + n - 1))
            after.extend(range(at + 1, at + n + 1))
            if n:
                before[at], after[-1] = -1, -1
            for i in range(at, at + n - 1):
                pair = (ids[i], ids[i + 1])
                if pair in pairs:
                    index[pair].append(i)
        waiting = [(pairs[p], p) for p in index]
        heapq.heapify(waiting)
        while waiting:
            rank, pair = heapq.heappop(waiting)
            a, b = pair
            for i in sorted(index.pop(pair, ())):
                j = after[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue
                ids[i] = rank
                ids[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    new = (rank, ids[k])
                    if new in pairs:
                        if new not in index:
                            heapq.heappush(waiting, (pairs[new], new))
                        index[new].append(i)
                h = before[i]
                if h >= 0:
                    new = (ids[h], rank)
                    if new in pairs:
                        if new not in index:
                            heapq.heappush(waiting, (pairs[new], new))
                        index[new].append(h)
        out = []
        for i in first:
            own = []
            while i >= 0:
                own.append(ids[i])
                i = after[i]
            out.append(own)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Merges, Ids]:
    merges = Merges(ranks(path))
    return merges, Ids(lambda words: merges.replay([w.encode("utf-8", "surrogatepass") for w in words]), kind=np.uint16 if max(merges.strings) < 1 << 16 else np.uint32)


def encode_decode(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit integers), n_tokens, and the bytes that the ids decode to."""
    docs = docs.drop(*OUTPUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, encode = _encoder(path)
        size = max(merges.strings) + 1
        strings = [merges.strings.get(i, b"") for i in range(size)]
        length = np.array([len(s) for s in strings], np.int64)
        pool = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.cumsum(length) - length
        for batch in slices(batches, text_column):
            flat, edge = encode([t or "" for t in batch.column(text_column).to_pylist()])
            n = length[flat]
            to = np.concatenate(([0], np.cumsum(n)))
            decoded = pool[np.repeat(begin[flat] - to[:-1], n) + np.arange(to[-1])].tobytes()
            wide = flat.astype("<u4").tobytes()
            cut = to[edge].tolist()
            at = edge.tolist()
            new = [
                pa.array([wide[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                pa.array(np.diff(edge)),
                pa.array([decoded[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *OUTPUTS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, ids binary, n_tokens long, decoded binary")


def count_tokens(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """``docs`` with n_tokens, the number of ids of the text."""
    docs = docs.drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = _encoder(path)
        for batch in slices(batches, text_column):
            _, edge = encode([t or "" for t in batch.column(text_column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(edge), pa.int64())], names=[*batch.schema.names, "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, n_tokens long")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
