"""Jaccard self-join of word shingles by PartEnum signatures, and the groups its links form.

A document's set holds its distinct five-word shingles (lower-cased A-Z); a text of fewer words is one
shingle, a text without words has the empty set and no links.  Two sets link when
``100 * intersection >= 80 * union``.

* Bands: the set sizes are cut into bands that grow by a quarter.  A set joins the band of its size and
  each higher one in which it can still be the smaller side of a link.  In a band, two linked sets
  differ in at most k features, ``9 * difference <= sum of sizes``.
* Partitions: in a band the feature domain is cut into n1 first-level partitions, each into N2 second-level
  ones.  With n1 = ceil((k + 1) / (K2 + 1)) + m, linked sets differ by K2 features or fewer in at least
  m + 1 first-level partitions, and there agree on some N2 - K2 of the N2 second-level ones.
* Enumeration: each first-level partition gives one signature for every subset of N2 - K2 of its parts.  A
  signature without features is left out, unless more than m first-level partitions of the set have one;
  then the set gives all of them.  No link is lost, whatever the data.
* Groups: sets of one signature meet around one pivot, not in pairs.  Pairs that parity sketches (a bit or
  more for each feature) cannot rule out, as their distance never exceeds that of the sets, are compared
  exactly.  Where members of a signature still lie in different components, pairs across them that the
  sketches allow are compared exactly too.  So the components are those of all links.
* Exact comparison: documents with a common pivot share blocks of bounded size; a text is sent once to each
  pair of blocks in which it has candidates, however many these are.

Exact copies are one class from the start.  A signature that is common within a task's batch is reduced
to one pivot there before anything is shuffled.

Null or empty text: empty set.  ``doc_id`` is the key: rows that repeat an id with several texts are one
document with the links of all of them; rows without an id get an empty component.  An empty table gives an
empty result; extra columns don't matter.  Sets are told apart by 64-bit hashes of shingles: two different
shingles pass for one with a chance of about 1 in 10**19 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.arrays import by_row, grams, mix, pack, runs, slices, sorted_sets, unpack, utf8, words
from vantage.llm.base import cut, delete, scratch, stored, table
from vantage.llm.components import components

SHINGLE = 5
SKETCH_BITS = 512
PAIR_BYTES = 16_000_000
N2, K2 = 3, 1
SUBSETS = tuple(combinations(range(N2), N2 - K2))
KEYS_PER_BUCKET = 1_500_000
MEMBERS_PER_TASK = 50_000
MEMBERS_PER_BLOCK = 100_000
PAIRS_AT_ONCE = 250_000
TEXT_BLOCK = 2_000_000
TEXTS_PER_BLOCK = 512
GATHERED = 4_000_000
_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def shingles(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a batch of texts as (row, hash), ascending."""
    w = words(*utf8(text), lower=True)
    count = np.diff(w.offsets)
    values = grams(w.hashes, k)
    long = w.room(k)
    for short in range(1, k):
        own = w.offsets[:-1][count == short]
        if len(own):
            values[own] = mix(grams(w.hashes, short)[own] + _U(short))
            long[own] = True
    sizes = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return sorted_sets(np.concatenate(([0], np.cumsum(sizes))), values[long])


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, edges[:-1]) if len(values) else np.zeros(0, _U)


def set_ids(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a set, its size and a 64-bit hash of it."""
    edges = runs(rows)
    size = np.diff(edges)
    return rows[edges[:-1]] if len(rows) else rows, size, mix(_sums(mix(values + _U(7)), edges) + size.astype(_U)).view(np.int64)


@lru_cache(maxsize=4096)
def band(j: int) -> tuple[int, int]:
    """First size of band j and of the next one."""
    a = 1
    for _ in range(j):
        a = max(a + 1, a * 5 // 4)
    return a, max(a + 1, a * 5 // 4)


@lru_cache(maxsize=4096)
def layout(j: int) -> tuple[int, int]:
    """First-level partitions of band j (0: links there are equal sets), and how many may have an empty signature."""
    first, end = band(j)
    k = 2 * (end - 1) // 9
    if k == 0:
        return 0, 0
    least, best = max(1, -(-4 * first // 5)), (2.0, 0)
    need = -(-(k + 1) // (K2 + 1))
    for m in range(need + 2):
        void = (1 - 1 / ((need + m) * N2)) ** least
        gappy = sum(math.comb(N2, i) * void**i * (1 - void) ** (N2 - i) for i in range(N2 - K2, N2 + 1)) * (need + m)
        tail = 1 - sum(math.exp(i * math.log(gappy) - gappy - math.lgamma(i + 1)) for i in range(m + 1)) if gappy > 0 else 0.0
        best = min(best, (tail, m))
        if tail < 0.005:
            return need + m, m
    return need + best[1], best[1]


def bands_of(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each band with the indexes of the sets that take part in it."""
    j, most = 0, int(size.max()) if len(size) else 0
    while True:
        first, end = band(j)
        if 4 * first > 5 * most:
            return
        own = np.flatnonzero((size < end) & (5 * size >= 4 * first))
        if len(own) and layout(j)[0]:
            yield j, own
        j += 1


def signatures(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set index, signature) of the sets in (rows, values); a set's values ascend, so its partitions do too."""
    edges = runs(rows)
    size = np.diff(edges) if len(rows) else np.zeros(0, np.int64)
    weight = mix(values ^ _U(0xA5A5A5A5A5A5A5A5))
    out_set, out_key = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for j, own in bands_of(size):
        n1, m = layout(j)
        n = n1 * N2
        lengths = size[own]
        offset = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(edges[own] - offset, lengths)
        part = (((values[at] >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)
        place = np.repeat(np.arange(len(own)), lengths) * n + part
        cuts = runs(place)
        sums, counts = np.zeros(len(own) * n, _U), np.zeros(len(own) * n, np.int64)
        sums[place[cuts[:-1]]], counts[place[cuts[:-1]]] = _sums(weight[at], cuts), np.diff(cuts)
        sums, counts = sums.reshape(len(own), n1, N2), counts.reshape(len(own), n1, N2)
        subset = np.stack([sums[:, :, list(keep)].sum(axis=2, dtype=_U) for keep in SUBSETS], axis=2)
        void = np.stack([counts[:, :, list(keep)].sum(axis=2) for keep in SUBSETS], axis=2) == 0
        salt = _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        tag = mix(salt + np.arange(n1 * len(SUBSETS), dtype=_U)).reshape(1, n1, len(SUBSETS))
        given = ~void | (void.any(axis=2).sum(axis=1) > m)[:, None, None]
        which = np.nonzero(given)[0]
        out_set.append(own[which])
        out_key.append((mix(mix(subset) ^ tag) + void.astype(_U))[given])
    return np.concatenate(out_set), np.concatenate(out_key)


def sketch(values: np.ndarray) -> bytes:
    """Parity of the number of features in each slot; slots are a power of two, at least as many as features."""
    slots = SKETCH_BITS
    while slots < len(values):
        slots *= 2
    return np.packbits((np.bincount((values & _U(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8)).tobytes()


def _folded(blob: bytes, size: int) -> np.ndarray:
    own = np.frombuffer(blob, _U)
    return np.bitwise_xor.reduce(own.reshape(-1, size // 8), axis=0)


def near(left: np.ndarray, right: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Whether sizes and sketches of the sets left[i] and right[i] allow a link; never false for one."""
    out = 5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right])
    length = np.array([len(x) for x in sketches], np.int64)
    size = np.minimum(length[left], length[right])
    for common in np.unique(size[out]).tolist():
        own = np.flatnonzero(out & (size == common))
        used, place = np.unique(np.concatenate([left[own], right[own]]), return_inverse=True)
        bits = np.stack([_folded(sketches[i], common) for i in used.tolist()])
        a, b = place[: len(own)], place[len(own) :]
        step = max(1, PAIR_BYTES // common)
        for at in range(0, len(own), step):
            x, y = a[at : at + step], b[at : at + step]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            out[own[at : at + step]] = 9 * apart <= n[used[x]] + n[used[y]]
    return out


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (null for the empty set) and the parity sketch of every document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            rows, values = shingles(batch.column("text"))
            own, size, ids = set_ids(rows, values)
            sizes, hashes, none = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
            sizes[own], hashes[own], none[own] = size, ids, False
            cuts = np.searchsorted(rows, np.arange(n + 1)).tolist()
            sketches = [sketch(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(hashes, mask=none), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(emit, "doc_id long, n_shingles long, set_id long, sketch binary")


_GROUP = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
_SHIP, _STAR, _MEMBER = 0, 1, 2


def signature_groups(docs: DataFrame, n: int) -> DataFrame:
    """Rows (kind, a, b) of set ids: 1 pivot and member of one signature, 2 signature and member of a group of three or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, values = shingles(batch.column("text"))
            _, _, ids = set_ids(rows, values)
            at, key = signatures(rows, values)
            bucket = (key >> _U(32)) % _U(n)
            key, own = by_row((bucket << _U(32)) | (key & _LOW), ids[at])
            edges = runs(key)
            size = np.diff(edges)
            first = np.zeros(len(key), bool)
            first[edges[:-1]] = len(key) > 0
            pivot = np.repeat(own[edges[:-1]], size) if len(key) else own
            more = (np.repeat(size, size) > 1)[first] if len(key) else first
            a, b = by_row(pivot[~first], own[~first])
            rows_out = [
                *((k, _SHIP, p) for k, p in pack((key[first] >> _U(32)).astype(np.int64), own[first], (key[first] & _LOW).astype(np.uint32), more.astype(np.uint8))),
                *((k, _STAR, p) for k, p in pack((mix(a.view(_U)) % _U(n)).astype(np.int64), a, b)),
                *((k, _MEMBER, p) for k, p in pack((mix(own[~first].view(_U)) % _U(n)).astype(np.int64), own[~first], key[~first])),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows_out], pa.int32()), pa.array([r[1] for r in rows_out], pa.int32()), pa.array([r[2] for r in rows_out], pa.binary())],
                names=["bucket", "kind", "payload"],
            )

    def meet(group: pa.Table) -> pa.Table:
        kind, blobs = np.asarray(group.column("kind")), group.column("payload").to_pylist()
        of = lambda k: [x for x, y in zip(blobs, kind.tolist(), strict=True) if y == k]
        own, low, more = unpack(of(_SHIP), np.uint32, np.uint8)
        order = np.lexsort((own, low))
        own, low, more = own[order], low[order], more[order]
        keep = np.ones(len(own), bool)
        keep[1:] = (own[1:] != own[:-1]) | (low[1:] != low[:-1])
        edges = runs(low)
        distinct = np.add.reduceat(keep.astype(np.int64), edges[:-1]) if len(low) else np.zeros(0, np.int64)
        flagged = np.maximum.reduceat(more, edges[:-1]) > 0 if len(low) else np.zeros(0, bool)
        listed = _sums(np.where(keep, mix(own.view(_U)), _U(0)), edges)
        once = np.zeros(len(distinct), bool)
        once[np.unique(listed, return_index=True)[1]] = True
        star = np.repeat((distinct > 1) & (once | flagged), np.diff(edges)) & keep if len(low) else keep
        pivot = np.repeat(own[edges[:-1]], np.diff(edges)) if len(low) else own
        member = np.repeat(((distinct > 2) & once) | flagged, np.diff(edges)) & keep if len(low) else keep
        bucket = _U(group.column("bucket")[0].as_py()) << _U(32)
        a1, b1 = unpack(of(_STAR), np.int64)
        a, b = by_row(np.concatenate([a1, pivot[star]]), np.concatenate([b1, own[star]]))
        a, b = a[a != b], b[a != b]
        b2, a2 = unpack(of(_MEMBER), np.uint64)
        key = np.concatenate([a2, low[member].astype(_U) | bucket]).view(np.int64)
        who = np.concatenate([b2, own[member]])
        kinds = np.concatenate([np.full(len(a), _STAR), np.full(len(key), _MEMBER)])
        return pa.table([pa.array(kinds, pa.int32()), pa.array(np.concatenate([a, key])), pa.array(np.concatenate([b, who]))], schema=_GROUP)

    return docs.select("text").mapInArrow(emit, "bucket int, kind int, payload binary").groupBy("bucket").applyInArrow(meet, "kind int, a long, b long")


def _allowed(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, p, q) that sizes and sketches in p and q allow, as doc_ids (a, b)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column("p").flatten(), batch.column("q").flatten()
            n = np.concatenate([np.asarray(p[1]), np.asarray(q[1])])
            at = np.arange(batch.num_rows)
            good = near(at, at + batch.num_rows, n, p[2].to_pylist() + q[2].to_pylist())
            yield pa.RecordBatch.from_arrays([p[0], q[0]], names=["a", "b"]).filter(pa.array(good))

    return pairs.select("p", "q").mapInArrow(keep, "a long, b long")


def _links(left: np.ndarray, right: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the sets of the rows left[i] and right[i] link; ``left`` ascends."""
    _, code = np.unique(values, return_inverse=True)
    edges = np.searchsorted(rows, np.arange(int(max(left.max(), right.max())) + 2))
    size = np.diff(edges)
    seen, out = np.zeros(len(code) + 1, bool), np.zeros(len(left), bool)
    for first, last in zip(runs(left)[:-1].tolist(), runs(left)[1:].tolist(), strict=True):
        a = left[first]
        mine = code[edges[a] : edges[a + 1]]
        seen[mine] = True
        while first < last:
            many = np.cumsum(size[right[first:last]])
            until = first + max(1, int(np.searchsorted(many, GATHERED)))
            b = right[first:until]
            start = np.cumsum(size[b]) - size[b]
            at = np.arange(int(size[b].sum())) + np.repeat(edges[b] - start, size[b])
            hits = np.concatenate(([0], np.cumsum(seen[code[at]])))
            both = hits[start + size[b]] - hits[start]
            out[first:until] = (size[b] > 0) & (100 * both >= 80 * (len(mine) + size[b] - both))
            first = until
        seen[mine] = False
    return out


def verified(pairs: DataFrame, docs: DataFrame, homes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose sets link, compared exactly on their texts.

    homes: doc_id, home, block; documents that are likely to be compared share a home, and a block of a home is of
    bounded size.  The pairs between two blocks are one group, which gets each text once.
    """
    home = lambda c: homes.select(F.col("doc_id").alias(c), F.xxhash64("home", "block").alias(f"{c}_block"))
    dealt = cut(
        pairs.join(home("a"), "a").join(home("b"), "b").select("a", "b", F.xxhash64(F.least("a_block", "b_block"), F.greatest("a_block", "b_block")).alias("work"))
    )
    asked = dealt.select(F.col("work").alias("group"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(asked, "doc_id").select("group", "doc_id", "text")

    def compare(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        a, b = by_row(np.asarray(pairs.column("a")), np.asarray(pairs.column("b")))
        texts = texts.combine_chunks().sort_by("doc_id")
        ids = np.asarray(texts.column("doc_id"))
        rows, values, first = [np.zeros(0, np.int64)], [np.zeros(0, _U)], 0
        for batch in slices(iter(texts.to_batches()), "text"):
            own, found = shingles(batch.column("text"))
            rows.append(own + first)
            values.append(found)
            first += batch.num_rows
        rows, values = np.concatenate(rows), np.concatenate(values)
        low = [np.searchsorted(ids, x) for x in (a, b)]
        many = [np.searchsorted(ids, x, side="right") - y for x, y in zip((a, b), low, strict=True)]
        which = np.repeat(np.arange(len(a)), many[0] * many[1])  # an id with several texts has all of them compared
        turn = np.arange(len(which)) - np.repeat(np.cumsum(many[0] * many[1]) - many[0] * many[1], many[0] * many[1])
        left, right = low[0][which] + turn // np.maximum(many[1][which], 1), low[1][which] + turn % np.maximum(many[1][which], 1)
        order = np.argsort(left, kind="stable")
        good = np.unique(which[order][_links(left[order], right[order], rows, values)]) if len(order) else which
        return pa.table({"a": pa.array(a[good], pa.int64()), "b": pa.array(b[good], pa.int64())})

    return dealt.groupBy("work").cogroup(texts.groupBy("group")).applyInArrow(compare, "a long, b long")


def _homes(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, home and block of every class: home is its smallest pivot, and blocks of a home hold about TEXT_BLOCK bytes."""
    pivots = candidates.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("home"))
    placed = (
        classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n")).join(pivots, "doc_id", "left").select("doc_id", "n", F.coalesce("home", "doc_id").alias("home"))
    )
    size = F.greatest(F.ceil(F.sum("n") * 8 / TEXT_BLOCK), F.ceil(F.count(F.lit(1)) / TEXTS_PER_BLOCK))
    blocks = placed.groupBy("home").agg(size.alias("blocks"))
    return placed.join(blocks, "home").select("doc_id", "home", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"))


def _across(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of one signature group in different components that sizes and sketches allow.

    members: key, set_id, rep, n, component, home.  Groups in which the same home is the most frequent are compared together, so
    a pair that shares many signatures comes out once.  The members of a home are cut into blocks, alike in all its groups, that hold
    about MEMBERS_PER_BLOCK rows, and each pair of blocks is dealt to a task by itself; small homes share one.  A task gets the sketch
    of a class once, whatever the number of its signatures there.
    """
    homes = members.groupBy("key", "home").agg(F.count(F.lit(1)).alias("c"))
    groups = homes.groupBy("key").agg(F.max_by("home", F.struct("c", F.xxhash64("key", "home"))).alias("of"), F.sum("c").alias("c"))
    sizes = groups.groupBy("of").agg(F.ceil(F.sum("c") / MEMBERS_PER_BLOCK).cast("int").alias("blocks"))
    tasks = max(1, members.count() // MEMBERS_PER_TASK)
    # the number of blocks comes to the groups, one row each, so that members are never dealt by a home
    dealt = members.join(groups.select("key", "of").join(sizes, "of"), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j")
    )
    work = F.xxhash64("of", "i", "j")
    ready = stored(
        spread.select(F.pmod(work, F.lit(tasks)).alias("task"), work.alias("work"), "key", "set_id", "rep", "n", "component", "block", (F.col("i") == F.col("j")).alias("own")), "ready"
    )
    asked = ready.select(F.col("task").alias("to"), F.col("set_id").alias("of")).distinct()
    sketches = asked.join(classes.select(F.col("set_id").alias("of"), "sketch"), "of").select("to", "of", "sketch")

    def compare(group: pa.Table, sketches: pa.Table) -> pa.Table:
        at = lambda c: np.asarray(group.column(c))
        order = np.lexsort((at("n"), at("key"), at("work")))
        rep, n, part, block, own, key, work, ids = (at(c)[order] for c in ("rep", "n", "component", "block", "own", "key", "work", "set_id"))
        sketches = sketches.sort_by("of")
        blobs, place = sketches.column("sketch").to_pylist(), np.searchsorted(np.asarray(sketches.column("of")), ids)
        sizes, reps = np.zeros(len(blobs), np.int64), np.zeros(len(blobs), np.int64)
        sizes[place], reps[place] = n, rep
        run = np.cumsum(np.concatenate(([0], ((work[1:] != work[:-1]) | (key[1:] != key[:-1])).astype(np.int64)))) << 40
        here = np.arange(len(rep))
        count = np.searchsorted(run + n, run + n * 5 // 4, side="right") - here - 1
        kept, first = [], 0
        edge = np.concatenate(([0], np.cumsum(count)))
        while first < len(rep):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + PAIRS_AT_ONCE, side="right")) - 1)
            x = np.repeat(here[first:last], count[first:last])
            y = x + 1 + np.arange(len(x)) - np.repeat(edge[first:last] - edge[first], count[first:last])
            good = (part[x] != part[y]) & ((block[x] != block[y]) | own[x])
            x, y = place[x[good]], place[y[good]]
            x, y = by_row(np.minimum(x, y), np.maximum(x, y))  # a pair once, however many signatures it shares here
            good = near(x, y, sizes, blobs)
            x, y = reps[x[good]], reps[y[good]]
            kept.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
            first = last
        a, b = by_row(*np.concatenate(kept).T)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return ready.groupBy("task").cogroup(sketches.groupBy("to")).applyInArrow(compare, "a long, b long").distinct()


def _placed(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes with the component they are in so far."""
    return classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after new links (a, b); only the graph of the components they touch is gone through."""
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    touched = found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b")).where("a <> b").distinct()
    lower = components(touched).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(known.join(lower, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _open(grouped: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, set_id) of signature groups that still span several components."""
    members = stored(grouped.select("key", "set_id").join(_placed(classes, labels).select("set_id", "component"), "set_id").select("key", "set_id", "component"), "members")
    spans = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return stored(members.join(spans, "key").select("key", "set_id"), "open")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id and component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = docs.where(F.col("doc_id").isNotNull())
    sets = stored(shingle_sets(docs), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n = max(1, -(-total // KEYS_PER_BUCKET))
    classes = stored(
        sets.where("set_id is not null and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")),
        "classes",
    )
    met = scratch(spark, "groups")
    signature_groups(known, n).write.option("compression", "zstd").parquet(met)
    groups = spark.read.parquet(met)
    packed = classes.select("set_id", F.struct("rep", "n", "sketch").alias("x"))
    stars = groups.where(f"kind = {_STAR}").select("a", "b").distinct()
    candidates = cut(
        _allowed(stars.join(packed.withColumnsRenamed({"set_id": "a", "x": "p"}), "a").join(packed.withColumnsRenamed({"set_id": "b", "x": "q"}), "b"))
    )
    homes = cut(_homes(candidates, classes))
    labels = components(cut(verified(candidates, known, homes)))
    grouped = groups.where(f"kind = {_MEMBER}").select(F.col("a").alias("key"), F.col("b").alias("set_id")).distinct()
    members = _open(grouped, classes, labels)
    placed = members.join(_placed(classes, labels).drop("sketch"), "set_id").join(homes.select(F.col("doc_id").alias("rep"), "home"), "rep")
    pairs = cut(_across(placed, classes))
    labels = _merged(labels, cut(verified(pairs, known, homes)))
    delete(spark, met)
    reps = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("set_id").alias("_set"), F.coalesce("component", "rep").alias("component_id")
    )
    out = sets.select("doc_id", "n_shingles", "set_id").join(reps, F.col("set_id") == F.col("_set"), "left")
    return out.select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
