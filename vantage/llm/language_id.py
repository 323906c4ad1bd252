"""Language identification by a bidirectional gated recurrent network over bytes, trained here.

* Network: each direction has ``HIDDEN`` units; a byte's share of the gates is a row of a table, the state's share one
  small product.  Gates and candidates use the soft sign x / (1 + |x|) in place of tanh, which costs a third.  At every byte both states give a softmax over the languages, so every position has a label; a document's
  probabilities are the mean over all its positions, and the largest is its language and score (ties go to the language
  that sorts first).
* Reading: a text's bytes are dealt into windows of at most ``WINDOW`` bytes and even size, all of them read; many windows
  take a step together.
* Fitting: backpropagation through time and Adam, in numpy, over at most ``MOST_DOCUMENTS`` labelled documents a language
  (those with the smallest hash of id and text, repeats counted once) with up to ``WINDOWS_EACH`` windows of each, at even
  distances over the whole text.  Everything but this bounded sample stays where it is.

A text that is null or has no letter (general category L) is ``und`` with score 0.  Texts are read whole.  Rows with a
null id are never learned from and count as held out.  Rows that repeat an id or a text are each predicted.  Languages are
the distinct non-null values among the labelled rows; without any, every row is ``und``.  An empty table gives an empty
result.  Further columns are carried; those named as outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.arrays import slices, utf8
from vantage.llm.base import table

HIDDEN = 8
WINDOW = 64
MOST_DOCUMENTS = 1_500
WINDOWS_EACH = 6
ROUNDS = 4
BATCH = 512
RATE = 0.02
AT_ONCE = 4_096
PAD = 256
UNKNOWN = "und"
OUTPUTS = ("lang_pred", "score")


@dataclass
class Network:
    """tables[d, g, byte]: share of a byte in the gates (keep, reset, candidate) of direction d; states[d]: that of the state; out, bias: both states to languages."""

    languages: list[str]
    tables: np.ndarray
    states: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.states.shape[2]

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.states, self.out, self.bias]


def new_network(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    def drawn(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    tables = drawn(2, 3 * hidden, PAD + 1, scale=0.3)
    tables[:, :, PAD] = 0
    return Network(languages, tables, drawn(2, 3 * hidden, hidden, scale=hidden**-0.5), drawn(len(languages), 2 * hidden, scale=0.3), np.zeros((len(languages), 1), np.float32))


def _soft_sign(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|), in place: the shape of tanh at a third of its cost."""
    np.abs(x, out=room)
    np.add(room, 1, out=room)
    np.divide(x, room, out=x)


def forward(net: Network, codes: np.ndarray, direction: int, keep: bool) -> tuple[np.ndarray, list]:
    """States after each of the windows' bytes (time, hidden, windows), in the order of the text; and what backward() needs.

    ``codes`` is (time, windows).  At a PAD the state stays as it is, so the backward direction starts at the last byte.
    """
    steps, n = codes.shape
    h, table, state = net.hidden, net.tables[direction], net.states[direction]
    out = np.empty((steps, h, n), np.float32)
    before = np.zeros((h, n), np.float32)
    gates = np.empty((3 * h, n), np.float32)
    own = np.empty((3 * h, n), np.float32)
    room = np.empty((2 * h, n), np.float32)
    padded = (codes == PAD).any(axis=1)
    saved = []
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        np.take(table, codes[t], axis=1, out=gates, mode="clip")
        np.matmul(state, before, out=own)
        zr = gates[: 2 * h]
        np.add(zr, own[: 2 * h], out=zr)
        _soft_sign(zr, room)
        np.multiply(zr, 0.5, out=zr)
        np.add(zr, 0.5, out=zr)
        z, r, c = gates[:h], gates[h : 2 * h], gates[2 * h :]
        if padded[t]:
            z[:, codes[t] == PAD] = 1
        mixed = room[:h]
        np.multiply(r, own[2 * h :], out=mixed)
        np.add(c, mixed, out=c)
        _soft_sign(c, mixed)
        after = out[t]
        np.subtract(before, c, out=after)
        np.multiply(after, z, out=after)
        np.add(after, c, out=after)
        if keep:
            saved.append((t, before, z.copy(), r.copy(), c.copy(), own[2 * h :].copy()))
        before = after
    return out, saved


def backward(net: Network, codes: np.ndarray, direction: int, saved: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the state product from those of the states (time, hidden, windows), back through time."""
    steps, n = codes.shape
    h, state = net.hidden, net.states[direction]
    d_state = np.zeros_like(state)
    d_gates = np.empty((3 * h, steps, n), np.float32)
    carried = np.zeros((h, n), np.float32)
    for t, before, z, r, c, own in reversed(saved):
        d = grad[t] + carried
        stays = codes[t] == PAD
        # the slope of the soft sign s is (1 - |s|) ** 2; a gate is (1 + s) / 2
        d_z = d * (before - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2  # 0 at a PAD, where z is 1
        d_c = d * (1 - z) * (1 - np.abs(c)) ** 2
        d_r = d_c * own * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_gates[:h, t], d_gates[h : 2 * h, t], d_gates[2 * h :, t] = d_z, d_r, d_c
        if stays.any():
            d_gates[:, t, stays] = 0
        d_own = np.concatenate([d_z, d_r, d_c * r])
        d_state += d_own @ before.T
        carried = d * z + state.T @ d_own
    flat = codes.ravel()
    d_table = np.stack([np.bincount(flat, weights=d_gates[g].ravel(), minlength=PAD + 1) for g in range(3 * h)]).astype(np.float32)
    d_table[:, PAD] = 0
    return d_table, d_state


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """(languages, time, windows): at every position."""
    steps, n = codes.shape
    h = net.hidden
    ahead, _ = forward(net, codes, 0, False)
    back, _ = forward(net, codes, 1, False)
    out = np.empty((len(net.languages), steps, n), np.float32)
    for t in range(steps):
        out[:, t] = net.out[:, :h] @ ahead[t] + net.out[:, h:] @ back[t] + net.bias
    return _softmax(out)


def loss_and_gradients(net: Network, codes: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of the windows, and its gradient by every parameter."""
    steps, n = codes.shape
    h = net.hidden
    runs = [forward(net, codes, d, True) for d in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=1)  # time, 2 hidden, windows
    wide = both.transpose(1, 0, 2).reshape(2 * h, -1)
    p = _softmax(net.out @ wide + net.bias)
    here = (codes != PAD).ravel()
    row, column = np.tile(label, steps), np.arange(steps * n)
    total = max(int(here.sum()), 1)
    loss = float(-np.log(np.maximum(p[row, column], 1e-12))[here].sum() / total)
    p[row, column] -= 1
    p *= here / np.float32(total)
    d_wide = (net.out.T @ p).reshape(2 * h, steps, n).transpose(1, 0, 2)
    found = [backward(net, codes, d, runs[d][1], d_wide[:, d * h : (d + 1) * h]) for d in (0, 1)]
    return loss, [np.stack([f[0] for f in found]), np.stack([f[1] for f in found]), p @ wide.T, p.sum(axis=1, keepdims=True)]


def _window_codes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(time, windows): bytes, and PAD behind the last one."""
    time = np.arange(int(sizes.max()) if len(sizes) else 0)[:, None]
    inside = time < sizes
    codes = data[np.where(inside, starts + time, 0)].astype(np.int64)
    codes[~inside] = PAD
    return codes


def windows_of(at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and texts of the windows that cover the texts data[at[i]:at[i+1]]."""
    n = np.diff(at)
    parts = -(-n // window)
    text = np.repeat(np.arange(len(n)), parts)
    i = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, size, k = at[:-1][text], n[text], parts[text]
    starts = first + i * size // np.maximum(k, 1)
    return starts, first + (i + 1) * size // np.maximum(k, 1) - starts, text


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> Network:
    """A network for the languages among ``labels``; each language weighs the same in a round."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = new_network(languages, hidden, rng)
    if len(languages) < 2:
        return net
    sizes = np.array([len(w) for w in windows])
    data, starts = np.frombuffer(b"".join(windows), np.uint8), np.cumsum(sizes) - sizes
    number = np.searchsorted(languages, labels)
    of = [np.flatnonzero(number == i) for i in range(len(languages))]
    each = max(len(o) for o in of)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step, steps = 0, rounds * max(1, -(-each * len(of) // batch))
    for _ in range(rounds):
        # a round takes as many windows of each language, rarer ones again and again
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(o), each) for o in of]))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            _, grads = loss_and_gradients(net, _window_codes(data, starts[own], sizes[own]), number[own])
            step += 1
            now = rate * (1 - step / (steps + 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-12))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, data: np.ndarray, at: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """(texts, languages): mean probabilities over all positions of each text.  ``labels``, one for each byte, is filled in if given."""
    starts, sizes, text = windows_of(at)
    total = np.zeros((len(at) - 1, len(net.languages)))
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), AT_ONCE):
        own = order[i : i + AT_ONCE]
        codes = _window_codes(data, starts[own], sizes[own])
        p = probabilities(net, codes)
        if labels is not None:
            inside = codes != PAD
            labels[(starts[own] + np.arange(len(codes))[:, None])[inside]] = p.argmax(axis=0)[inside]
        if (codes[-1] == PAD).any():
            p *= codes != PAD
        np.add.at(total, text[own], p.sum(axis=1).T)
    return total / np.maximum(np.diff(at), 1)[:, None]


def _hash(id_column: str, text_column: str) -> Column:
    return F.xxhash64(id_column, text_column, F.lit(5))


def fit(docs: DataFrame, learned: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most: int = MOST_DOCUMENTS, each: int = WINDOWS_EACH) -> Network | None:
    """Trained on a bounded sample of the rows for which ``learned`` holds; None where there are no labelled rows."""
    known = docs.where(F.coalesce(learned, F.lit(False)) & F.col(lang_column).isNotNull() & F.col(id_column).isNotNull())
    counts = {r.lang: r.n for r in known.groupBy(F.col(lang_column).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    known = known.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), _hash(id_column, text_column).alias("hash")).where(F.col("text").rlike(r"\p{L}"))
    # about twice as many as asked for pass by their hash, so what meets in one place doesn't grow with the table
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * most / n))).otherwise(share)
    passing = known.where(F.shiftrightunsigned("hash", 11) < share * float(1 << 53))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = utf8(batch.column("text"))
            starts, sizes, text = windows_of(at)
            count = np.bincount(text, minlength=len(at) - 1)
            first = np.cumsum(count) - count
            lists = [[data[starts[f + j * n // k] :][: sizes[f + j * n // k]].tobytes() for j in range(k)] for f, n, k in zip(first.tolist(), count.tolist(), np.minimum(count, each).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(lists, pa.list_(pa.binary()))], names=["lang", "hash", "windows"])

    once = passing.mapInArrow(drawn, "lang string, hash long, windows array<binary>").groupBy("lang", "hash").agg(F.first("windows").alias("windows"))
    found: dict[str, list] = {}
    for r in once.collect():
        found.setdefault(r.lang, []).append((r.hash, r.windows))
    pairs = [(bytes(w), lang) for lang, rows in sorted(found.items()) for _, windows in sorted(rows)[:most] for w in windows]
    return train([w for w, _ in pairs], [x for _, x in pairs]) if pairs else None


def predict(docs: DataFrame, net: Network | None, text_column: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score; with ``spans`` also the runs of positions (byte offsets, end exclusive) of one label."""
    outputs = OUTPUTS + ("lang_spans",) * spans
    docs = docs.drop(*outputs)
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{columns.index(text_column)}"
    marked = plain.withColumn("lettered", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = [*plain.columns, *outputs]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, text):
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            languages = np.array([*(net.languages if net else []), UNKNOWN], object)
            best, score, runs = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            own = np.flatnonzero(lettered)
            if net is not None and len(own):
                data, at = utf8(batch.column(text).take(pa.array(own)))
                labels = np.zeros(len(data), np.int64) if spans else None
                mean = pooled(net, data, at, labels)
                best[own] = mean.argmax(axis=1)
                score[own] = np.minimum(mean.max(axis=1), 1.0)
                for i, a, b in zip(own.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True) if spans else ():
                    edge = np.flatnonzero(np.diff(labels[a:b])) + 1
                    edge = [0, *edge.tolist(), b - a]
                    runs[i] = [{"start": x, "end": y, "lang": languages[labels[a + x]]} for x, y in zip(edge[:-1], edge[1:], strict=True)]
            more = [pa.array(runs, run_type)] * spans
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages[best].tolist(), pa.string()), pa.array(score), *more], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    more = ", lang_spans array<struct<start:long,end:long,lang:string>>" * spans
    return marked.mapInArrow(run, f"{kinds}, lang_pred string, score double{more}").toDF(*columns, *outputs)


def held_out(id_column: str = "doc_id") -> Column:
    """A third of the ids, and rows without one."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), *OUTPUTS)
