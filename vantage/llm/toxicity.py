"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read a clause word by word: negation, reported speech, target, threat and insult.
They are composed into one table of states, so a word costs one lookup.

* Insult: an insulting word together with at least one more word of its clause; the word's learned weight
  is held back until the clause has one.  Such a word that is a whole clause matches nothing.
* Threat: a violent verb at most two words after a modal.
* Target: a pronoun of address or of a person; it raises the matches of its clause by a quarter.
* Negation and reported speech: they lower the matches in their reach.

Words outside a match score nothing.  A document is scored by its strongest clause and by the sum over all
clauses, through a logistic curve.

Insult stems (whole words, and beginnings of six to nine letters, as shorter ones begin plain words too) and the curve are learned from
labelled rows outside the held-out fifth (crc32 of the id as text, modulo 5, is 0).  At most
``MOST_LABELLED`` labelled rows are used, those with the smallest hash of the id; every stem of theirs is
a candidate, and a stem must carry more information about the label than chance would give
among as many candidates.  Nothing but the text enters a score.

Null and empty texts have no clauses and get the lowest score.  Without labels of both kinds every score
is the share of toxic labels (0 if there are none).  Rows without an id are scored and not held out.
Repeated rows and extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.base import stored, table

MOST_LABELLED = 8_000
PREFIXES = (6, 7, 8, 9)
CACHED_WORDS = 400_000
OUTPUTS = ("held_out", "score", "predicted")

# Fixed vocabularies of the grammar, function words and a few verbs; insults are learned.
NEGATION = frozenset("not never no nobody isn aren wasn don doesn nicht kein keine nie pas jamais nunca jamás".split())
REPORT = frozenset("said says called calls wrote claimed quoted quote sagte nannte schrieb dit écrit appelé dijo llamó escribió".split())
TARGET = frozenset("you your you're u he she they them him her du dich ihr euch tu toi vous ils usted ustedes ellos".split())
MODAL = frozenset("will gonna shall going werde voy vais".split())
VIOLENCE = frozenset("kill hurt destroy beat burn shoot stab murder töten tuer matar".split())

OTHER, INSULT, NEGATE, REPORTED, AT, WILL, HARM = range(7)
END = 8  # added to the symbol of a word that ends its clause
NEGATED_WORDS = 3
THREAT_WEIGHT = 2.0
TARGETED = 1.25
MOST_TOTAL = 20.0


def _negation(state: int, symbol: int) -> tuple[int, float]:
    """State: words that the negation still covers."""
    return (NEGATED_WORDS if symbol == NEGATE else max(0, state - 1)), 0.4 if state else 1.0


def _report(state: int, symbol: int) -> tuple[int, float]:
    return (1 if symbol == REPORTED else state), 0.6 if state else 1.0


def _target(state: int, symbol: int) -> tuple[int, float]:
    return (1 if symbol == AT else state), 1.0


def _threat(state: int, symbol: int) -> tuple[int, float]:
    """State 2 and 1: a modal stands one or two words back."""
    return (2 if symbol == WILL else max(0, state - 1)), THREAT_WEIGHT if symbol == HARM and state else 0.0


START, WITHIN, ALONE = range(3)


def _insult(state: int, symbol: int) -> tuple[int, bool]:
    """State after a word, and whether the clause now bears an insult: it has another word besides."""
    if state == START:
        return (ALONE if symbol == INSULT else WITHIN), symbol != INSULT
    return WITHIN, True


State = tuple[int, int, int, int, int]


def _compose() -> dict[tuple[State, int], tuple[State, float, float, bool]]:
    """All reachable states of the five side by side: (state, symbol) to (state, factor of an insult, weight of a threat, insults count)."""
    start = (0, 0, 0, 0, START)
    arcs, open_states, seen = {}, [start], {start}
    while open_states:
        state = open_states.pop()
        for symbol in range(7):
            (n, fn), (r, fr), (t, _), (h, wh), (i, bears) = (
                f(s, symbol) for f, s in zip((_negation, _report, _target, _threat, _insult), state, strict=True)
            )
            to = (n, r, t, h, i)
            arcs[state, symbol] = (to, fn * fr, wh * fn * fr, bears)
            if to not in seen:
                seen.add(to)
                open_states.append(to)
    return arcs


ARCS = _compose()
_LETTERS = re.compile(r"[^\W\d_]+")


def stems_of(word: str) -> list[str]:
    """A word whole, its beginnings, and those that at least three more letters follow."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k), *(word[:k] + "+" for k in PREFIXES if len(word) >= k + 3)]


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float, float] = (-30.0, 0.0, 0.0, 0.0)

    def symbol(self, token: str) -> tuple[int, float]:
        """Symbol and insult weight of a token between white space."""
        best, weight = OTHER, 0.0
        for word in _LETTERS.findall(token):
            own = max(self.stems.get(stem, 0.0) for stem in stems_of(word))
            if own > weight:
                best, weight = INSULT, own
            elif best == OTHER:
                best = next((s for s, v in ((NEGATE, NEGATION), (REPORTED, REPORT), (AT, TARGET), (WILL, MODAL), (HARM, VIOLENCE)) if word in v), OTHER)
        return best + (END if token[-1] in ".!?;:\"»”" else 0), weight

    def clauses(self, tokens: list[str], codes: bytes) -> tuple[float, float]:
        """Score of the strongest clause, and the sum of all."""
        fresh = (0, 0, 0, 0, START)
        state, held, mass, most, total = fresh, 0.0, 0.0, 0.0, 0.0
        for token, code in zip(tokens, codes, strict=True):
            symbol = code & 7
            state, factor, threat, bears = ARCS[state, symbol]
            if symbol == INSULT:
                held += factor * self.symbol(token)[1]
            if bears:
                mass, held = mass + held, 0.0
            mass += threat
            if code & END:
                mass *= TARGETED if state[2] else 1.0
                most, total, mass, held, state = max(most, mass), total + mass, 0.0, 0.0, fresh
        mass *= TARGETED if state[2] else 1.0
        return max(most, mass), total + mass

    def score(self, most: float, total: float) -> float:
        a, b, c, d = self.curve
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * most + c * math.log1p(total) + d * min(total, MOST_TOTAL)))))


class _Codes(dict):
    """Symbol of each token seen so far; emptied when it has grown too large."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        code = self[token] = self.model.symbol(token)[0]
        return code


_HITS = bytes(1 if (c & 7) in (INSULT, HARM) else 0 for c in range(256))


def readings(texts: Iterator[str | None], codes: _Codes) -> Iterator[tuple[float, float]]:
    for text in texts:
        tokens = (text or "").lower().split()
        found = bytes(map(codes.__getitem__, tokens))
        yield codes.model.clauses(tokens, found) if 1 in found.translate(_HITS) else (0.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _stems(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    per_doc = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(F.concat(F.lit("="), w), *(F.when(F.length(w) >= k, F.substring(w, 1, k)) for k in PREFIXES), *(F.when(F.length(w) >= k + 3, F.concat(F.substring(w, 1, k), F.lit("+"))) for k in PREFIXES)))))
    counts = sample.select("toxic", F.explode(per_doc).alias("stem")).where("stem is not null").groupBy("stem").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    base = toxic / (toxic + clean)
    share = (F.col("t") + 0.01) / (F.col("n") + 0.02)
    gain = F.col("t") * F.log(share / base) + (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - base))
    strong = counts.where(share > max(0.5, base)).withColumn("gain", gain)
    need = math.log(max(counts.count(), 2)) + 3
    rows = strong.where(F.col("gain") >= need).collect()
    return {r.stem: math.log((r.t + 0.5) / (r.n - r.t + 0.5)) - math.log(base / (1 - base)) for r in rows}


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Logistic regression by damped Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-4, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learns stems and curve from ``labels`` (doc_id, toxic) of the rows of ``docs`` that are not held out."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    toxic, count = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < toxic < count:
        return Model(curve=(30.0 if toxic else -30.0, 0.0, 0.0, 0.0))
    model = Model(_stems(sample, toxic, count - toxic))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(model)
        for batch in batches:
            got = list(readings(batch.column("text").to_pylist(), codes))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["y", "most", "total"])

    seen = sample.mapInArrow(read, "y int, most double, total double").toPandas()
    model.curve = _curve(np.column_stack([seen["most"], np.log1p(seen["total"]), seen["total"].clip(upper=MOST_TOTAL)]), seen["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    docs = docs.drop(*OUTPUTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(model)
        for batch in batches:
            got = [model.score(*x) for x in readings(batch.column("text").to_pylist(), codes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = docs.mapInArrow(read, f"{kinds}, score double")
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *OUTPUTS)
