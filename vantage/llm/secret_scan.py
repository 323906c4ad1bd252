"""Secrets in texts, with DataFrame functions only.

Three base patterns (assigned passwords and keys, access keys, long hexadecimal runs) are matched leftmost
and without overlap.  Positions come from splitting the text at the matches and adding up lengths, in code
points, end exclusive.  On top, candidate strings (20 or more characters of base64 alphabet with both digits
and letters) are read by a sliding window of 20 characters whose Shannon entropy is kept up to date from
counts: one character leaves, one enters, and only their two terms change.  A candidate whose best window
reaches the threshold of its character class (hexadecimal or base64) is added as kind ``entropy``, unless an
allow-list pattern matches it or a base span already covers it.

Null and empty texts have no spans.  Ids are carried, not used, so null or repeated ids and repeated rows
are fine; an empty table gives an empty result; input columns with the names of outputs are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.base import table

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/_=-"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CHUNK = 256
HEX_BITS = 3.0
BASE64_BITS = 3.6
#: What looks random but is no secret: UUIDs, dates and times, counters, one character repeated, placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=+/-]+$",
    r"^\d{4}-\d{2}-\d{2}",
    r"(.)\1{7,}",
    r"(?i:example|placeholder|changeme|your[_-]?(?:key|token|secret)|0123456789|abcdefgh)",
)
OUTPUTS = ("spans",)


def _spans(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Matches as array of (start, order, end, kind, match).

    Positions are running sums of lengths.  They are carried through chunks of CHUNK matches, and then inside each chunk, so
    that a text with very many matches costs a small multiple of their number, not its square.
    """
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("match"))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,match:string>>")
    length = lambda p: F.length(p["part"]) + F.length(p["match"])

    def step(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["part"])
        end = start + F.length(pair["match"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("match")
        )
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(p: Column) -> Column:
        chunk = lambda k: F.slice(p, k * CHUNK + 1, F.lit(CHUNK))
        numbers = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int"))
        sums = F.transform(numbers, lambda k: F.aggregate(chunk(k), F.lit(0), lambda acc, x: acc + length(x)))
        begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("at"))
        bases = F.aggregate(sums, begin, lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["at"], F.array(acc["pos"])).alias("at")), lambda acc: acc["at"])
        inside = lambda base, k: F.aggregate(chunk(k), F.struct(base.alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.transform(bases, inside))

    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(pairs), placed), 1)).otherwise(none)


def _term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def best_entropy(candidate: Column) -> Column:
    """Largest Shannon entropy, in bits a character, of the windows of a string of at least WINDOW characters."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    none = F.array_repeat(F.lit(0), len(ALPHABET) + 1)

    def bump(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda n, i: F.when(i == code, n + by).otherwise(n))

    def step(acc: Column, pair: Column) -> Column:
        gone, come = pair["gone"], pair["come"]
        left = F.when(gone >= 0, F.element_at(acc["n"], gone + 1)).otherwise(F.lit(0))
        counts = F.when(gone >= 0, bump(acc["n"], gone, -1)).otherwise(acc["n"])
        have = F.element_at(counts, come + 1)
        total = acc["s"] + _term(left - 1) - _term(left) + _term(have + 1) - _term(have)
        full = acc["i"] + 1 >= WINDOW
        bits = F.when(full, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(F.lit(0.0))
        return F.struct(bump(counts, come, 1).alias("n"), total.alias("s"), (acc["i"] + 1).alias("i"), F.greatest(acc["best"], bits).alias("best"))

    start = F.struct(none.alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))
    gone = F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(codes, 1, F.greatest(F.size(codes) - WINDOW, F.lit(0))))
    return F.aggregate(F.arrays_zip(gone.alias("gone"), codes.alias("come")), start, step, lambda acc: acc["best"])


def _random(match: Column) -> Column:
    mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    allowed = match.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    need = F.when(match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    return F.when(mixed & ~allowed, best_entropy(match) >= need).otherwise(F.lit(False))


def secret_scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with spans: array of (kind, start, end), by start and then by kind as listed in KINDS."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    value = F.regexp_extract
    assign = F.filter(_spans(text, ASSIGN, "assign"), lambda s: F.length(value(s["match"], ASSIGN, 1)) >= 8)
    base = docs.drop(*OUTPUTS).withColumn("_base", F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))
    extra = F.filter(
        _spans(text, CANDIDATE, "entropy"),
        lambda s: F.when(F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])), F.lit(False)).otherwise(_random(s["match"])),
    )
    spans = F.transform(F.array_sort(F.concat("_base", extra)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return base.withColumn("spans", spans).drop("_base")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or each run of overlapping spans, replaced by one mark."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        return (
            F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), before.alias("out")))
            .otherwise(F.struct(F.greatest(s["end"], acc["pos"]).alias("pos"), acc["out"].alias("out")))
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return out.select("doc_id", *map(number, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number("entropy"))
