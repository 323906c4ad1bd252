"""Reading delivered files as text, typed coercion with corrections, validation, knowledge time, idempotent append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import let, listed

#: Contracts of delivered datasets: column -> (kind, required, other names).  Fixed values of the format.
CONTRACTS: dict[str, dict[str, tuple[str, bool, tuple[str, ...]]]] = {
    "daily_bars": {
        "instrument_id": ("int", True, ("id",)),
        "session_date": ("date", True, ("date", "day")),
        "open": ("decimal", True, ("o",)),
        "high": ("decimal", True, ("h",)),
        "low": ("decimal", True, ("l",)),
        "close": ("decimal", True, ("c", "adj_close")),
        "volume": ("decimal", True, ("v", "vol")),
        "vwap": ("decimal", False, ()),
    },
    "splits": {"instrument_id": ("int", True, ("id",)), "ex_date": ("date", True, ("date",)), "ratio": ("decimal", True, ("factor",))},
}
REQUIRES = {"daily_bars": ("instruments",), "splits": ("instruments", "daily_bars"), "dividends": ("instruments", "daily_bars"), "fundamentals": ("instruments",)}


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV (also gzipped) as text cells; types are a matter of the contract, never inferred."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False)


def read_parquet_as_text(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


def write_delimited(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.csv(path, header=True, compression="gzip")


def mapped(raw: DataFrame, dataset: str) -> DataFrame:
    """Contract columns by name or other name, in contract order; missing ones are null."""
    have = {c.lower(): c for c in raw.columns}
    pick = []
    for name, (_, _, others) in CONTRACTS[dataset].items():
        source = next((have[x] for x in (name, *others) if x in have), None)
        pick.append((F.col(source) if source else F.lit(None).cast("string")).alias(name))
    keep = [c for c in ("file", "line") if c in raw.columns]
    return raw.select(*pick, *keep)


def mapping_report(raw: DataFrame, dataset: str) -> DataFrame:
    """column and problem: required columns that are missing, delivered columns that nothing uses."""
    contract = CONTRACTS[dataset]
    known = {x for name, (_, _, others) in contract.items() for x in (name, *others)}
    have = {c.lower() for c in raw.columns}
    rows = [(n, "missing_required") for n, (_, need, others) in contract.items() if need and not have & {n, *others}]
    rows += [(c, "unused") for c in sorted(have - known - {"file", "line"})]
    return raw.sparkSession.createDataFrame(rows, "column string, problem string")


def coerced(kind: str, text: Column, decimal_comma: bool = False) -> tuple[Column, Column]:
    """The typed value (null if it can't be) and the name of the correction that was needed (null if none).

    A comma is a decimal comma only where the delivery says so; then points group thousands, and digits that mix the two
    the other way are refused.
    """
    t = F.trim(text)
    if kind == "int":
        return F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.cast("long")), F.when(t != text, "trimmed")
    if kind == "date":
        iso, slashed, packed = t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.rlike(r"^\d{4}/\d{2}/\d{2}$"), t.rlike(r"^\d{8}$")
        value = F.when(iso, F.try_to_date(t, "yyyy-MM-dd")).when(slashed, F.try_to_date(t, "yyyy/MM/dd")).when(packed, F.try_to_date(t, "yyyyMMdd"))
        return value, F.when(slashed, "slashes").when(packed, "packed_date").when(t != text, "trimmed")
    if kind == "decimal":
        value, rule = _number(t, text, decimal_comma)
        if decimal_comma:
            return value, rule
        plain, number = t.rlike(r"^[+-]?\d+(\.\d+)?\z"), t.try_cast("decimal(28,6)")  # most cells; the other readings aren't tried on them
        return F.when(plain, number).otherwise(value), F.when(plain, F.when(number.isNotNull() & (t != text), "trimmed")).otherwise(rule)
    if kind == "bool":
        low = F.lower(t)
        return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False), F.when(t != text, "trimmed")
    return F.when(t != "", t), F.when(t != text, "trimmed")


def _number(t: Column, text: Column, decimal_comma: bool) -> tuple[Column, Column]:
    """Value and correction of a cell that may hold symbols, separators or brackets."""
    parsed = let(F.regexp_replace(t, r"[$€£\s]", ""), lambda x: _decimal(x, decimal_comma))
    rule = F.coalesce(parsed["rule"], F.when(F.regexp_replace(t, r"[$€£\s]", "") != t, "symbols"), F.when(t != text, "trimmed"))
    return parsed["value"], F.when(parsed["value"].isNotNull(), rule)


def _decimal(bare: Column, decimal_comma: bool = False) -> Column:
    """(value, rule) of digits with decimal comma, thousands separators or accounting brackets; a percentage is refused."""
    negative = bare.rlike(r"^\(.*\)$")

    def read(inner: Column) -> Column:
        if decimal_comma:
            comma, thousands = inner.rlike(r"^-?\d+,\d+$"), inner.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$")
            plain = F.when(comma | thousands, F.replace(F.replace(inner, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(~inner.contains("."), inner)
        else:
            comma, thousands = F.lit(False), inner.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")
            plain = F.when(thousands, F.regexp_replace(inner, ",", "")).otherwise(inner)
        return F.struct(F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain.try_cast("decimal(28,6)")).alias("value"), F.when(comma, "decimal_comma").when(thousands, "thousands").alias("rule"))

    got = let(F.when(negative, F.concat(F.lit("-"), F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare), read)
    return F.struct(got["value"].alias("value"), F.when(negative, "accounting_negative").otherwise(got["rule"]).alias("rule"))


def normalised(mapped_rows: DataFrame, dataset: str, decimal_comma: bool = False) -> DataFrame:
    """Typed columns, the raw row, ``corrections`` (array of field, raw, rule) and ``errors`` (fields that can't be read).

    Each cell is read once, in a projection of its own; what is said about it is derived from that.
    """
    contract = CONTRACTS[dataset]
    read = {name: coerced(kind, F.col(name), decimal_comma) for name, (kind, _, _) in contract.items()}
    cells = mapped_rows.withColumns({f"_{part}_{name}": column for name, pair in read.items() for part, column in zip(("value", "rule"), pair, strict=True)})
    values, fixes, errors = [], [], []
    for name, (_, need, _) in contract.items():
        value, rule = F.col(f"_value_{name}"), F.col(f"_rule_{name}")
        empty = F.col(name).isNull() | (F.trim(name) == "")
        values.append(value.alias(name))
        fixes.append(F.when(rule.isNotNull(), F.struct(F.lit(name).alias("field"), F.col(name).alias("raw"), rule.alias("rule"))))
        bad = value.isNull() if need else value.isNull() & ~empty
        errors.append(F.when(bad, F.when(empty, F.concat(F.lit("missing:"), F.lit(name))).otherwise(F.concat(F.lit("unreadable:"), F.lit(name)))))
    keep = [c for c in mapped_rows.columns if c not in contract]
    return cells.select(*values, *keep, F.struct(*contract).alias("raw"), F.array_compact(F.array(*fixes)).alias("corrections"), F.array_compact(F.array(*errors)).alias("errors"))


def validated_bars(rows: DataFrame) -> DataFrame:
    """Adds ``reasons`` (row can't stay) and ``flags`` (row stays, noted)."""
    reasons = listed(
        price_not_positive=F.least("open", "high", "low", "close") <= 0,
        high_below=F.col("high") < F.greatest("open", "close", "low"),
        low_above=F.col("low") > F.least("open", "close"),
        negative_volume=F.col("volume") < 0,
    )
    return rows.withColumn("reasons", reasons).withColumn("flags", listed(no_volume=F.col("volume") == 0, flat=F.col("high") == F.col("low")))


def cross_checked(rows: DataFrame, export_date: Column, spike: float = 10.0) -> DataFrame:
    """Duplicate keys, dates past the export, and closes beyond a multiple of the close before, in file order.

    Rows with ``errors`` are passed over: they lie in lots of their own, dealt by what was delivered, and keep their reasons.
    Both windows share one shuffle and one sort.
    """
    good = F.size("errors") == 0 if "errors" in rows.columns else F.lit(True)
    lot = ["instrument_id", F.when(~good, F.xxhash64("raw")).alias("_lot")] if "errors" in rows.columns else ["instrument_id"]
    series = Window.partitionBy(*lot).orderBy("session_date", "line")
    key = Window.partitionBy(*lot, "session_date").orderBy("line")
    marked = rows.withColumn("_was", F.lag("close").over(series)).withColumn("_nth", F.row_number().over(key))
    ratio = F.greatest(F.col("close") / F.col("_was"), F.col("_was") / F.col("close"))
    extra = listed(duplicate_key=F.col("_nth") > 1, after_export=F.col("session_date") > export_date, spike=ratio > spike)
    return marked.withColumn("reasons", F.when(good, F.concat("reasons", extra)).otherwise(F.col("reasons"))).drop("_nth", "_was")


def staged(rows: DataFrame) -> DataFrame:
    """Adds stage and reason: normalize, validate or dated."""
    return rows.withColumn("stage", F.when(F.size("errors") > 0, "normalize").when(F.size("reasons") > 0, "validate").otherwise("dated")).withColumn(
        "reason", F.array_join(F.concat("errors", "reasons"), ",")
    )


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("corrections")).cast("long").alias("corrections"))


def import_bars(raw: DataFrame, export_date: Column) -> DataFrame:
    """Delivered daily bars through every stage in one pass; nothing is lost, each row ends with its stage and reason."""
    typed = validated_bars(normalised(mapped(raw, "daily_bars"), "daily_bars"))
    none, readable = F.array().cast("array<string>"), F.size("errors") == 0
    kept = typed.withColumns({c: F.when(readable, F.col(c)).otherwise(none) for c in ("reasons", "flags")})
    return staged(cross_checked(kept, export_date))


def too_many_rejects(rows: DataFrame, most: float = 0.05) -> bool:
    """Whether the quarantine rate calls for stopping before anything is written."""
    r = rows.agg(F.avg((F.col("stage") != "dated").cast("double")).alias("rate")).first()
    return (r.rate or 0.0) > most


def write_import(rows: DataFrame, path: str) -> None:
    """Facts and quarantine as Parquet side by side."""
    rows.where("stage = 'dated'").drop("errors", "reasons", "reason", "stage").write.mode("append").parquet(f"{path}/facts")
    rows.where("stage <> 'dated'").select("stage", "reason", "raw").write.mode("append").partitionBy("stage").parquet(f"{path}/quarantine")


def knowledge_time(kind: str, rows: DataFrame, export_date: Column, estimate: bool = False) -> DataFrame:
    """Adds knowledge_time and knowledge_source; a fundamental without filing time stays undated unless estimates are asked for."""
    if kind == "market":
        when, source = F.coalesce("reported_at", "close_utc"), F.when(F.col("reported_at").isNotNull(), "reported").otherwise("vendor_ingest")
    elif kind == "fundamental":
        lag = F.when(F.col("fiscal_period") == "Q4", 90).otherwise(45)
        guess = F.date_add("period_end", lag).cast("timestamp") if estimate else F.lit(None).cast("timestamp")
        filed = F.when(F.to_date("reported_at") >= F.col("period_end"), F.col("reported_at"))
        when, source = F.coalesce(filed, guess), F.when(filed.isNotNull(), "reported").when(guess.isNotNull(), "estimated")
    else:
        when, source = export_date.cast("timestamp"), F.lit("vendor_ingest")
    return rows.withColumn("knowledge_time", when).withColumn("knowledge_source", source)


def fresh(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose revision key isn't stored yet, each key once (of several the one that sorts first): appending them twice adds nothing."""
    new = incoming.join(stored.select(*key), key, "left_anti")
    return new.groupBy(*key).agg(F.min(F.struct(*new.columns)).alias("x")).select("x.*")


def row_digest(columns: list[str]) -> Column:
    """Order-independent digest of a row's named cells."""
    return F.sha2(F.array_join(F.array(*(F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns))), "|"), 256)


GROUP_SYMBOLS, LONGEST_BEGINNING = 10_000, 12


def snapshot_id(rows: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """One digest of all rows, independent of their order; digests meet in buckets, never in one task."""
    d = rows.select(row_digest(columns).alias("d"))
    per = d.groupBy(F.substring("d", 1, 2).alias("b")).agg(F.sum(F.conv(F.substring("d", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s", "n"))), lambda x: F.concat_ws(":", x["b"], x["s"].cast("string"), x["n"])), ","), 256).alias("snapshot"), F.sum("n").alias("rows"))


def surrogate_ids(symbols: DataFrame, start: int = 1) -> DataFrame:
    """Stable ids from the sorted distinct symbols.

    Symbols are numbered within groups of one beginning and moved on by the sizes of the groups before; a group whose beginning
    is common is cut by longer ones, so only counts of at most ``GROUP_SYMBOLS`` symbols each meet in one place.
    """
    distinct = symbols.select("symbol").where("symbol is not null").distinct()
    begin = lambda n: F.substring("symbol", 1, n)
    group, n = begin(1), 1
    while n < LONGEST_BEGINNING:
        sizes = distinct.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= GROUP_SYMBOLS:
            break
        n += 1
        group = begin(n)
    keyed = distinct.withColumn("g", group)
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("g").orderBy("symbol"))
    return keyed.withColumn("own", own).join(offsets, "g").select("symbol", (F.col("own") + F.col("before") + start - 1).cast("int").alias("instrument_id"))


def vendor_prices(raw: DataFrame) -> dict[str, DataFrame]:
    """Vendor rows (symbol, payload json array) to bars, splits, dividends and rejects."""
    kind = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,split:double,cash:double>>"
    rows = raw.select("symbol", F.explode(F.from_json("payload", kind)).alias("x")).select("symbol", F.try_to_date(F.col("x.date"), "yyyy-MM-dd").alias("session_date"), "x.*").drop("date")
    named = [c for c in rows.columns if c not in ("symbol", "session_date")]
    good = rows.where("session_date is not null and close is not null").groupBy("symbol", "session_date").agg(F.min(F.struct(*named)).alias("x")).select("symbol", "session_date", "x.*")
    return {
        "bars": good.select("symbol", "session_date", "open", "high", "low", "close", "volume"),
        "splits": good.where("split is not null and split <> 1").select("symbol", F.col("session_date").alias("ex_date"), F.col("split").alias("ratio")),
        "dividends": good.where("cash > 0").select("symbol", F.col("session_date").alias("ex_date"), F.col("cash").alias("cash_amount")),
        "rejects": rows.where("session_date is null or close is null").select("symbol", F.when(F.col("session_date").isNull(), "bad_date").otherwise("no_close").alias("reason")),
    }


def missing_dependencies(present: DataFrame) -> DataFrame:
    """dataset and needs for each delivered dataset whose prerequisite isn't delivered."""
    spark = present.sparkSession
    rules = spark.createDataFrame([(d, n) for d, needs in REQUIRES.items() for n in needs], "dataset string, needs string")
    return rules.join(present.select("dataset"), "dataset").join(present.select(F.col("dataset").alias("needs")), "needs", "left_anti").select("dataset", "needs")
