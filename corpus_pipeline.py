"""A corpus from raw documents to packed batches, stage by stage.

Toxic documents go, exact copies go, one document of each near-duplicate group stays, secrets are blanked out
of what is left, and the rest is dealt into length buckets and token-budget batches.

Every stage takes any table with doc_id and text.  Columns beside these are carried through unchanged, whatever
their names or nulls; only the last stage replaces columns with the names of its own outputs.  Null and empty
texts are clean, equal to each other, linked to nothing and of length 0.  Very long texts are read whole.  An
empty table gives an empty table.  Repeated rows and tied ids: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import exact_dedup, ngram_join, packing, secret_scan, toxicity
from vantage.llm.base import stored, table


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with names for the further columns that no operator uses."""
    return docs.withColumnsRenamed({c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return out.select(*(F.col(now).alias(c) for now, c in zip(_aside(docs).columns, docs.columns, strict=True)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar predicts to be toxic go; each of repeated rows is judged by its text alone."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_aside(docs), model).where("predicted = 0"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; where rows repeat that id too, the one that sorts first."""
    return _back(exact_dedup.survivors(_aside(docs)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays, with all its texts; rows without an id stay."""
    found = ngram_join.ngram_components(docs.select("doc_id", "text"))
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span found becomes ``[SECRET]``; n_chars, where it is a column, follows a changed text."""
    found = secret_scan.secret_scan(_aside(docs))
    clean = F.when(F.size("spans") > 0, secret_scan.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        size = f"carried_{docs.columns.index('n_chars')}"
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(size, F.when(F.size("spans") > 0, length).otherwise(F.col(size)))
    return _back(out, docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its length in tokens, bucket, batch and slot; repeated rows each take a slot."""
    import public_tokenizers

    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", blank_secrets),
    ("packing", pack_batches),
]
#: The stages' models, components and dynamic programming are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
