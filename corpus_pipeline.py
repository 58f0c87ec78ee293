"""From raw documents to token ids in five stages, each one written as Parquet and read again by the next.

Defined results of the stages
- an empty table gives an empty table with the same columns (the last one: its own)
- null or empty texts are of no language and go in the first stage; given to a later one they stay as they are
- null ids and nulls in other columns do no harm; rows alike in id and text are one document for near_dedup, which keeps one of them
- ties: of equal or near texts the one with the least id stays, of one id's the one with the least hash
- columns named like those used inside stay as they are; columns that only some tables have (n_chars) may be missing
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismill.llm import bpe, decontam, langid, minhash, queries, secret_scan
from prismill.llm.store import Scratch

#: Near-duplicates: shingles of so many words, and this similarity in percent at least.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an undetermined language (no text, no letters) go; a missing label is filled in."""
    label = bpe.fresh(docs, "lang_pred")
    found = langid.identify(docs, langid.fit(docs), to=label, score=bpe.fresh(docs, "lang_score")).where(F.col(label) != "und")
    return found.withColumn("lang", F.coalesce("lang", label)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id. Texts that share an id are compared like others; a null id stays."""
    key, copy = bpe.fresh(docs, "key"), bpe.fresh(docs, "copy")
    d = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("sign")))
    kept = minhash.near_duplicates(d.where("doc_id IS NOT NULL"), key=key, shingle=SHINGLE, percent=PERCENT).where("kept").select(key)
    one = Window.partitionBy(key).orderBy(F.col("doc_id"))
    named = d.join(kept, key, "left_semi").withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1)
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    key = bpe.fresh(docs, "key")
    d = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")))
    found = decontam.contamination(d, queries.load(spark, sf_dir, "benchmark"), key=key).where(decontam.contaminated())
    return d.join(found.select(key).distinct(), key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    clean = secret_scan.redacted(docs, **secret_scan.learned(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    spec = bpe.read_spec(queries.tokenizer_path())
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), spec, ids="ids", keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Language labels and the forest have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = queries.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
