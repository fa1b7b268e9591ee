"""From documents to training sequences: language ID, near-duplicates, repeats, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), with docs in the columns of documents, and returns a DataFrame; all but the
last return the columns of documents again.  Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import blocks, decontam, langid, packing, repeats, similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told, null texts and those without a letter; names the language of
    the others where lang is null.  Without a labelled text there is no model: lang then stays as it is."""
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(langid.lettered("text")).select(COLUMNS)
    known = langid.identify(docs, model, keep=COLUMNS).where(F.col("lang_pred") != langid.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least doc_id, of each group that five-word-shingle similarities of 0.8 or more link."""
    return similar.one_of_each(docs.select(COLUMNS), similar.similar_groups(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has too; documents that lose no word are unchanged."""
    cut = repeats.substring_dedup(docs, keep=COLUMNS)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return cut.where("n_words = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more, and cuts the windows of others.

    What a cut brings together is looked at again, until no window is left.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = blocks.stored(decontam.decontaminate(docs, benchmark, keep=COLUMNS, masks=True).where("not contaminated"))
    clean = found.where("hit is null").select(COLUMNS)
    while not (hit := found.where("hit is not null").select(*COLUMNS, "hit")).isEmpty():
        cut = decontam.without_hits(hit).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)
        found = blocks.stored(decontam.decontaminate(blocks.stored(cut), benchmark, keep=COLUMNS, masks=True))
        clean = clean.union(found.where("hit is null").select(COLUMNS))
    return clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, packing.tokenizer_file(), packing.PRODUCTION)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = blocks.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
