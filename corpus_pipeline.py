"""The corpus pipeline: language, near-duplicate documents, repeated passages, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortkit.llm import jaccard, langid, mixing, packing, paragraphs
from cohortkit.llm.queries import held_out, table, tokenizer_path
from cohortkit.session import checkpoint

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Five-word shingles and a similarity of 0.8.
SHINGLE, NUM, DEN = 5, 4, 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; a text without letters goes.

    Learned from the labelled rows of the stage's own input."""
    found = langid.identify(docs, langid.fit_languages(docs, ~held_out()))
    return found.filter("NOT rejected").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id; copies of a row are one."""
    found = jaccard.near_sets(docs.select("doc_id", "text"), SHINGLE, NUM, DEN)
    keys = found.filter("kept").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    k1, k2 = jaccard.row_key("doc_id", "text")
    rows = docs.select(*docs.columns, k1.alias("_k1"), k2.alias("_k2"))
    return rows.join(keys, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from the texts; a document of which nothing is left goes."""
    cut = paragraphs.drop_repeats(docs)
    cut = cut.filter("n_removed = 0 OR text RLIKE '[^\\\\s]'")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as often as the mix takes it."""
    taken = mixing.mix(docs).filter("copies > 0")
    return taken.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", known_language), ("ngram_jaccard", one_of_each), ("paragraph_dedup", without_repeats),
          ("source_mix", mixed), ("best_fit_pack", packed)]

# The stages use a trained classifier, hashes and a tokenizer: not to be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
