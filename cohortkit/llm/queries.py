"""The numbered queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortkit.llm import (align, bpe, chat, jaccard, langid, mih, mixing, packing, paragraphs, repair, suffixes,
                           urls, vectors)
from cohortkit.session import tune

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
PROBE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Arrow batches hold whole texts; a batch of a few hundred keeps a Python worker small
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.range(1).select(F.explode(F.array(
        *[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                   F.lit(role).alias("role"), F.lit(PROBE).alias("text"))
          for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = chat.format_chat(turns).withColumn("read", chat.parse_chat(F.col("formatted")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return made.withColumn("loss", loss).select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit_languages(docs, ~held_out())
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"), RULES)


def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"), 0.95)


def op6_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return mih.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op7_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_sets(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = paragraphs.drop_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_paragraphs", "n_removed", "words_removed",
                      F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op10_best_fit_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_texts(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode_ids(encoded, path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    made = repair.repair(repair.damage(table(spark, folder, "conversations")), F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    return made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       F.sha2(lines, 256).alias("repaired_sha256"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.alignment_scores(table(spark, folder, "documents"), tokenizer_path(),
                                  tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_source_mix, op3_language_id, op4_url_filter,
                                   op5_vector_dedup, op6_multi_index, op7_suffix_array, op8_ngram_jaccard,
                                   op9_paragraph_dedup, op10_best_fit_pack, op11_byte_bpe,
                                   op12_conversation_repair, op13_token_alignment)}
