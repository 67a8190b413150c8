"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from strandloom.llm import chat, interaction, markup, mixing, near, packing, pii, quality, secret, toxicity, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), special=True)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret.digest(secret.find_spans(_table(spark, sf_dir, "documents")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(_table(spark, sf_dir, "documents"), near.Near(words=3, percent=85))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), F.expr("array_join(transform(spans, s -> concat_ws(':', s.start, s.end)), ',')").alias("spans"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.main_text(_table(spark, sf_dir, "pages"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit drill: all pages as archives, against a replica with known faults."""
    pages = _table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged(pages))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(_table(spark, sf_dir, "documents")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(_table(spark, sf_dir, "embeddings"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are the marks of a template."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.format_conversations(turns.unionByName(odd)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_secret_scan": op3_secret_scan,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_html_main_text": op6_html_main_text,
        "op7_warc_fixity": op7_warc_fixity,
        "op8_personal_data": op8_personal_data,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_mix_sources": op10_mix_sources,
        "op11_filter_interaction": op11_filter_interaction,
        "op12_chat_format": op12_chat_format,
    }
