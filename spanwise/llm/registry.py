"""The registered queries of the operators, and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import bpe, chat, contamination, credentials, language, licenses, ngram, oracles, pages, repair, search, simhash, tokens, trie
from spanwise.llm.common import shared_path

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = chat.read_back(chat.format_conversations(table.unionByName(probe)))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.train(docs.where(~out))
    found = language.identify(docs, model, ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ngram.score_texts(docs, ~language.held_out(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_VOCABULARY))
    return tokens.token_crc(tokens.read_tokens(spark, path))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.whole_numbers(_table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = credentials.secret_report(_table(spark, sf_dir, "documents"))
    base = credentials.base_spans(F.col("spans"))
    counts = [credentials.kind_count(base, n).alias(f"n_{kind[0]}")
              for n, kind in enumerate(credentials.KINDS[:credentials.BASE])]
    return report.select(
        "doc_id", *counts, F.sha2(credentials.span_text(base), 256).alias("base_sha256"),
        credentials.span_text(F.col("spans")).alias("spans"), "n_live", "n_copied", "n_sample")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.sequences(_table(spark, sf_dir, "conversations"))))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))

    def joined(*labels):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.col("base.label"), F.col("spans.label")).alias("labels"),
        F.col("best_share").alias("score"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_chat": op1_chat,
        "op2_language": op2_language,
        "op3_ngram": op3_ngram,
        "op4_decontamination": op4_decontamination,
        "op5_main_text": op5_main_text,
        "op6_tokens": op6_tokens,
        "op7_simhash": op7_simhash,
        "op8_top_k": op8_top_k,
        "op9_secrets": op9_secrets,
        "op10_bpe": op10_bpe,
        "op11_repair": op11_repair,
        "op12_trie": op12_trie,
        "op13_licenses": op13_licenses,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": oracles.CHAT,
        "op4_decontamination": oracles.CONTAMINATION,
        "op8_top_k": oracles.SEARCH,
        "op9_secrets": oracles.SECRETS,
        "op11_repair": oracles.REPAIR,
        "op12_trie": oracles.TRIE,
    }
