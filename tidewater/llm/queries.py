"""Queries opN_<name> over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bagminhash, changes, chat, line_dedup, lm, mixing, pieces, pii, quality, ranked, suffixes, token_files
from tidewater.llm import exact_dedup as dedup
from tidewater.llm.common import documents

try:
    from public_tokenizers import path as tokenizer_path
except ModuleNotFoundError:  # the vocabulary files are a parameter; only these queries need them

    def tokenizer_path(name: str) -> str:
        return f"/opt/tokenizers/{name}"


#: The key of the pseudonyms in the query; a deployment passes its own.
QUERY_KEY = "tidewater-query-key"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.turns_of_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.chat_digests(chat.format_turns(turns.unionByName(chat.probe(spark))))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(pieces.encode_pieces(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model")))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), QUERY_KEY)


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_of(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_change_applier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_changes(spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_bagminhash": op6_bagminhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing": op9_mixing,
    "op10_token_files": op10_token_files,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_change_applier": op12_change_applier,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op2_chat_format": chat.ORACLE, "op3_exact_dedup": dedup.ORACLE, "op13_ranked_search": ranked.ORACLE}
