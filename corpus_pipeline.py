"""A corpus pipeline of five stages; each reads what the one before it wrote.

Null and empty texts fail the base rule of the first stage; a later stage that meets some all the same counts them as
empty, so that one of them stays. Null doc_ids come last where ids decide, null sources count as "". Of rows that
repeat in doc_id and text one stays. Empty tables stay empty. Columns of any name go through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bagminhash, exact_dedup, mixing, pieces, quality
from tidewater.llm.common import documents, materialise, rows_kept
from tidewater.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list accept."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, rules)
    return quality.only(judged, F.col("kept")).select("_in.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return rows_kept(docs, bagminhash.near_duplicates(docs).filter("kept").select("doc_id", "text_hash"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are interleaved."""
    return mixing.in_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding, and its place in the mix.

    doc_id, n_tokens, ids_sha256, decoded_sha256, ids, slot, place: a reader that wants the mix sorts by the last two,
    which follow from the rows alone and are those of the stage before.
    """
    placed = mixing.scheduled(docs.select("doc_id", "text", "source")).select("_in.*", "slot", "place")
    done = pieces.encode_pieces(placed, tokenizer_path("piece_bpe_32k.model"), columns=("slot", "place"))
    return pieces.piece_digests(done, "ids", "slot", "place")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can state neither the learned rules nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
