"""Exact dedup by a tree-merge of sorted digest runs; DataFrame functions only.

Every input partition becomes one run: its rows as digest entries, sorted by digest. Runs are merged up a
binomial tree. A round takes several steps of the tree at once: the runs whose numbers differ in their last
bits only move to the least of them and are merged there, keeping one verified entry (the row that stays, and
the count) per digest. Copies within a partition are merged before anything moves. The root stays spread over
the cluster by digest. The winners travel back down the same tree, so no task ever meets more entries of a
digest than a merge has runs, however many copies a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import BLANK, materialise, rows_kept, text_of


def normalised(text: Column) -> Column:
    """The text without blanks: the identity under which two texts are equal."""
    return F.regexp_replace(text, BLANK + "+", "")


def exact_dedup(docs: DataFrame, fan_in_bits: int = 4, rounds: int = 1) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (see ``groups``)."""
    return groups(docs, fan_in_bits, rounds).drop("text_hash")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat exactly one."""
    return rows_kept(docs, materialise(groups(docs).filter("kept").select("doc_id", "text_hash"), "kept"))


def groups(docs: DataFrame, fan_in_bits: int = 4, rounds: int = 1) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when they match after deleting every blank character; null text counts as empty, so
    all empty, blank and null texts form one group. Of a group the row with the most code points in its
    original text stays, then the smallest doc_id (null doc_ids last), then the first row read. Rows that
    repeat exactly are counted apart and only one of them is kept. An entry is verified by a second hash
    and the length beside the SHA-256; entries that disagree in either never merge. An empty table gives
    an empty result; other columns of the input are ignored. A round merges 2**fan_in_bits runs; there
    are ``rounds`` of them, or as many more as it takes to leave one run.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    entries = source.select(
        "doc_id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"), F.xxhash64("text").alias("text_hash")
    ).select(
        "doc_id",
        "n_chars",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.struct(F.xxhash64("norm").alias("h"), F.length("norm").alias("n")).alias("proof"),
        "text_hash",
    )
    numbered = entries.select("*", F.monotonically_increasing_id().alias("row_id"), F.spark_partition_id().alias("run"))
    rows = materialise(numbered.sortWithinPartitions("digest"), "runs")
    last = rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    rounds = max(rounds, -(-int(last).bit_length() // fan_in_bits))
    rank = F.struct(
        (-F.col("n_chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"
    )
    key = ["digest", "proof"]
    levels = [
        rows.select("run", *key, rank.alias("best"))
        .groupBy("run", *key)
        .agg(F.min("best").alias("best"), F.count("*").alias("group_size"))
    ]
    for _ in range(rounds):  # a merge needs its runs sorted: Spark sorts each partition by (run, digest), then merges
        levels.append(
            levels[-1]
            .withColumn("run", F.shiftright("run", fan_in_bits))
            .groupBy("run", *key)
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
    # Down the tree: only digests with copies need to hear who stays.
    won = levels[-1].filter("group_size > 1").select("run", *key, "best", "group_size")
    for level in reversed(levels[:-1]):
        child = level.select("run", *key, F.shiftright("run", fan_in_bits).alias("parent"))
        won = child.join(won.withColumnRenamed("run", "parent"), ["parent", *key]).select(
            "run", *key, "best", "group_size"
        )
    joined = rows.join(won, ["run", *key], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


#: DuckDB; the row that stays is the first by code points, then doc_id.
ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
