"""Ranked lexical search by Fagin's threshold algorithm over a document-partitioned index.

One pass over the whole texts writes a forward index: for each document its number of terms, and the terms of the
items that it holds with their counts. Each part of that index makes its own lists, sorted by impact, and searches
them: round-robin down the lists of an item's terms, a random access to the forward index for every document met
for the first time, and a stop when the threshold (the sum of the impacts last seen) falls strictly below the k-th
score. The part's best k move on; no posting and no document is ever shuffled, so no term is too frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialise
from tidewater.llm.wordhash import TERM_BYTES, Words, pieces_of
from tidewater.session import ship

#: Item terms that are searched in one pass; more items are searched in blocks. It bounds what a task is sent.
BLOCK_TERMS = 1_000_000
#: Postings of a part of the index; it bounds a task's memory whatever the size of its partition.
PART_POSTINGS = 4_000_000


def _terms_of_items(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1):
                words = Words(part.column(1), TERM_BYTES)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(words.text)), pa.array(words.hash.view(np.int64))], names=["item_id", "term"])

    slim = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = slim.schema["item_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"item_id {kind}, term long").distinct()


def _forward(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """A row for each document: doc_id, n (its terms, with repeats), and the places in ``terms`` that it holds, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1):
                words = Words(part.column(1), TERM_BYTES)
                at = np.searchsorted(terms, words.hash)
                at[at == len(terms)] = 0
                hit = terms[at] == words.hash if len(terms) else np.zeros(len(at), bool)
                pair, count = np.unique(words.text[hit] * np.int64(len(terms) or 1) + at[hit], return_counts=True)
                of = np.bincount(pair // (len(terms) or 1), minlength=part.num_rows)
                ends = pa.array(np.concatenate([[0], np.cumsum(of)]).astype(np.int32))
                held = pa.ListArray.from_arrays(ends, pa.array((pair % (len(terms) or 1)).astype(np.int32)))
                counts = pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.in_text.astype(np.int64)), held, counts], names=["doc_id", "n", "held", "counts"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, held array<int>, counts array<int>")


def _holders(index: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term: one sum a term from every task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for row in index.select("held").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


class Part:
    """A part of the index: lists sorted by impact, and the forward index for random access."""

    def __init__(self, doc_id: np.ndarray, no_id: np.ndarray, ends: np.ndarray, term: np.ndarray, share: np.ndarray, n_terms: int) -> None:
        """``share`` is what each posting adds to a score; postings of document i are ends[i] to ends[i + 1]."""
        self.doc_id, self.no_id, self.ends, self.term, self.share = doc_id, no_id, ends, term, share
        doc = np.repeat(np.arange(len(doc_id)), np.diff(ends))
        order = np.lexsort((-share, term))
        self.list_doc, self.list_share = doc[order], share[order]
        self.list_ends = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.seen = np.zeros(len(doc_id), bool)
        self.accesses = 0

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of some documents for the terms that are asked."""
        self.accesses += len(docs)
        size = self.ends[docs + 1] - self.ends[docs]
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.ends[docs] - begin, size)
        return np.add.reduceat(np.where(asked[self.term[at]], self.share[at], 0), begin)  # every document met has postings

    def search(self, terms: np.ndarray, asked: np.ndarray, k: int, best: tuple) -> tuple:
        """The best k of ``best`` and this part, as (score, no_id, doc_id): ever longer rounds over the lists of the terms."""
        at, end = self.list_ends[terms].copy(), self.list_ends[terms + 1]
        met, step = [], 8
        while True:
            live = at < end
            if not live.any():
                break
            if len(best[0]) >= k and self.list_share[at[live]].sum() < best[0][k - 1]:  # the threshold: no document below can reach it
                break
            stop = np.minimum(at + step, end)
            fresh = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(at, stop, strict=True)]))
            fresh = fresh[~self.seen[fresh]]
            if len(fresh):
                self.seen[fresh] = True
                met.append(fresh)
                score = self.scores(fresh, asked)
                good = score > 0
                best = top(np.concatenate([best[0], score[good]]), np.concatenate([best[1], self.no_id[fresh][good]]), np.concatenate([best[2], self.doc_id[fresh][good]]), k)
            at, step = stop, min(step * 2, 4096)
        for docs in met:
            self.seen[docs] = False
        return best


def top(score: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray, k: int) -> tuple:
    order = np.lexsort((doc_id, no_id, -score))[:k]
    return score[order], no_id[order], doc_id[order]


def _best_of_parts(index: DataFrame, wanted: list[np.ndarray], weight: np.ndarray, n_docs: int, n_all: int, k: int, part_postings: int) -> DataFrame:
    """(item, doc_id, score): the best k documents for each item of every task."""
    n_terms = len(weight)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        held: list[tuple] = []

        def made() -> Part:
            ids, blank, sizes, term, share = (np.concatenate(x) for x in zip(*held, strict=True))
            return Part(ids, blank, np.concatenate([[0], np.cumsum(sizes)]), term, share, n_terms)

        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                piece = batch.slice(begin, 1024)
                m = np.array([10 + 90 * n * n_docs // n_all for n in piece.column(1).to_pylist()], np.int64)  # the norm, 100 at mean length
                sizes = piece.column(2).value_lengths().to_numpy().astype(np.int64)
                term = piece.column(2).flatten().to_numpy()
                tf = piece.column(3).flatten().to_numpy().astype(np.int64)
                share = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
                ids = piece.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), sizes, term, share))
                if sum(len(x[3]) for x in held) >= part_postings:
                    yield made()
                    held = []
        if held:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        best = [nothing] * len(wanted)
        asked = np.zeros(n_terms, bool)
        for part in parts(batches):
            for i, terms in enumerate(wanted):
                asked[terms] = True
                best[i] = part.search(terms, asked, k, best[i])
                asked[terms] = False
        item = np.repeat(np.arange(len(wanted)), [len(b[0]) for b in best])
        score, blank, ids = (np.concatenate([b[j] for b in best]) if best else nothing[j] for j in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=blank), pa.array(score)], names=["item", "doc_id", "score"])

    return index.filter("n > 0").select("doc_id", "n", "held", "counts").mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, part_postings: int = PART_POSTINGS) -> DataFrame:
    """The ``k`` best documents for each item: item_id, rank, doc_id, score.

    Terms are runs of letters and digits of ASCII and of all other characters beyond ASCII, A-Z in lower case; they are
    compared by 64-bit hashes. Rows that share an item_id are one item with the terms of all of them, null being an
    item_id too; each row of ``docs`` is a document. Null and empty texts hold no term: such a document is in no result,
    such an item has no row. Equal scores go by ascending doc_id, nulls last. Empty tables give an empty result; other
    columns are ignored. A very long text takes some 40 times its bytes while it is cut into terms. The items are taken
    in blocks of about ``block_terms`` terms, a pass over the documents each.
    """
    spark = ship(docs.sparkSession)
    pairs = materialise(_terms_of_items(items), "items")
    blocks = max(1, -(-pairs.count() // block_terms))
    found, totals = [], None
    for b in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()
        if not len(mine):
            continue
        terms, place = np.unique(mine["term"].to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
        names, item = [], np.zeros(len(mine), np.int64)
        numbers: dict = {}
        for i, name in enumerate(mine["item_id"].astype(object).where(mine["item_id"].notna(), None)):
            item[i] = numbers.setdefault(name, len(numbers))
        names = list(numbers)
        order = np.argsort(item, kind="stable")
        wanted = np.split(place[order], np.cumsum(np.bincount(item))[:-1])
        index = materialise(_forward(docs, terms), "forward")
        if totals is None:
            row = index.filter("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
            totals = int(row["docs"]), int(row["all"])
        held = _holders(index, len(terms))
        weight = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * int(x) + 1))) for x in held], np.int64)
        kind = pairs.schema["item_id"].dataType.simpleString()
        named = spark.createDataFrame([(i, None if n is None else (n if kind == "string" else int(n))) for i, n in enumerate(names)], f"item long, item_id {kind}")
        best = _best_of_parts(index, wanted, weight, *totals, k, part_postings)
        found.append(best.join(F.broadcast(named), "item").drop("item"))  # a block's items, no more than block_terms
    if not found:
        kind = pairs.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB; terms of every text, then sums of the same integers.
ORACLE = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
tf AS (SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY doc_id, t),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
