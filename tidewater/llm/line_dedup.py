"""Line dedup by an exact set-similarity join: prefix, positional, length and parity filters, verified.

A line is the set of its words. Lines with the same set are one class from the start. Words are put in
one order for the whole corpus, rare before frequent, so two sets of Jaccard similarity t or more share a
word among their first n - ceil(t * n) + 1 words. Classes meet on those words only; pairs that fail the
length, positional or parity bound fall out inside the join; the rest are verified word by word, the
likeliest of each class first. A line goes if an earlier line of the corpus, in the order of doc_id and
place, is similar to it, so a class needs no more partners once one is found.

Words of at most 1,024 lines have short lists: there all pairs meet. On more frequent words a class first meets
eight early classes of the rarest and the most frequent of them, which settles groups of copies; only classes that are still open then meet all
earlier ones of their frequent words. Nothing is lost, and groups of copies aren't paired off.

Frequencies live in a table of fixed size (2**24 cells of one byte, 16 MB at any scale): a word's cell
says how often the words of the cell occur, in steps. Any such order is right; only speed depends on it.
A cell that was hit once holds a word of one line, which can't meet another and isn't sent at all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import discard, materialise
from tidewater.llm.wordhash import Words, mix
from tidewater.session import ship

SIMILARITY = 0.8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
CELL_BITS, PAGE_BITS = 24, 16
#: Lines that have a word of this step or less are at most 1,024.
FEW = 41
#: Earlier classes of a frequent word that every class meets at first.
CENTRES = 8
#: Places of lines that are sent to every task, at most (of some 40 bytes each); more are joined by a shuffle.
MOST_SENT = 500_000
_LOW55 = np.uint64((1 << 55) - 1)


def word_lines(text: str) -> Iterator[tuple[int, list[bytes]]]:
    """(place, words) of every line that has a word; A-Z in lower case."""
    for i, line in enumerate(text.encode().lower().split(b"\n")):
        words = line.split()
        if words:
            yield i, words


def least_overlap(n: int, m: int, t: float = SIMILARITY) -> int:
    return math.ceil(t * (n + m) / (1 + t) - 1e-9)


def prefix_length(n: int, t: float = SIMILARITY) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1 and then quarter powers of two, in a byte."""
    out = np.zeros(len(counts), np.uint8)
    hit = counts > 0
    out[hit] = np.minimum(255, 1 + np.ceil(4 * np.log2(counts[hit]))).astype(np.uint8)
    return out


def frequency_cells(docs: DataFrame) -> bytes:
    """Steps of the frequency of every cell, over all words of all documents."""
    size = 1 << PAGE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells, held = np.zeros(1 << CELL_BITS, np.uint32), [np.zeros(0, np.uint32)]

        def pour() -> None:
            kinds, n = np.unique(np.concatenate(held), return_counts=True)  # sorted, so that the cells are met in order
            cells[kinds] += n.astype(np.uint32)
            held[:] = [kinds[:0]]

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                held.append((Words(batch.column(0).slice(begin, 256)).hash >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
                if sum(map(len, held)) > 4_000_000:
                    pour()
        pour()
        hit = np.flatnonzero(cells)
        ends = np.searchsorted(hit, np.arange(0, (1 << CELL_BITS) + 1, size))
        task = TaskContext.get().partitionId()
        for page in np.flatnonzero(np.diff(ends)).tolist():
            at = hit[ends[page] : ends[page + 1]]
            yield _page(page, task, (at - page * size).astype("<u2").tobytes() + cells[at].astype("<u4").tobytes())

    def summed(table: pa.Table) -> np.ndarray:
        out = np.zeros(size, np.uint64)
        for packed in table.column("cells").to_pylist():
            at = np.frombuffer(packed, "<u2", len(packed) // 6)
            out[at] += np.frombuffer(packed, "<u4", offset=2 * len(at))
        return np.minimum(out, 2**32 - 1).astype("<u4")

    def some(key: tuple, table: pa.Table) -> pa.Table:
        out = summed(table)
        at = np.flatnonzero(out)
        return pa.Table.from_batches([_page(key[0].as_py(), 0, at.astype("<u2").tobytes() + out[at].tobytes())])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_page(key[0].as_py(), 0, zlib.compress(_steps(summed(table)).tobytes(), 1))])

    schema = "page int, task int, cells binary"
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(count, schema)
    # Two steps, so that no group holds a page of every task: 256 of them, of 384 KB at most, at first.
    part = rows.groupBy("page", F.shiftright("task", 8).alias("part")).applyInArrow(some, schema)
    out = bytearray(1 << CELL_BITS)
    for r in part.groupBy("page").applyInArrow(total, schema).collect():  # 256 packed rows of 64 KB at most
        out[r["page"] << PAGE_BITS : (r["page"] + 1) << PAGE_BITS] = zlib.decompress(r["cells"])
    return bytes(out)


def _page(page: int, task: int, cells: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([task], pa.int32()), pa.array([cells], pa.binary())], names=["page", "task", "cells"])


_LINES = "doc_id long, text_hash long, row_id long, place int, n int, s1 long, s2 long, p0 long, p1 long, words array<long>"


def _lines(docs: DataFrame, cells, t: float) -> DataFrame:
    """For every row of ``docs`` one row with place -1 and n lines; for each line its place, set and prefix.

    s1 and s2 name the set of n words, p0 and p1 are its 128 parity cells; words has those of the prefix that some
    other line may have: 32 bits of the hash, a bit that says whether more than 1,024 lines may have it, and the
    place in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.frombuffer(cells.value, np.uint8)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                words = Words(part.column(3))
                new = np.ones(len(words.hash), bool)
                new[1:] = (words.text[1:] != words.text[:-1]) | (words.line[1:] != words.line[:-1])
                at = np.flatnonzero(new)
                step = steps[(words.hash >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
                keys = (step << np.uint64(55) | words.hash & _LOW55).view(np.int64)  # rare words first
                yield _packed(part, words.text[at], words.line[at], *_sets(np.cumsum(new) - 1, keys, len(at), t))

    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = slim.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _LINES)


def _sets(line: np.ndarray, keys: np.ndarray, lines: int, t: float) -> tuple:
    """n, s1, s2, p0, p1 of each line, the number of its words that are sent, and these, from the keys of its words."""
    order = np.argsort(keys)
    order = order[np.argsort(line[order].astype(np.uint16 if lines < 65536 else np.int64), kind="stable")]  # 16 bits take a radix sort
    keys, line = keys[order], line[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
    keys, line = keys[new], line[new]
    n = np.bincount(line, minlength=lines)
    if not lines:
        none = np.zeros(0, np.int64)
        return n, none, none, none, none, none, none
    start = np.cumsum(n) - n
    at, step, mixed = np.arange(len(keys)) - start[line], keys >> 55, mix(keys.view(np.uint64))
    # A set is named by sums of two mixes of its words: any order gives the same name.
    s1, s2 = np.add.reduceat(mixed, start), np.add.reduceat(mix(mixed + _GOLD), start)
    bit, high = np.uint64(1) << (mixed & np.uint64(63)), (mixed & np.uint64(64)) > 0
    p0, p1 = (np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), start) for side in (~high, high))
    prefix = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
    # Under t / (1 - t) words one word more or less is too much: no other set can be similar.
    sent = (at < prefix[line]) & (step > 1) & (n[line] >= t / (1 - t) - 1e-9)
    packed = (keys << 32) | (step > FEW).astype(np.int64) << 31 | at
    return n, *(x.view(np.int64) for x in (s1, s2, p0, p1)), np.bincount(line[sent], minlength=lines), packed[sent]


def _packed(part: pa.RecordBatch, owner, place, n, s1, s2, p0, p1, sizes, words) -> pa.RecordBatch:
    heads = part.num_rows
    own = pa.array(np.concatenate([np.arange(heads), owner]))
    zero = np.zeros(heads, np.int64)
    both = lambda head, rest, kind: pa.array(np.concatenate([head, rest]).astype(kind))

    ends = pa.array(np.concatenate([[0], zero, np.cumsum(sizes)]).astype(np.int32))
    columns = [
        *(part.column(i).take(own) for i in range(3)), both(zero - 1, place, np.int32), both(np.bincount(owner, minlength=heads), n, np.int32),
        *(both(zero, x, np.int64) for x in (s1, s2, p0, p1)), pa.ListArray.from_arrays(ends, pa.array(words)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _LINES.split(", ")])


def _postings(classes: DataFrame) -> DataFrame:
    """(cid, n, p0, p1, word), a row for each word of the prefix; its low half has its mark and place."""
    return classes.filter(F.size("words") > 0).select("cid", "n", "p0", "p1", F.explode("words").alias("word"))


def _many() -> Column:
    return F.col("word").bitwiseAND(F.lit(1 << 31)) != 0


def _word(c: str) -> Column:
    return F.shiftright(F.col(c), 32)


def _possible(t: float) -> Column:
    """The length, parity and positional bounds of two postings a and b of one word."""
    n, m, i, j = F.col("a.n"), F.col("b.n"), _place("a.word"), _place("b.word")
    need = F.lit(t / (1 + t)) * (n + m) - F.lit(1e-9)  # of words that both have
    return (F.least(n, m) >= F.lit(t) * F.greatest(n, m) - 1e-9) & (_apart() <= n + m - need - need) & (F.least(n - i, m - j) + F.least(i, j) >= need)


def _place(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(0x7FFFFFFF))


def _short(n: str, t: float) -> Column:
    """The smaller of two similar sets has a shared word among so many of its first already."""
    return F.col(n) - F.ceil(F.lit(2 * t / (1 + t)) * F.col(n) - 1e-9) + 1


def _apart() -> Column:
    return sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in ("p0", "p1")), F.lit(0))


def _all_pairs(posts: DataFrame, t: float) -> DataFrame:
    """(c, d, apart): pairs of classes that share a word and pass the bounds, d being the earlier one.

    So the smaller set sends no more than its short prefix.
    """
    n, m = F.col("a.n"), F.col("b.n")
    a, b = posts.alias("a"), posts.filter(_place("word") < _short("n", t)).alias("b")
    smaller = (m < n) | ((m == n) & (F.col("b.cid") < F.col("a.cid")))
    met = a.join(b, (_word("a.word") == _word("b.word")) & smaller & _possible(t))
    return met.select(F.greatest("a.cid", "b.cid").alias("c"), F.least("a.cid", "b.cid").alias("d"), _apart().alias("apart"))


def _meet(ours: DataFrame, others: DataFrame, t: float, all_words: bool) -> DataFrame:
    """(c, d, apart): classes of ours and earlier ones of the others that share a word and pass the bounds.

    With all words of both, those of the short prefix of the smaller one do.
    """
    short = F.when(F.col("b.n") <= F.col("a.n"), _place("b.word") < _short("b.n", t)).otherwise(_place("a.word") < _short("a.n", t))
    met = ours.alias("a").join(others.alias("b"), (_word("a.word") == _word("b.word")) & (F.col("b.cid") < F.col("a.cid")) & (short if all_words else F.lit(True)) & _possible(t))
    return met.select(F.col("a.cid").alias("c"), F.col("b.cid").alias("d"), _apart().alias("apart"))


def _centres(posts: DataFrame) -> DataFrame:
    """Of each word the postings of the earliest class in each of ``CENTRES`` parts of its classes."""
    part = F.pmod(F.xxhash64("cid"), F.lit(CENTRES))
    first = posts.groupBy(_word("word").alias("w"), part.alias("p")).agg(F.min("cid").alias("least"))
    return posts.join(first.select("w", "least"), (_word("word") == F.col("w")) & (F.col("cid") == F.col("least")), "left_semi")


def _ends(posts: DataFrame) -> DataFrame:
    """Of each class the postings of the rarest and of the most frequent of its frequent words."""
    row = F.struct(_place("word").alias("place"), "n", "p0", "p1", "word")
    ends = posts.groupBy("cid").agg(F.array_distinct(F.array(F.min(row), F.max(row))).alias("r"))
    return ends.select("cid", F.inline("r")).select(*posts.columns)


def _shadowed(spark: SparkSession, docs: DataFrame, classes: DataFrame, heads: DataFrame, t: float) -> DataFrame:
    """cid of every class that is similar to an earlier one: the likeliest is tried first, then all others."""
    posts = _postings(classes)
    few, many = posts.filter(~_many()), materialise(posts.filter(_many()), "many")
    once = lambda met: met.groupBy("c", "d").agg(F.min("apart").alias("apart"))
    pairs = materialise(once(_all_pairs(few, t).unionByName(_meet(_ends(many), _centres(many), t, False))), "pairs")
    best = pairs.groupBy("c").agg(F.min(F.struct("apart", "d")).alias("b")).select("c", F.col("b.d").alias("d"))
    found = materialise(_similar(spark, docs, classes, heads, best, t), "found")
    left = many.join(found, "cid", "left_anti").select(*many.columns)
    rest = pairs.select("c", "d").join(found.select(F.col("cid").alias("c")), "c", "left_anti")
    rest = rest.unionByName(_meet(left, many, t, True).select("c", "d")).distinct().join(best, ["c", "d"], "left_anti")
    out = found.unionByName(materialise(_similar(spark, docs, classes, heads, rest, t), "found"))
    discard(pairs, many)
    return out


def _similar(spark: SparkSession, docs: DataFrame, classes: DataFrame, heads: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """cid of the classes c of pairs (c, d) that are similar, word by word, in the lines where they come first."""
    pairs = materialise(pairs, "tried")
    needed = pairs.select(F.col("c").alias("cid")).unionByName(pairs.select(F.col("d").alias("cid"))).distinct()
    at = classes.select("cid", F.col("first.row_id").alias("row_id"), F.col("first.place").alias("place")).join(needed, "cid")
    rows = at.groupBy("row_id").agg(F.collect_list(F.struct("cid", "place")).alias("refs"))  # of one text, at most its lines
    refs = materialise(rows.join(heads.select("row_id", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")), "row_id").select("_d", "_h", "refs"), "refs")
    n = refs.agg(F.coalesce(F.sum(F.size("refs")), F.lit(0))).first()[0]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = slim.join(F.broadcast(refs) if n <= MOST_SENT else refs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")))
    lines = joined.select("refs", F.split("text", "\n", -1).alias("lines"))
    picked = lines.select(F.inline(F.transform("refs", lambda r: F.struct(r["cid"].alias("cid"), F.get(F.col("lines"), r["place"]).alias("line")))))
    texts = materialise(picked.groupBy("cid").agg(F.min("line").alias("line")), "texts")  # of repeated rows one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for c, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = set(x.encode().lower().split()), set(y.encode().lower().split())
                both = len(a & b)
                if both >= t * (len(a) + len(b) - both) - 1e-9:
                    good.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], names=["cid"])

    one = texts.select(F.col("cid").alias("c"), F.col("line").alias("x"))
    two = texts.select(F.col("cid").alias("d"), F.col("line").alias("y"))
    return pairs.join(two, "d").join(one, "c").select("c", "x", "y").mapInArrow(run, "cid long").distinct()


def removed_lines(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, text_hash, row_id, n_lines, removed (places of the lines that go, in order).

    Lines are split at \\n; a line without a word is never removed and isn't counted. Null text counts as
    empty. Order in the corpus: doc_id (null last), then a hash of the text where ids repeat, then the row as
    read, then place; so of repeated rows the first stays and the lines of the others go. An empty table
    gives an empty result; columns but doc_id and text are ignored.
    """
    spark = ship(docs.sparkSession)
    cells = spark.sparkContext.broadcast(frequency_cells(docs))  # 16 MB at any scale
    table = materialise(_lines(docs, cells, t), "lines")
    heads, lines = table.filter("place < 0"), table.filter("place >= 0")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_id", "place")
    firsts = [F.first(c).alias(c) for c in ("n", "p0", "p1", "words")]  # the same for all lines of a set
    grouped = lines.groupBy("s1", "s2").agg(F.min(order).alias("first"), F.count("*").alias("copies"), *firsts)
    # Sorted, the number of a class tells whether it comes earlier.
    classes = materialise(grouped.orderBy("first").withColumn("cid", F.monotonically_increasing_id()), "classes")
    heads, lines = (materialise(x, "lines") for x in (heads.select("doc_id", "text_hash", "row_id", "n"), lines.select("row_id", "place", "s1", "s2")))
    discard(table)
    shadowed = _shadowed(spark, docs, classes, heads, t)
    told = classes.join(shadowed.withColumn("shadowed", F.lit(True)), "cid", "left").select(
        "s1", "s2", F.coalesce("shadowed", F.lit(False)).alias("shadowed"), "copies", F.col("first.row_id").alias("row"), F.col("first.place").alias("at")
    ).filter("shadowed OR copies > 1")
    gone = lines.join(told, ["s1", "s2"]).filter("shadowed OR row_id != row OR place != at")
    by_row = gone.groupBy("row_id").agg(F.sort_array(F.collect_list("place")).alias("removed"))
    return heads.select("doc_id", "text_hash", "row_id", F.col("n").alias("n_lines")).join(by_row, "row_id", "left").select(
        "doc_id", "text_hash", "row_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )


def _same_row(spread: DataFrame, by: Column) -> DataFrame:
    """A number for each of the rows that have the same doc_id and text; such rows are alike to this operator."""
    return spread.withColumn("_nth", F.row_number().over(Window.partitionBy("_d", "_h").orderBy(by)))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; the other lines and columns stay."""
    told = _same_row(
        removed.filter("n_lines > 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "row_id", F.col("removed").alias("_gone")), F.col("row_id")
    ).drop("row_id")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_in"), docs["doc_id"].cast("long").alias("_d"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    has = F.col("_text").rlike("[^\\x20\\x09-\\x0D]")
    some = _same_row(held.filter(has).withColumn("_h", F.xxhash64("_text")), F.xxhash64(F.to_json("_in"))).alias("x")
    joined = some.join(told.alias("y"), F.col("x._d").eqNullSafe(F.col("y._d")) & (F.col("x._h") == F.col("y._h")) & (F.col("x._nth") == F.col("y._nth")), "left")
    left = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False))), "\n")
    done = joined.select("_in", F.when(F.size("_gone") > 0, left).otherwise(F.col("_text")).alias("_new"))
    done = done.unionByName(held.filter(~has).select("_in", F.col("_in")["text"].alias("_new")))
    return done.select(*[F.col("_new").alias("text") if c == "text" else F.col("_in")[c].alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed; documents without a line have 0 and none."""
    found = removed_lines(docs, t)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")
