"""Near-duplicates by BagMinHash over bags of five-word shingles, banding and exact verification.

Signature: every shingle with count c runs Poisson processes over the discretised weights (0, 1], (1, 2],
(2, 4], (4, 8], ...; a point has a time, a weight level and a register, all from hashes of the shingle,
and counts if its level is at most c. A register keeps its earliest time. Two bags agree in a register
with the probability of their weighted Jaccard similarity, sum of minima over sum of maxima. Points are
made in order of time and only until every register has one, so the work is that of the registers.

Candidates: documents whose registers agree in a band. In each bucket every member is checked against its
centre, the member that shares most; connected components of the links found are formed, and members that a
bucket still holds in different components are then checked against each other, so that no link is lost;
two of them meet in the first band that they share, not in all.
Sizes and 1,024 parity cells bound how far two bags are alike; pairs beyond the bound fall out inside the
joins, before any text is fetched, and no similar pair is beyond it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialise
from tidewater.llm.components import components
from tidewater.llm.wordhash import Words
from tidewater.llm.wordhash import mix as _mix
from tidewater.session import ship

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5

_U = np.uint64
_POSITIONS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_POINT, _LEVEL, _BAND = _U(0x9FB21C651E98DF25), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * (1.0 / 9007199254740992.0)


def words_in(text: str) -> list[bytes]:
    """Runs of non-blank characters, A-Z in lower case."""
    return text.encode().lower().split()


def shingle_hashes(w: np.ndarray) -> np.ndarray:
    """One hash per window of five words, given by their hashes; a shorter text is one window."""
    if len(w) < SHINGLE:
        return _mix((w * _POSITIONS[: len(w)]).sum(dtype=_U, keepdims=True) + np.array([len(w)], _U)) if len(w) else w
    n = len(w) - SHINGLE + 1
    h = w[:n] * _POSITIONS[0]
    for k in range(1, SHINGLE):
        h = h + w[k : k + n] * _POSITIONS[k]
    return _mix(h)


def _blocks(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """seed, first weight, width and count of every discretised weight interval that a shingle reaches."""
    seeds, starts, widths, caps = [_mix(shingles)], [np.zeros(len(shingles))], [np.ones(len(shingles))], [counts]
    level, start, width = 1, 1.0, 1.0
    rest = counts > start
    while rest.any():
        s, c = shingles[rest], counts[rest]
        seeds.append(_mix(s + np.array([level], _U) * _LEVEL))
        starts.append(np.full(len(s), start))
        widths.append(np.full(len(s), width))
        caps.append(c)
        level, start, width = level + 1, start + width, start + width
        rest = counts > start
    return tuple(map(np.concatenate, (seeds, starts, widths, caps)))


def signature(shingles: np.ndarray, registers: int) -> np.ndarray:
    """The earliest time of each register, for a bag given as hashes with repeats."""
    kinds, counts = np.unique(shingles, return_counts=True)
    seeds, starts, widths, caps = _blocks(kinds, counts.astype(np.float64))
    most = registers * (np.log(registers) + 5.0) / len(shingles)
    whole = starts + widths <= caps
    while True:
        out = np.full(registers, np.inf)
        seed, start, width, cap, full = seeds, starts, widths, caps, whole
        per = int(np.ceil(most * float(np.median(width)))) + 1
        at, step = np.zeros(len(seed)), 0
        while len(seed):
            size = max(1, min(per, 4096))
            h = _mix(seed[:, None] + _POINT * np.arange(step + 1, step + size + 1, dtype=_U)[None, :])
            gaps = -np.log(_unit(h)) / width[:, None]
            gaps[:, 0] += at
            times = np.cumsum(gaps, axis=1)
            inside = times <= most
            level = _unit(_mix(h ^ _LEVEL))
            counted = inside & (full[:, None] | (start[:, None] + level * width[:, None] <= cap[:, None]))
            where = (_mix(h ^ _BAND)[counted] % _U(registers)).astype(np.int64)
            np.minimum.at(out, where, times[counted])
            alive = inside[:, -1]
            at, seed, start, width, cap, full = times[alive, -1], seed[alive], start[alive], width[alive], cap[alive], full[alive]
            step += size
            per = max(1, per // 2)
        if np.isfinite(out).all():
            return out
        most *= 2.0


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = times.view(_U).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=_U) * _BAND
    for k in range(rows):
        h = _mix(h + bits[:, k] * _POSITIONS[k % SHINGLE])
    return h.view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """1,024 cells of whether an odd number of shingles fell in: bags differ in no more cells than shingles."""
    cells = np.bincount((_mix(shingles ^ _LEVEL) & _U(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def bag(text: str) -> Counter:
    words = words_in(text)
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*[words[k:] for k in range(SHINGLE)], strict=False))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Sum of minima over sum of maxima; two empty bags are alike."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b) if len(a) <= len(b) else sum(min(n, a[s]) for s, n in b.items() if s in a)
    either = a.total() + b.total() - both
    return both / either if either else 1.0


def _sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, digest of the word sequence, n (shingles), parity, bands (keys; none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                digests, sizes, keys, cells = [], [], [], []
                found = Words(part.column(2))
                for text, of in zip(part.column(2).to_pylist(), np.split(found.hash, np.cumsum(found.in_text)[:-1]), strict=True):
                    digests.append(hashlib.sha256(b" ".join(text.lower().split())).digest())
                    shingles = shingle_hashes(of)
                    sizes.append(len(shingles))
                    cells.append(parity(shingles))
                    keys.append(band_keys(signature(shingles, bands * rows), bands, rows) if len(shingles) else np.zeros(0, np.int64))
                offsets = np.zeros(len(keys) + 1, np.int32)
                np.cumsum([len(k) for k in keys], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64())), lists],
                    names=["doc_id", "text_hash", "digest", "n", "parity", "bands"],
                )

    return docs.select("doc_id", "text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, text_hash long, digest binary, n long, parity array<long>, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose bags reach the similarity; texts are read anew, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, Counter()
        for batch in batches:
            u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for i in range(batch.num_rows):
                if u[i] != held:
                    held, left = u[i], bag(a[i])
                if weighted_jaccard(left, bag(b[i])) >= similarity:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], names=["u", "v"])

    one = texts.select(F.col("rep").alias("u"), F.col("text").alias("a"))
    two = texts.select(F.col("rep").alias("v"), F.col("text").alias("b"))
    rows = pairs.join(two, "v").join(one, "u").select("u", "v", "a", "b")
    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, row_id, text_hash, class_id, class_size, kept.

    Words are runs of non-blank characters with A-Z in lower case; null text counts as empty. Texts with
    the same word sequence are one class from the start (all texts without words, too) and take part as
    one. Two texts are linked at a weighted Jaccard similarity of ``similarity`` or more; classes are the
    connected components of the links, named by their least doc_id (null ids last). A pair at 0.8 is
    missed by all 40 bands of 5 registers with a probability of 1.2e-7. One row of a class is kept: the
    least doc_id, and of repeated rows the first read. An empty table gives an empty result. Columns but
    doc_id and text are ignored.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketch = materialise(_sketch(slim, bands, rows).withColumn("row_id", F.monotonically_increasing_id()), "sketch")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "text_hash")
    # Copies are counted apart first: each text takes part once, under the row that would stay (rep).
    reps = materialise(
        sketch.groupBy("digest").agg(F.min(order).alias("best"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("bands").alias("bands"), F.count("*").alias("copies")).select(
            "digest", F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("text_hash"), F.col("best.row_id").alias("rep"), "n", "parity", "bands", "copies"
        ),
        "reps",
    )
    buckets = reps.select("rep", "n", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared_keys = materialise(buckets.join(full, "key"), "shared")
    # The centre of a band's bucket is the member that shares most: the text that others were copied from.
    score = shared_keys.groupBy("rep").agg(F.sum("size").alias("score"))
    scored = shared_keys.join(score, "rep")
    centres = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("rep"))).alias("c")).select("key", (-F.col("c.rep")).alias("u"))
    members = materialise(scored.join(centres, "key").select("key", "rep", "n", "u"), "buckets")
    stars = members.filter("rep != u").select("u", F.col("rep").alias("v")).distinct()

    def possible(pu, pv, nu, nv):
        """What every similar pair meets: sizes and parities bound how much two bags differ."""
        apart = sum((F.bit_count(pu[i].bitwiseXOR(pv[i])) for i in range(16)), F.lit(0))
        return (F.least(nu, nv) >= F.lit(similarity) * F.greatest(nu, nv) - 1e-9) & (apart <= F.lit((1 - similarity) / (1 + similarity)) * (nu + nv) + 1e-9)

    cells = reps.select("rep", "n", "parity")
    one = cells.select(F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("parity").alias("pu"))
    two = cells.select(F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("parity").alias("pv"))
    test = possible(F.col("pu"), F.col("pv"), F.col("nu"), F.col("nv"))
    pairs = stars.join(one, "u").join(two, "v").filter(test).select("u", "v")
    shared = reps.join(members.select("rep").distinct(), "rep").select("rep", F.col("best_id").alias("doc_id"), "text_hash")
    texts = _texts(slim, shared)
    links = materialise(_verified(pairs, texts, similarity), "links")
    roots = components(links)
    # Members that a band still holds apart: each pair of them in different components is checked.
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "u", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    open_ = materialise(placed.join(mixed, "key").join(reps.select("rep", "parity", "bands"), "rep"), "open")
    a = open_.select("key", F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("parity").alias("pu"), F.col("root").alias("ru"), F.col("u").alias("centre"), F.col("bands").alias("bu"))
    b = open_.select("key", F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("parity").alias("pv"), F.col("root").alias("rv"), F.col("bands").alias("bv"))
    once = F.element_at(F.array_intersect("bu", "bv"), 1) == F.col("key")
    fresh = (F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & (F.col("u") != F.col("centre")) & (F.col("v") != F.col("centre"))
    more = materialise(a.join(b, "key").filter(fresh & test & once).select("u", "v"), "more")
    links = materialise(links.unionByName(_verified(more, texts, similarity)), "links")
    discard(members, open_, more, texts)
    roots = components(links)
    named = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rep", "best_id", "copies", F.coalesce("root", "rep").alias("root"))
    first = F.struct(F.col("best_id").isNull().alias("no_id"), "best_id", "rep")
    classes = named.groupBy("root").agg(F.min(first).alias("first"), F.sum("copies").alias("class_size"))
    placed = named.join(classes, "root").select(
        "digest", F.col("first.best_id").alias("class_id"), F.col("first.rep").alias("stays"), "class_size"
    )
    return sketch.select("doc_id", "row_id", "text_hash", "digest").join(placed, "digest").select("doc_id", "row_id", "text_hash", "class_id", F.col("class_size").cast("long"), (F.col("row_id") == F.col("stays")).alias("kept"))


def _texts(slim: DataFrame, reps: DataFrame) -> DataFrame:
    """Texts of the documents that share a band with another, found again by doc_id and a hash of the text."""
    same = slim["doc_id"].eqNullSafe(reps["doc_id"]) & (slim["text_hash"] == reps["text_hash"])
    return materialise(slim.join(reps, same).select("rep", "text"), "texts")
