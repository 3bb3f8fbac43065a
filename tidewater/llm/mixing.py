"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

A source of weight q/D, an exact fraction, gets its i-th block a release time floor(i*D/q) and a deadline
ceil((i+1)*D/q), in slots of one block each. Earliest deadline first over the released blocks meets
every deadline on a single line of slots, so before any slot a source is less than one block ahead of or
behind its exact weight. The schedule repeats after D slots; only that period is laid out, and the place of
any block follows from it by arithmetic.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slots of one period, and sources, at most; both are laid out on the driver.
MOST_SLOTS = 100_000


def shares(weights: dict[str, float | str | Fraction]) -> dict[str, int]:
    """Slots of each source in one period, in the exact proportions of the weights; 0 for weights of 0 or less.

    A number stands for its shortest decimal form (0.1999 is 1999/10000), so that the period is short.
    """
    exact = {k: max(Fraction(0), Fraction(str(v))) for k, v in weights.items()}
    scale = math.lcm(*[v.denominator for v in exact.values()]) if exact else 1
    whole = {k: int(v * scale) for k, v in exact.items()}
    divisor = math.gcd(*whole.values()) or 1
    whole = {k: v // divisor for k, v in whole.items()}
    if sum(whole.values()) > MOST_SLOTS:
        raise ValueError(f"these weights repeat after {sum(whole.values())} slots only, more than {MOST_SLOTS}: give them fewer digits")
    return whole


def quotas(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole-number weights near the given ones: largest remainders, one at least; they sum to ``slots``."""
    named = {k: max(0.0, float(v)) for k, v in weights.items()}
    total = sum(named.values())
    if not named:
        return {}
    if slots < len(named):
        raise ValueError("a period needs a slot for each source")
    exact = {k: (v / total if total else 1 / len(named)) * (slots - len(named)) for k, v in named.items()}
    out = {k: 1 + math.floor(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[: slots - sum(out.values())]:
        out[k] += 1
    return out


def period(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, nth, release, deadline, slot) of every block of one period; earliest deadline first."""
    slots = sum(share.values())
    waiting = [(0, -(-slots // q), k, 0) for k, q in sorted(share.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            release, deadline, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        out.append((k, i, release, deadline, slot))
        if i + 1 < share[k]:
            q = share[k]
            heapq.heappush(waiting, ((i + 1) * slots // q, -(-(i + 2) * slots // q), k, i + 1))
    return out


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights that flatten the sources' own sizes."""
    return {k: float(v) ** power for k, v in counts.items() if v}


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, slots: int = 1000, block_rows: int = 64, shard_rows: int = 8192) -> DataFrame:
    """The columns of ``docs`` behind ``_in``, and source_key, block, place, weight, release, deadline, slot.

    Every row stays, once. Without ``weights`` each source has the square root of its size as its weight, to a whole
    number of ``slots`` slots. A source of weight 0, or that the weights don't name, comes after all others and has
    no release and deadline. Null sources count as "". Within a source rows are shuffled by a hash of doc_id (then
    doc_id). A source is split into shards by that hash, each counted and ranked alone, so a source with most of the
    rows takes no single task. When a source has no block left its slots stay empty and the others keep their
    proportions. Weights that repeat after more than ``MOST_SLOTS`` slots, and more sources than that, are refused.
    An empty table gives an empty result.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(41))
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    found = docs.select(name.alias("k")).groupBy("k").agg(F.count("*").alias("n")).limit(MOST_SLOTS + 1).collect()  # a row per source
    if len(found) > MOST_SLOTS:
        raise ValueError(f"more than {MOST_SLOTS} sources: group them first")
    sizes = {r["k"]: r["n"] for r in found}
    given = {k: weights.get(k, 0) for k in sizes} if weights else quotas(tempered(sizes), max(slots, 4 * len(sizes)))
    share = shares(given)
    period_slots = sum(share.values())
    blocks_of = {k: -(-n // block_rows) for k, n in sizes.items()}
    # Sources without a share follow the last slot of the others, one after the other.
    end = max([period_slots * -(-blocks_of[k] // q) for k, q in share.items() if q], default=0)
    starts = {}
    for k in sorted(k for k, q in share.items() if not q):
        starts[k], end = end, end + blocks_of[k]
    bits = max(0, math.ceil(math.log2(max(1, sum(sizes.values()) / shard_rows))))
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_in"), F.col("doc_id").cast("long").alias("_id"), name.alias("source_key"), key.alias("_key")
    ).withColumn("shard", F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = docs.select(name.alias("source_key"), key.alias("_key")).select(
        "source_key", (F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long")).alias("shard")
    ).groupBy("source_key", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source_key", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    # the unsigned order of the key within a shard
    order = Window.partitionBy("source_key", "shard").orderBy(F.col("_key").bitwiseXOR(F.lit(-(2**63))), "_id")
    ranked = keyed.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, ["source_key", "shard"])
    at = F.col("_rank") + F.col("before")
    blocks = ranked.withColumn("block", F.floor(at / block_rows)).withColumn("place", F.pmod(at, F.lit(block_rows)))
    laid: dict[str, list[int]] = {k: [] for k in share}
    for k, _, _, _, slot in sorted(period({k: q for k, q in share.items() if q}), key=lambda r: r[4]):
        laid[k].append(slot)
    rows = [{"source_key": k, "quota": q, "start": starts.get(k), "laid": laid[k]} for k, q in share.items()]
    table = docs.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<source_key:string,quota:bigint,start:bigint,laid:array<bigint>>>"))
    )
    turn, nth, q = F.floor(F.col("block") / F.col("quota")), F.pmod("block", F.col("quota")).cast("int"), F.col("quota")
    own = q > 0
    # a row per source; all lists together have the slots of one period
    return blocks.join(F.broadcast(table), "source_key").select(
        "_in", "_id", "source_key", "block", "place", (q / F.lit(max(1, period_slots))).alias("weight"),
        F.when(own, F.expr(f"(block * {period_slots}) div quota")).alias("release"),
        F.when(own, F.expr(f"((block + 1) * {period_slots} + quota - 1) div quota")).alias("deadline"),
        F.when(own, F.get("laid", nth) + turn * period_slots).otherwise(F.col("start") + F.col("block")).alias("slot"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, block, place, release, deadline, slot, weight (of its source, all sum to 1)."""
    done = scheduled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source"), **options)
    return done.select(F.col("_id").alias("doc_id"), F.col("_in.source").alias("source"), "block", "place", "release", "deadline", "slot", "weight")


def in_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its own columns, its rows (and the files they are written to) in the order of the mix."""
    done = scheduled(docs, **options)
    return done.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("_in.*")
