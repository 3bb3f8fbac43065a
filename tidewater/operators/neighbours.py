"""Nearest neighbours by a pivot index, counts of near pairs by a grid, the distance of a rate by sorted blocks: exact, none compares all with all."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.ordering import dense_index
from tidewater.session import ship

#: Leaves of an index at most; what every task is sent about them is bounded by it.
MOST_LEAVES = 100_000
#: Slack for rounding in the triangle inequality.
SLACK = 1e-9
#: Rows of a library and queries that are multiplied at once, and pairs that wait for their distances.
STRIP, CHUNK, MOST_PAIRS = 4096, 256, 1 << 20
#: Tasks of a search at most.
MOST_TILES = 20_000


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q to all of x, coordinate by coordinate, so that equal vectors are 0 apart."""
    out = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        out += (q[:, j, None] - x[None, :, j]) ** 2
    return out


@dataclass
class PivotIndex:
    """Rows (leaf, i, v, t) in leaves around pivots, and what is known of each leaf: its pivot, its radii, its first position, its size."""

    rows: DataFrame
    pivots: np.ndarray
    leaves: pd.DataFrame


def pivot_index(library: DataFrame, pivots: int = 64, leaf_rows: int = 1024, vec: str = "vec") -> PivotIndex:
    """An index over ``library`` (idx, vec, target): every row goes to its nearest pivot.

    Pivots are a sample of the library, so only how much is pruned depends on them. A pivot's rows are cut into leaves by
    position, so a cell that holds a third of all rows is many leaves, and leaves know the first position in them.
    The leaves of a stretch of positions are a bundle.
    """
    spark = ship(library.sparkSession)
    rows = library.select(F.col("idx").cast("long").alias("i"), F.col(vec).alias("v"), F.col("target").cast("double").alias("t"))
    n, last = rows.agg(F.count("*"), F.coalesce(F.max("i"), F.lit(0))).first()
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("i"), "i").limit(pivots).collect()]  # a bounded sample
    centres = np.array(chosen, float) if chosen else np.zeros((0, 0))
    # Leaves by position are as long as it takes for a cell of mean size to fill them, and never more than MOST_LEAVES.
    span = max(leaf_rows * max(len(chosen), 1), -(-(last + 1) * max(len(chosen), 1) // MOST_LEAVES)) if n > leaf_rows * len(chosen) else last + 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                d = squares(np.stack(part["v"].to_list()), centres)
                at = d.argmin(1)
                yield part.assign(cell=at, r=np.sqrt(d[np.arange(len(at)), at]), leaf=at + len(centres) * (part["i"].to_numpy() // span))

    placed = rows.mapInPandas(place, "i long, v array<double>, t double, cell long, r double, leaf long").cache()
    known = placed.groupBy("leaf").agg(F.first("cell").alias("cell"), F.min("r").alias("near"), F.max("r").alias("far"), F.min("i").alias("low"), F.count("*").alias("size")).orderBy("leaf")
    del spark
    return PivotIndex(placed.select("leaf", "i", "v", "t"), centres, known.toPandas())  # at most MOST_LEAVES rows


def _first_copies(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the first k with their vector; where what is known is a prefix, no other is among a query's k nearest."""
    if not x.shape[1]:
        return np.argsort(at, kind="stable")[:k]
    group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((at, group))
    return order[_ranks(group[order]) < k]


def _ranks(sorted_groups: np.ndarray) -> np.ndarray:
    """Each row's place in its run of equal groups."""
    starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
    return np.arange(len(sorted_groups)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_groups)]))


def _pieces(cuts: np.ndarray, n: int, size: int) -> list[tuple[int, int]]:
    """Ends of pieces of at most ``size`` rows that don't go beyond a cut."""
    edges = [0, *map(int, cuts), n]
    return [(a, min(a + size, e)) for b, e in zip(edges[:-1], edges[1:], strict=True) for a in range(b, e, size)]


def nearest_known(
    q: np.ndarray, now: np.ndarray, x: np.ndarray, at: np.ndarray, k: int, theiler: int, horizon: int,
    pivots: np.ndarray | None = None, cell: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows of q, rows of x, squared distances, distances taken): the exact k nearest known rows of x of each row of q.

    Strips of x are multiplied with chunks of q. What comes within the rounding error of a query's k-th product is compared
    again by ``squares``' sum, which alone decides. With ``pivots``, a strip holds one cell, and only queries to which
    the triangle inequality leaves it open are multiplied with it.
    """
    use = np.flatnonzero(np.isfinite(x).all(1))
    if horizon >= -theiler:
        use = use[_first_copies(x[use], at[use], k)]
    asked = np.flatnonzero(np.isfinite(q).all(1))
    none = np.zeros(0, int)
    if not len(use) or not len(asked):
        return none, none, np.zeros(0), 0
    use = use[np.lexsort((at[use], cell[use] if pivots is not None else np.zeros(len(use))))]
    x, at = x[use], at[use]
    if pivots is not None:
        cell = cell[use]
        to_pivot = np.sqrt(squares(q[asked], pivots))
        own = to_pivot.argmin(1)
        order = np.lexsort((now[asked], own))
        asked, to_pivot = asked[order], to_pivot[order]
        turns = np.flatnonzero(np.diff(own[order])) + 1
        radius = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
        cuts = np.flatnonzero(np.diff(cell)) + 1
    else:
        asked = asked[np.argsort(now[asked], kind="stable")]
        cuts = turns = none
    q, now = q[asked], now[asked]
    strips, chunks = _pieces(cuts, len(x), STRIP), _pieces(turns, len(q), CHUNK)
    first, last = (np.array([f(at[a:b]) for a, b in strips]) for f in (np.min, np.max))
    if pivots is not None:
        of, near, far = cell[[a for a, _ in strips]], np.array([radius[a:b].min() for a, b in strips]), np.array([radius[a:b].max() for a, b in strips])
    shift = x.mean(0)
    xc, qc = x - shift, q - shift
    xx, qq = (xc * xc).sum(1), (qc * qc).sum(1)
    right = np.c_[xc, xx].T.copy()
    left = np.c_[-2 * qc, np.ones(len(qc))]
    error = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (qq + xx.max())
    most = np.finfo(float).max
    out, taken = [], 0

    def settle(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k nearest of each query among the pairs, and their squared distances."""
        square = (q[r] - x[c]) ** 2
        d = np.zeros(len(r))
        for j in range(square.shape[1]):
            d += square[:, j]
        order = np.lexsort((at[c], d, r))
        order = order[np.isfinite(d[order])]
        keep = order[_ranks(r[order]) < k] if len(order) else order
        return keep, d[keep]

    for s, e in chunks:
        here = slice(s, e)
        best = np.full((e - s, k), np.inf)  # the least products of each query, less its own square
        slack = 2 * error[here]
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        order = np.argsort(to_pivot[here].mean(0)[of], kind="stable") if pivots is not None else np.arange(len(strips))
        for n in order:
            a, b = strips[n]
            need = now[here] - horizon >= first[n]
            top = best.max(1)
            if pivots is not None:
                d = to_pivot[here, of[n]]
                bound = np.sqrt(np.maximum(top + qq[here], 0) + slack)
                need &= np.maximum(np.maximum(d - far[n], near[n] - d), 0) <= bound * (1 + SLACK) + SLACK
            rows = np.flatnonzero(need)
            if not len(rows):
                continue
            taken += len(rows) * (b - a)
            product = left[here][rows] @ right[:, a:b]
            moment = now[here][rows]
            if last[n] > moment.min() - max(horizon, theiler + 1):
                product[(at[None, a:b] + horizon > moment[:, None]) | (np.abs(moment[:, None] - at[None, a:b]) <= theiler)] = np.inf
            top = top[rows]
            fresh = not np.isfinite(top).all()
            if fresh:
                best[rows] = np.partition(np.concatenate([best[rows], product], 1), k - 1, 1)[:, :k]
                top = best[rows].max(1)
            hit = np.flatnonzero(product <= np.minimum(top + slack[rows], most)[:, None])
            if not len(hit):
                continue
            r, c = np.divmod(hit, b - a)
            value = product[r, c]
            if not fresh:
                more = np.full((len(rows), np.bincount(r).max()), np.inf)
                more[r, _ranks(r)] = value
                best[rows] = np.partition(np.concatenate([best[rows], more], 1), k - 1, 1)[:, :k]
            pairs.append((rows[r], c + a, value))
            held += len(r)
            if held > MOST_PAIRS:
                r, c, value = (np.concatenate(p) for p in zip(*pairs, strict=True))
                keep, _ = settle(r + s, c)
                pairs, held = [(r[keep], c[keep], value[keep])], 0
        if pairs:
            r, c, value = (np.concatenate(p) for p in zip(*pairs, strict=True))
            close = value <= best.max(1)[r] + slack[r]
            r, c = r[close], c[close]
            keep, d = settle(r + s, c)
            out.append((asked[r[keep] + s], use[c[keep]], d))
    if not out:
        return none, none, np.zeros(0), taken
    r, c, d = (np.concatenate(p) for p in zip(*out, strict=True))
    return r, c, d, taken


def query_blocks(queries: DataFrame, query_rows: int, vec: str = "vec") -> DataFrame:
    """(q, i, v): queries in blocks of ``query_rows`` of them, in the order of their positions."""
    placed = dense_index(queries.select(F.col("idx").cast("long").alias("i"), F.col(vec).alias("v")), F.floor(F.col("i") / 65_536), ["i"], "_place")
    return placed.select(F.floor(F.col("_place") / query_rows).alias("q"), "i", "v")


def tiled(asked: DataFrame, library: DataFrame, low: DataFrame, horizon: int, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over each block of queries (q, i, v) and each of the library (b, i, v, t, ...) that holds a position known to it.

    ``low`` (b, low) has the first position of each library block. Tasks are as many as pairs of blocks, up to
    MOST_TILES, so what one of them does doesn't grow with the tables until then.
    """
    high = asked.groupBy("q").agg(F.max("i").alias("high"))
    pairs = low.join(high, F.col("low") + horizon <= F.col("high")).select("b", "q").cache()  # of blocks, not of rows
    tasks = max(1, min(pairs.count(), MOST_TILES))
    wanted = asked.join(pairs, "q").select("b", "q", "i", "v").repartition(tasks, "b", "q")
    held = library.join(pairs, "b").withColumnsRenamed({"b": "hb", "q": "hq"}).repartition(tasks, "hb", "hq")
    return wanted.groupBy("b", "q").cogroup(held.groupBy("hb", "hq")).applyInPandas(run, schema)


def found_rows(left: pd.DataFrame, right: pd.DataFrame, k: int, theiler: int, horizon: int, pivots: np.ndarray | None = None) -> tuple[pd.DataFrame, int]:
    """(query_idx, cand_idx, dist, target) of one tile, and the distances taken."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query_idx": [], "cand_idx": [], "dist": [], "target": []}).astype({"query_idx": int, "cand_idx": int}), 0
    at, now = right["i"].to_numpy(), left["i"].to_numpy()
    cell = right["cell"].to_numpy() if pivots is not None else None
    r, c, d, taken = nearest_known(np.stack(left["v"].to_list()), now, np.stack(right["v"].to_list()), at, k, theiler, horizon, pivots, cell)
    return pd.DataFrame({"query_idx": now[r], "cand_idx": at[c], "dist": np.sqrt(d), "target": right["t"].to_numpy()[c]}), taken


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_idx, rank, cand_idx, dist, target): the k nearest of each query, ties by cand_idx."""
    w = Window.partitionBy("query_idx").orderBy("dist", "cand_idx")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_idx", "rank", "cand_idx", "dist", "target")


def _bundles(index: PivotIndex) -> tuple[DataFrame, DataFrame]:
    """The index's rows (b, cell, i, v, t) by bundle, and the first position of each bundle."""
    width = len(index.pivots)
    low = index.leaves.assign(b=index.leaves["leaf"] // width).groupby("b", as_index=False)["low"].min()
    return index.rows.select(F.floor(F.col("leaf") / width).alias("b"), (F.col("leaf") % width).alias("cell"), "i", "v", "t"), index.rows.sparkSession.createDataFrame(low)


def indexed_neighbours(queries: DataFrame, index: PivotIndex, k: int, theiler: int, horizon: int, vec: str = "vec", query_rows: int = 16_384) -> DataFrame:
    """(query_idx, rank, cand_idx, dist, target): the exact k nearest known vectors of each query, by the index.

    The rule is that of ``forecast.causal_neighbours``. A task holds a block of queries and a bundle of leaves. It looks
    into the leaves around the nearest pivots first, and then only into those that the triangle inequality and
    the positions leave open to a query; the bundles' winners are merged.
    """
    ship(queries.sparkSession)
    if not len(index.leaves):
        return queries.sparkSession.createDataFrame([], "query_idx long, rank int, cand_idx long, dist double, target double")
    rows, low = _bundles(index)
    pivots = index.pivots

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return found_rows(left, right, k, theiler, horizon, pivots)[0]

    return best_of(tiled(query_blocks(queries, query_rows, vec), rows, low, horizon, run, "query_idx long, cand_idx long, dist double, target double"), k)


def distances_taken(queries: DataFrame, index: PivotIndex, k: int, theiler: int, horizon: int, vec: str = "vec", query_rows: int = 16_384) -> int:
    """How many distances to library rows a search takes."""
    rows, low = _bundles(index)
    pivots = index.pivots

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"taken": [found_rows(left, right, k, theiler, horizon, pivots)[1]]})

    return tiled(query_blocks(queries, query_rows, vec), rows, low, horizon, run, "taken long").agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]


# ---------------------------------------------------------------- pairs within a distance


def near_pairs(df: DataFrame, eps: float, value: str = "x", mean_cell: int = 32) -> DataFrame:
    """(n, recurrent, rate): ordered pairs of values at most ``eps`` apart, each with itself included; of a series of any length.

    Equal values are counted first. The values lie in cells of eps / s: those of cells up to s - 2 apart are always
    near, and only counts of cells are multiplied; those s - 1 to s + 1 apart are compared in an equi-join of cells. ``s``
    grows until a cell holds ``mean_cell`` different values on average. Nulls and NaN take no part.
    """
    if not eps > 0:
        raise ValueError("eps must be above 0")
    values = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("m")).cache()
    low, high, different = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not different:
        values.unpersist()
        return df.sparkSession.createDataFrame([(0, 0, None)], "n long, recurrent long, rate double")
    cells_of_eps = max((high - low) / eps, 1.0)
    s = int(min(max(4, math.ceil(different / cells_of_eps / mean_cell)), 512))
    celled = values.withColumn("c", F.floor(F.col("x") / F.lit(eps / s)))
    total = celled.groupBy("c").agg(F.sum("m").alias("h"))
    # Sums of the s - 2 cells that follow: a cell adds its count to each cell it follows.
    ahead = total.select(F.explode(F.sequence(F.col("c") - (s - 2), F.col("c") - 1)).alias("c"), "h").groupBy("c").agg(F.sum("h").alias("after"))
    whole = total.join(ahead, "c", "left").agg(F.sum(F.col("h") * F.col("h") + 2 * F.col("h") * F.coalesce("after", F.lit(0))).alias("whole"), F.sum("h").alias("n"))
    right = celled.select(F.col("x").alias("_b"), F.col("m").alias("_m"), F.explode(F.array(*[F.col("c") - k for k in (s - 1, s, s + 1)])).alias("c"))
    edge = celled.join(right, "c").filter(F.col("_b") - F.col("x") <= eps).agg(F.coalesce(F.sum(F.col("m") * F.col("_m")), F.lit(0)).alias("edge"))
    out = whole.crossJoin(edge).select("n", (F.col("whole") + 2 * F.col("edge")).alias("recurrent"))  # one row each
    return out.withColumn("rate", F.col("recurrent") / (F.col("n") * F.col("n")))


#: Blocks of sorted values at most; what the driver knows of each is its ends and its size.
MOST_BLOCKS = 4096


def epsilon_of_rate(df: DataFrame, target: float = 0.05, value: str = "x", steps: int = 50, block_rows: int = 65_536, levels: int = 5) -> DataFrame:
    """(n, mean, std, epsilon, rate): the distance at which the share of near pairs of the z-scores is ``target``, by ``steps`` bisections.

    For a series of any length. The different values, with their counts, lie in sorted blocks. Most bisections are settled by
    the ends of the blocks alone. For the others one job counts for all middles of the next ``levels`` bisections: a
    block meets only the blocks in which its values plus a middle can end, some three, and all others count whole. The
    result is that of the plain bisection on the sorted series. Nulls and NaN take no part; a flat series gives epsilon 0.
    """
    spark = ship(df.sparkSession)
    schema = "n long, mean double, std double, epsilon double, rate double"
    used = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v"))
    n, mean, std = used.agg(F.count("*"), F.avg("v"), F.stddev_samp("v")).first()
    if not n:
        return spark.createDataFrame([(0, None, None, None, None)], schema)
    if not std:
        return spark.createDataFrame([(n, mean, 0.0, 0.0, 1.0)], schema)
    values = used.groupBy(((F.col("v") - mean) / std).alias("z")).agg(F.count("*").alias("m"))
    different = values.count()
    count = max(1, min(MOST_BLOCKS, -(-different // block_rows)))
    cuts = values.agg(F.percentile_approx("z", [i / count for i in range(1, count)], 10 * count)).first()[0] if count > 1 else []
    edges = np.unique(np.asarray(cuts, float))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(b=np.searchsorted(edges, part["z"].to_numpy(), "left"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("z")
        return pd.DataFrame([{"b": part["b"].iloc[0], "z": part["z"].to_numpy(), "m": part["m"].to_numpy()}])

    blocks = values.mapInPandas(deal, "z double, m long, b long").groupBy("b").applyInPandas(pack, "b long, z array<double>, m array<long>").persist()
    known = blocks.select("b", F.element_at("z", 1).alias("first"), F.element_at("z", -1).alias("last"), F.aggregate("m", F.lit(0).cast("long"), lambda a, b: a + b).alias("w")).toPandas().sort_values("b")
    name, first, last = (known[c].to_numpy() for c in ("b", "first", "last"))
    weight = [int(w) for w in known["w"]]
    before = [0]
    for w in weight:
        before.append(before[-1] + w)

    def reach(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """For each block: how many blocks lie whole within its values plus ``low``, and how many begin within those plus ``high``."""
        return np.searchsorted(last, first + low, "right"), np.searchsorted(first, last + high, "right")

    def rate(ranks: int) -> float:
        return float(2 * (ranks - n * (n - 1) // 2) - n) / (n * n)

    def counted(middles: list[float]) -> dict[float, float]:
        a, b = reach(min(middles), max(middles))
        whole = sum(w * before[i] for w, i in zip(weight, a, strict=True))
        pairs = pd.DataFrame([(int(name[i]), int(name[j])) for i in range(len(name)) for j in range(a[i], b[i])], columns=["a", "o"])
        sums = dict.fromkeys(range(len(middles)), 0)
        if len(pairs):
            asked = blocks.join(F.broadcast(spark.createDataFrame(pairs)), F.col("b") == F.col("a")).select("o", F.col("z").alias("qz"), F.col("m").alias("qm"))
            met = asked.join(blocks, F.col("o") == F.col("b")).select("qz", "qm", "z", "m")

            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    for qz, qm, z, m in zip(part["qz"], part["qm"], part["z"], part["m"], strict=True):
                        cum = np.concatenate([[0], np.cumsum(m)])
                        yield pd.DataFrame({"k": range(len(middles)), "s": [int((qm * cum[np.searchsorted(z, qz + e, "right")]).sum()) for e in middles]})

            sums.update({r["k"]: int(r["s"]) for r in met.mapInPandas(run, "k int, s long").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()})
        return {e: rate(whole + sums[k]) for k, e in enumerate(middles)}

    def tree(low: float, high: float, depth: int) -> list[float]:
        mid = (low + high) / 2
        return [mid] if depth == 1 else [mid, *tree(low, mid, depth - 1), *tree(mid, high, depth - 1)]

    low, high, left = 0.0, float(last[-1] - first[0]), steps
    rates: dict[float, float] = {}
    while left:
        mid = (low + high) / 2
        if mid not in rates:
            a, b = reach(mid, mid)
            if rate(sum(w * before[i] for w, i in zip(weight, b, strict=True))) < target:
                rates[mid] = -1.0  # whatever the blocks hold
            elif rate(sum(w * before[i] for w, i in zip(weight, a, strict=True))) >= target:
                rates[mid] = 2.0
            else:
                depth = min(levels, left)
                while depth > 1 and sum(np.subtract(*reach(*[f(tree(low, high, depth)) for f in (min, max)])[::-1])) > 16 * len(name):
                    depth -= 1
                rates.update(counted(sorted(set(tree(low, high, depth)))))
        low, high = (mid, high) if rates[mid] < target else (low, mid)
        left -= 1
    found = counted([high])[high]
    blocks.unpersist()
    return spark.createDataFrame([(n, mean, std, high, found)], schema)
