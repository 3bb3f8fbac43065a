"""Changes applied in the order of their numbers, by a stateful streaming query.

Clients are dealt to hash buckets, the keys of an ``applyInPandasWithState``. Every batch brings one tick for each
bucket, so that a bucket runs even where it has no rows. Its state is one map, kept in Arrow's format, from (client, n) to a value: n from 1 on
is a change that is held, n = 0 is what the client is now and its latest applied change, which leaves the state when
a later one follows, so that it is known then whether it is the final one. A tick handles all clients of its bucket at
once: held rows and new ones are sorted by (client, n), runs of following numbers are found by differences, and
columns are carried forward by segmented scans; no loop runs over rows but for putting them into the state.

Of the changes of a client with the same number in the same batch only the first can be taken; the others are rejected
whatever the state is. They are found before the stream and go through it dealt over all buckets, so a client with a
third of all rows sends one row a number and batch to its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tidewater.llm.common import _handle, materialise, new_path
from tidewater.session import ship

KEY = "blank boolean, client_id long, n long"
VALUE = "day long, change_id long, op string, city string, balance double, batch int, missed long, next long"
FEED = "bucket long, tick boolean, late boolean, batch int, horizon long, blank boolean, client_id long, n long, day long, change_id long, op string, city string, balance double"
RESULT = "change_id long, client_id long, status string, batch int, missed long, city string, cents long, current boolean"

#: Stands for no day at all.
NEVER = -(1 << 40)
#: Horizon of the tick after the last batch: nothing waits any longer.
ALWAYS = 1 << 40


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that agree in all columns begins."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def least_from_here(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least value from each row to the end of its segment."""
    if not len(value):
        return value
    apart = int(value.max()) - int(value.min()) + 1
    shift = (np.cumsum(begin) - 1) * apart  # a segment further back lies lower than any before it, seen from the end
    return np.minimum.accumulate((value + shift)[::-1])[::-1] - shift


def carried(value: np.ndarray, sets: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The latest value that was set up to each row of its segment; ``first``, by row, where none was."""
    at = np.arange(len(value))
    opened = np.maximum.accumulate(np.where(begin, at, 0)) if len(at) else at
    latest = np.maximum.accumulate(np.where(sets, at, -1)) if len(at) else at
    return np.where(latest >= opened, value[np.maximum(latest, 0)], first)


_ROW = {"code": np.int64, "n": np.int64, "day": np.int64, "change_id": np.int64, "op": object, "city": object, "balance": object, "missed": np.int64, "was_held": bool}


def stacked(*frames: pd.DataFrame) -> pd.DataFrame:
    """Rows of all frames, each column in its kind even where a frame is empty."""
    return pd.DataFrame({c: np.concatenate([f[c].to_numpy(kind) for f in frames]) for c, kind in _ROW.items()})


def apply_batch(held: pd.DataFrame, clients: pd.DataFrame, rows: pd.DataFrame, horizon: int, patience: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """What a batch does to the clients of a bucket: applied rows, rejected rows, rows newly held.

    ``held`` and ``rows`` have code (the client's number here), n, day, change_id, op, city, balance, each (code, n) once
    in either; ``clients`` has next, city and balance by code. Applied rows come by (code, n) with the city and balance
    after them, ``missed``, and ``was_held``.
    """
    held = held.iloc[np.lexsort((held["n"], held["code"]))]
    code, n, day = (held[c].to_numpy(np.int64) for c in ("code", "n", "day"))
    begin = starts(code)
    runs = begin.copy()
    runs[1:] |= n[1:] != n[:-1] + 1
    run = np.cumsum(runs) - 1
    due = (least_from_here(day, begin)[runs] + patience <= horizon)[run] if len(n) else np.zeros(0, bool)
    expected = np.where(begin, clients["next"].to_numpy(np.int64)[code], np.concatenate([[0], n[:-1] + 1])[: len(n)])
    jumped = held[due].assign(missed=np.where(runs, n - expected, 0)[due], was_held=True)

    follows = clients["next"].to_numpy(np.int64).copy()
    np.maximum.at(follows, jumped["code"].to_numpy(np.int64), jumped["n"].to_numpy(np.int64) + 1)
    waiting = held[~due].assign(missed=0, was_held=True)
    rows = rows.assign(missed=0, was_held=False)
    both = stacked(waiting, rows)
    both = both.iloc[np.lexsort((~both["was_held"].to_numpy(bool), both["n"], both["code"]))]  # a held row before a new one of its number
    code, n = both["code"].to_numpy(np.int64), both["n"].to_numpy(np.int64)
    refused = ~both["was_held"].to_numpy(bool) & ((n < follows[code]) | ~starts(code, n))
    rejected, taken = both[refused], both[~refused]
    code, n = taken["code"].to_numpy(np.int64), taken["n"].to_numpy(np.int64)
    at = np.arange(len(code))
    begin = starts(code)
    rank = at - np.maximum.accumulate(np.where(begin, at, 0)) if len(at) else at
    goes = n == follows[code] + rank

    applied = stacked(jumped, taken[goes])
    applied = applied.iloc[np.lexsort((applied["n"], applied["code"]))].reset_index(drop=True)
    code, op = applied["code"].to_numpy(np.int64), applied["op"].to_numpy(object)
    begin = starts(code)
    whole, part = (op == "I") | (op == "D"), op == "U"
    for column in ("city", "balance"):
        value = applied[column].to_numpy(object)
        there = applied[column].notna().to_numpy(bool)
        value = np.where((op == "D") | ~there, None, value)
        applied[column] = pd.Series(carried(value, whole | (part & there), begin, clients[column].to_numpy(object)[code]), dtype=object)
    fresh = taken[~goes]
    return applied, rejected, fresh[~fresh["was_held"].to_numpy(bool)]


def _cents(balance: pd.Series) -> pd.Series:
    """floor(100 * balance + 0.5), null where there is no balance."""
    value = np.array([np.nan if b is None else b for b in balance], float)
    there = np.isfinite(value)
    return pd.Series(pd.array(np.where(there, np.floor(100 * np.where(there, value, 0) + 0.5), 0).astype(np.int64), dtype="Int64")).mask(~there)


_KINDS = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.large_string(), "double": pa.float64()}
_STORED = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in f"{KEY}, {VALUE}".split(", "))])


class Stored(dict):
    """The state of one bucket: a map from KEY to VALUE, which a stream keeps as one compressed table."""

    STATE = "changes binary"

    @classmethod
    def of(cls, group: GroupState) -> Stored:
        if not group.exists:
            return cls()
        with pa.ipc.open_stream(pa.py_buffer(bytes(group.get[0]))) as source:
            rows = list(zip(*(c.to_pylist() for c in source.read_all().columns), strict=True))
        return cls((r[: KEY.count(",") + 1], r[KEY.count(",") + 1 :]) for r in rows)

    def into(self, group: GroupState) -> None:
        if not self:
            if group.exists:
                group.remove()
            return
        columns = zip(*(k + v for k, v in self.items()), strict=True)
        table = pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _STORED.types, strict=True)], schema=_STORED)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _STORED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
            sink.write_table(table)
        group.update((out.getvalue().to_pybytes(),))

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter(self.items())

    def updateValue(self, key: tuple, value: tuple) -> None:
        self[key] = value

    def removeKey(self, key: tuple) -> None:
        del self[key]


class Applier:
    """The changes of one bucket of clients; ``state`` is the bucket's map."""

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        tick = came[came["tick"]].iloc[0]
        batch, horizon = int(tick["batch"]), int(tick["horizon"])
        came = came[~came["tick"]]
        late, came = came[came["late"]], came[~came["late"]]

        kept = list(self.state.iterator())
        stored = pd.DataFrame([k + v for k, v in kept], columns=[*(c.split()[0] for c in KEY.split(", ")), *(c.split()[0] for c in VALUE.split(", "))])
        every = pd.concat([stored[["blank", "client_id"]], came[["blank", "client_id"]]], ignore_index=True).astype({"blank": bool, "client_id": np.int64})
        every["code"] = every.groupby(["blank", "client_id"]).ngroup()
        stored["code"], came = every["code"].to_numpy()[: len(stored)], came.assign(code=every["code"].to_numpy()[len(stored) :])
        names = every.drop_duplicates("code").sort_values("code")
        now = stored[stored["n"] == 0].set_index("code")
        clients = now.reindex(names["code"])[["next", "city", "balance"]]
        clients["next"] = np.where(clients["next"].isna(), 1, clients["next"]).astype(np.int64)
        for c in ("city", "balance"):
            clients[c] = clients[c].astype(object).where(clients[c].notna(), None)

        columns = ["code", "n", "day", "change_id", "op", "city", "balance"]
        applied, rejected, fresh = apply_batch(stored.loc[stored["n"] > 0, columns], clients, came[columns], horizon, self.patience)

        blank, ids = names["blank"].to_numpy(bool), names["client_id"].to_numpy(np.int64)
        last = ~applied.duplicated("code", keep="last")
        lasts = applied[last]
        changed = now[now.index.isin(lasts["code"])]
        parts = [self._said(late["change_id"], late["client_id"], late["blank"], "rejected", batch)]
        parts.append(self._said(rejected["change_id"], ids[rejected["code"]], blank[rejected["code"]], "rejected", batch))
        for done, when in ((applied[~last], batch), (changed.reset_index(), None)):
            parts.append(self._said(done["change_id"], ids[done["code"]], blank[done["code"]], "applied", done["batch"] if when is None else when, done))
        if horizon >= ALWAYS:  # the end: what is the latest now stays so
            left = now[~now.index.isin(lasts["code"])].reset_index()
            for done, when in ((lasts, batch), (left, None)):
                parts.append(self._said(done["change_id"], ids[done["code"]], blank[done["code"]], "applied", done["batch"] if when is None else when, done, done["op"].to_numpy(object) != "D"))
            self.state.clear()
        else:
            for r in applied[applied["was_held"].astype(bool)].itertuples():
                self.state.removeKey((bool(blank[r.code]), int(ids[r.code]), int(r.n)))
            for r in lasts.itertuples():
                self.state.updateValue((bool(blank[r.code]), int(ids[r.code]), 0), (None, int(r.change_id), r.op, r.city, None if r.balance is None else float(r.balance), batch, int(r.missed), int(r.n) + 1))
            for r in fresh.itertuples():
                self.state.updateValue(
                    (bool(blank[r.code]), int(ids[r.code]), int(r.n)), (int(r.day), int(r.change_id), r.op, r.city, None if pd.isna(r.balance) else float(r.balance), None, None, None)
                )
        for part in parts:
            if len(part):
                yield part

    @staticmethod
    def _said(change_id, ids, blank, status: str, batch, done: pd.DataFrame | None = None, current=False) -> pd.DataFrame:
        n = len(change_id)
        client = pd.Series(pd.array(np.asarray(ids, np.int64), dtype="Int64")).mask(np.asarray(blank, bool))
        city = np.full(n, None, object) if done is None else done["city"].astype(object).where(done["city"].notna(), None).to_numpy(object)
        cents = _cents(pd.Series([None] * n, dtype=object) if done is None else done["balance"].astype(object).where(done["balance"].notna(), None))
        return pd.DataFrame(
            {
                "change_id": np.asarray(change_id, np.int64), "client_id": client, "status": np.full(n, status, object), "batch": np.full(n, batch, np.int32) if np.isscalar(batch) else np.asarray(batch, np.int32),
                "missed": np.zeros(n, np.int64) if done is None else done["missed"].to_numpy(np.int64), "city": city, "cents": cents, "current": np.full(n, current, bool) if np.isscalar(current) else np.asarray(current, bool),
            }
        )


def _applied(patience: int):
    """What the stream calls for each bucket and batch."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        one = Applier(patience)
        one.state = Stored.of(group)
        yield from one.handleInputRows(key, rows, None)
        one.state.into(group)

    return run


#: A start is a query of its own, so it opens a store for each partition anew: a store leaves the memory once its batch is done.
#: Spark's other store, RocksDB, leaves the counters of each opening (half a MB, ``org.rocksdb.Statistics``) in native memory for good.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.maxBatchesToRetainInMemory": "1",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def _state_in_files(spark: SparkSession) -> Iterator[None]:
    """Within it streams keep their state as ``STORE`` says; the session's own settings come back afterwards."""
    was = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _numbered(pairs: DataFrame) -> DataFrame:
    """(client_id, seq, n): the dense rank of each seq of a client, without a task that holds a client.

    Pairs are dealt out by range, ranked within their part, and moved on by the counts of the client's parts before.
    """
    placed = materialise(pairs.repartitionByRange("client_id", "seq").withColumn("part", F.spark_partition_id()), "numbers")
    counts = placed.groupBy("client_id", "part").agg(F.count("*").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("client_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select(F.col("client_id").alias("_c"), F.col("part").alias("_p"), ahead.alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("client_id", "part").orderBy("seq"))
    joined = placed.withColumn("rank", rank).join(offset, F.col("client_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    return joined.select("client_id", "seq", (F.col("rank") + F.col("ahead")).alias("n"))


def _feed(changes: DataFrame, batches: int, first_day: int, days: int, buckets: int) -> tuple[DataFrame, list[int]]:
    """The rows of all batches, as the stream takes them, and the horizon of each batch and of the end."""
    h = F.crc32(F.col("change_id").cast("string"))
    ids = [F.col(c).cast("long").alias(c) for c in ("change_id", "client_id", "seq")]
    told = changes.distinct().select(*ids, "op", F.col("city").cast("string").alias("city"), F.col("balance").cast("double").alias("balance"), "valid_at", F.xxhash64(*changes.columns).alias("tie"))
    day = F.unix_date(F.to_date("valid_at")).cast("long") + 9 * (h % 4)
    dated = told.withColumn("day", F.when(F.coalesce(h % 11, F.lit(0)) != 0, day)).drop("valid_at")
    number = F.least(F.lit(batches), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - first_day) * batches / days))).cast("int")
    base = materialise(dated.withColumn("batch", number), "changes")

    first = F.min(F.when(F.col("day").isNotNull(), F.struct("day", "change_id", "tie"))).alias("first")
    pairs = base.groupBy("client_id", "seq", "batch").agg(first)
    numbers = _numbered(pairs.select("client_id", "seq").distinct()).select(F.col("client_id").alias("_c"), F.col("seq").alias("_s"), "n")
    same = F.col("client_id").eqNullSafe(F.col("_c")) & F.col("seq").eqNullSafe(F.col("_s"))
    firsts = pairs.filter("batch IS NOT NULL").join(numbers, same).select("_c", "_s", F.col("batch").alias("_b"), "n", "first")
    rows = base.filter("day IS NOT NULL").join(firsts, same & (F.col("batch") == F.col("_b")))
    is_late = F.col("first") != F.struct("day", "change_id", "tie")
    rows = rows.select(
        F.pmod(F.when(is_late, F.xxhash64("change_id", "tie")).otherwise(F.xxhash64("client_id", F.lit(1))), F.lit(buckets)).alias("bucket"),
        F.lit(False).alias("tick"), is_late.alias("late"), "batch", F.lit(None).cast("long").alias("horizon"),
        F.col("client_id").isNull().alias("blank"), F.coalesce("client_id", F.lit(0)).alias("client_id"), F.col("n").cast("long").alias("n"), "day", "change_id", "op", "city", "balance",
    )
    latest = {r["batch"]: r["day"] for r in base.filter("day IS NOT NULL").groupBy("batch").agg(F.max("day").alias("day")).collect()}  # a row a batch
    horizons, seen = [], NEVER
    for b in range(1, batches + 1):
        horizons.append(seen)
        seen = max(seen, latest.get(b, NEVER))
    horizons.append(ALWAYS)
    spark = changes.sparkSession
    no = lambda kind: F.lit(None).cast(kind)
    ticks = spark.range(buckets * (batches + 1)).select(
        (F.col("id") % buckets).alias("bucket"), F.lit(True).alias("tick"), F.lit(False).alias("late"), (F.floor(F.col("id") / buckets) + 1).cast("int").alias("batch"),
        F.element_at(F.array(*[F.lit(x).cast("long") for x in horizons]), (F.floor(F.col("id") / buckets) + 1).cast("int")).alias("horizon"),
        F.lit(False).alias("blank"), F.lit(0).cast("long").alias("client_id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("day"), F.lit(0).cast("long").alias("change_id"),
        no("string").alias("op"), no("string").alias("city"), no("double").alias("balance"),
    )
    return rows.unionByName(ticks), horizons


def apply_changes(changes: DataFrame, batches: int = 12, first_day: int = 19723, days: int = 160, patience: int = 3, buckets: int | None = None) -> DataFrame:
    """One row for each change that takes part: change_id, client_id, status, batch, missed, city, cents, current.

    Repeated rows count once. A change's number n is the dense rank of its seq among the client's (null first); then rows
    without valid_at or change_id go, and those whose crc32 of change_id is a multiple of 11. ``days`` days from ``first_day`` on are
    cut into ``batches``; earlier ones fall into the first, later ones into the last. A client's changes come by day, then
    change_id (rows that repeat both, by a hash of all columns); a number that is held or done is rejected. The number that
    is due is applied; a held one waits until its day is ``patience`` days behind the latest of the batches before, or for
    the end, which counts as one more batch. Ops other than I, U and D change nothing. A null client_id is a client of its own, and NaN
    balances count as null. An empty table gives an empty result; other columns only tell rows apart. Texts in ``city`` may have any length.

    A bucket's clients are held in a task's memory; by default there are two for each shuffle partition, 32 at least. Each
    call has new folders; a start that fails is repeated from the checkpoint.
    """
    spark = ship(changes.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(32, 2 * parts)
    feed, _ = _feed(changes, batches, first_day, days, buckets)
    home = new_path(spark, "stream")
    dealt = feed.withColumn("feed", F.col("batch")).repartition("feed", F.pmod(F.col("bucket"), F.lit(max(1, -(-parts // batches)))))
    dealt.write.partitionBy("feed").parquet(f"{home}/cut")
    with _state_in_files(spark):
        for b in range(1, batches + 2):
            source, store = _handle(spark, f"{home}/cut/feed={b}")
            store.mkdirs(_handle(spark, f"{home}/in")[0])
            if not store.rename(source, _handle(spark, f"{home}/in/{b}")[0]):
                raise OSError(f"batch {b} could not be handed to the stream")
            stream = spark.readStream.schema(FEED).option("recursiveFileLookup", "true").parquet(f"{home}/in")
            done = stream.groupBy("bucket").applyInPandasWithState(_applied(patience), RESULT, Stored.STATE, "append", GroupStateTimeout.NoTimeout)
            writer = done.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint")
            writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(RESULT).parquet(f"{home}/out")
