"""Repeated strings of a length and longer, found by a distributed difference-cover suffix sort.

Texts are cut into pieces at places that their content sets. Of equal pieces only the first goes on: all strings of
the others start earlier. What is left is sieved: a string of ``length`` bytes has a landmark, the k-gram of the least
hash in it, and where no landmark comes twice no string does. The regions that remain, packed in bundles, are sorted.

The letters of the sort are w bytes, 4 or (beyond 4 GiB) 8; the letter after that of byte x is at x + w. At level k a letter stands
for w * 3**k bytes, and positions whose k-th digit (of x // w, base 3) is 1 or 2 are the sample: their triples of letters are sorted and
named, and the names are the letters of level k + 1. Once names cover ``length`` bytes, or no two are equal, the names are ranks.
Back up, the remaining third of the positions of each level is sorted by (letter, rank of the next) and merged with the
sample; only positions near enough to the start of a whole string for the levels below to ask for their ranks take part. Ranks on top stand for suffixes: neighbours with equal prefixes of ``length`` bytes are repeats.

Spark moves packed arrays: a row holds what a bundle sends to a part of the key range, or gets from it. Parts are cut by
the first two letters; a name counts on from the names of the parts before, so that deeper levels have parts of the same sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialise
from tidewater.llm.wordhash import _BACK, _BASE, _powers, mix, pieces_of
from tidewater.session import ship

LENGTH = 100
#: Rounds of the sieve: the share of a string that a landmark takes, and of how many landmarks one ends a piece.
ROUNDS = [(0.48, 8), (0.95, 4)]
#: Starts of a piece at most.
MOST_STARTS = 4096
#: Bytes that are looked at together, few enough for the processor's cache, and of a long text.
SECTION, LONG = 1 << 16, 1 << 18
#: Bytes of a bundle, and places of a part of the key range; a longer region is a bundle of its own.
BUNDLE = 1 << 19
#: Prefixes that are sampled to cut the key range; they only set how even the parts are.
SAMPLED = 1_000_000

_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9FB21C651E98DF25))
_power: list[np.ndarray] = []


def _window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on; the same wherever the bytes stand."""
    n = len(raw)
    if n < width:
        return np.zeros(0, _U)
    if not _power or len(_power[0]) < n:
        size = 1 << (n - 1).bit_length()
        _power[:] = [_powers(_BASE, size), _powers(_BACK, size)]
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[raw] * _power[0][:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _power[1][: n - width + 1])


def _least_of(key: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` values in a row."""
    have, out = 1, key
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(key) - width + 1], out[width - have :])


class Cut:
    """The pieces and landmarks of some texts: runs of starts of strings of ``length`` bytes whose least gram is the same."""

    def __init__(self, raw: np.ndarray, edge: np.ndarray, length: int, gram: int, every: int) -> None:
        n = len(raw) - length + 1
        self.run_at = self.run_end = self.run_pos = self.piece_at = self.piece_end = np.zeros(0, np.int64)
        self.run_v, self.tied, self.runs_to = np.zeros(0, _U), np.zeros(0, bool), np.zeros(1, np.int64)
        if n <= 0:
            return
        valid = np.ones(n + 1, bool)
        for e in edge[1:].tolist():
            valid[max(e - length + 1, 0) : e] = False
        valid[n] = False
        value = _window_hashes(raw, gram)
        place = _U((1 << len(raw).bit_length()) - 1)
        key = value & ~place
        key |= np.arange(len(value), dtype=_U)
        at = (_least_of(key, length - gram + 1) & place).astype(np.int64)
        opens = valid[:-1].copy()
        opens[1:] &= ~valid[:-2]
        some = opens.copy()
        some[1:] |= at[1:] != at[:-1]
        some = np.flatnonzero(some & valid[:-1])  # where the landmark is another one
        if not len(some):
            return
        ends = np.flatnonzero(valid[:-1] & ~valid[1:]) + 1
        pos = at[some]
        v = value[pos]
        run = opens[some]
        run[1:] |= v[1:] != v[:-1]  # one that has the same bytes goes with the one before
        cut = opens[some] | (run & (v % _U(every) == 0))
        first = some[cut]
        last = np.minimum(np.append(first[1:], len(raw)), ends[np.searchsorted(ends, first, "right")])
        long = last - first > MOST_STARTS
        if long.any():
            more = np.concatenate([np.arange(a + MOST_STARTS, b, MOST_STARTS) for a, b in zip(first[long], last[long], strict=True)])
            every_place = np.union1d(some, more)
            known = np.searchsorted(some, every_place, "right") - 1
            added = np.isin(every_place, more)
            some, pos, v, run, cut = every_place, pos[known], v[known], run[known] | added, cut[known] | added
            first = some[cut]
            last = np.minimum(np.append(first[1:], len(raw)), ends[np.searchsorted(ends, first, "right")])
        runs = np.flatnonzero(run)
        self.run_at, self.run_pos, self.run_v = some[runs], pos[runs], v[runs]
        self.run_end = np.minimum(np.append(self.run_at[1:], len(raw)), ends[np.searchsorted(ends, self.run_at, "right")])
        self.tied = np.diff(np.append(runs, len(some))) > 1
        self.piece_at, self.piece_end = first, last
        self.runs_to = np.searchsorted(self.run_at, np.append(first, len(raw)))


#: Landmarks of a piece are packed: the hash, its place and its first start counted from the piece's begin; TIED beside the place.
_PIECES = "row_id long, base long, no_id boolean, doc_id long, begin long, n long, digest binary, v binary, pos binary, lo binary"
TIED = 1 << 15


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values as the bytes of one binary for each range between ends."""
    at = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all binaries of a column, one after another."""
    _, ends, data = column.buffers()
    edge = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edge[0] : edge[-1]].view(kind) if data is not None else np.zeros(0, kind)


def _pieces(texts: DataFrame, length: int, gram: int, every: int) -> DataFrame:
    """A row for each piece: where its starts begin, how many there are, its digest, and its landmarks with their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        for batch in batches:
            held: list[tuple] = []
            count = 0

            def add(raw: np.ndarray, edge: np.ndarray, of: np.ndarray, shift: np.ndarray) -> int:
                cut = Cut(raw, edge, length, gram, every)
                whole = memoryview(raw)
                digests = [xxhash.xxh3_128_digest(whole[a : b + length - 1]) for a, b in zip(cut.piece_at.tolist(), cut.piece_end.tolist(), strict=True)]
                text = np.searchsorted(edge, cut.piece_at, "right") - 1
                back = shift[text] - edge[:-1][text]
                sizes = np.diff(cut.runs_to)
                begin = np.repeat(cut.piece_at, sizes)
                lists = cut.run_v, (cut.run_pos - begin + cut.tied * TIED).astype(np.uint16), (cut.run_at - begin).astype(np.uint16)
                held.append((of[text], cut.piece_at + back, cut.piece_end - cut.piece_at, digests, sizes, *lists))
                return len(digests)

            def packed() -> pa.RecordBatch:
                of, begin, n, digests, sizes, *lists = zip(*held, strict=True)
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                own = [batch.column(i).take(pa.array(np.concatenate(of))) for i in range(4)]
                rest = [_binaries(np.concatenate(x), ends) for x in lists]
                return pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(begin)), pa.array(np.concatenate(n)), pa.array([d for x in digests for d in x], pa.binary()), *rest], names=names)

            done = 0
            bases = batch.column(1).to_numpy()
            for part in pieces_of(batch, 4, SECTION):
                column, here = part.column(4), np.arange(done, done + part.num_rows)
                done += part.num_rows
                _, ends, data = column.buffers()
                edge = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
                if len(raw) > LONG:  # sections of one text overlap by a string
                    for begin in range(0, len(raw) - length + 1, LONG):
                        section = raw[begin : begin + LONG + length - 1]
                        count += add(section, np.array([0, len(section)]), here, bases[here] + begin)
                else:
                    count += add(raw, edge - edge[0], here, bases[here])
                if count > 50_000:
                    yield packed()
                    held.clear()
                    count = 0
            if held:
                yield packed()

    return texts.select("row_id", "base", "no_id", "doc_id", "text").mapInArrow(run, _PIECES)


def _regions(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bytes of the starts that landmarks leave open, as texts of their own: row_id, base, no_id, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 4, SECTION * 4):
                of, begins, out = [], [], []
                for i, base in enumerate(part.column(1).to_pylist()):
                    text = memoryview(part.column(4)[i].as_buffer())
                    flat = part.column(5)[i].values
                    a, b = joined(flat.field(0).to_numpy(), flat.field(1).to_numpy(), 1)
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        of.append(i)
                        begins.append(x)
                        out.append(text[x - base : y - base + length - 1])
                own = [part.column(j).take(pa.array(of, pa.int64())) for j in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(begins, pa.int64()), *own[1:], pa.array(out, pa.binary())], names=["row_id", "base", "no_id", "doc_id", "text"])

    rows = texts.join(found, ["row_id", "base"]).select("row_id", "base", "no_id", "doc_id", "text", "starts")
    return rows.mapInArrow(run, "row_id long, base long, no_id boolean, doc_id long, text binary")


def _twice(stays: DataFrame, parts: int) -> DataFrame:
    """(row_id, base, lo, hi): starts whose landmark comes at two places; landmarks meet by their hash, packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, pos, lo = _values(batch.column(4), _U), _values(batch.column(5), np.uint16).astype(np.int64), _values(batch.column(6), np.uint16).astype(np.int64)
            sizes = np.array(pc.binary_length(batch.column(4)), np.int64) // 8
            row, base, begin, n = (np.repeat(batch.column(i).to_numpy(), sizes) for i in range(4))
            last = np.append(row[1:] != row[:-1], True) | np.append(begin[1:] != begin[:-1], True) if len(row) else np.zeros(0, bool)
            hi = np.where(last, n, np.append(lo[1:], 0)[: len(lo)])
            part = (mix(v) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = np.searchsorted(part[order], np.arange(parts + 1))
            told = [v, row, base.astype(np.int64), begin + (pos & (TIED - 1)), begin + lo, (hi - lo).astype(np.uint16), pos >= TIED]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), *(_binaries(x[order], first) for x in told)], names=["part", *"abcdefg"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v, row, base, pos, lo, size, tied = (_values(table.column(c).chunk(0), k) for c, k in zip("abcdefg", (_U, np.int64, np.int64, np.int64, np.int64, np.uint16, bool), strict=True))
        order = np.argsort(v, kind="stable")
        same = _same_as_before(v[order])
        group = np.cumsum(~same) - 1
        at = np.flatnonzero(~same)
        apart = np.zeros(len(at), bool)
        for x in (row[order], pos[order]):
            apart |= np.minimum.reduceat(x, at) != np.maximum.reduceat(x, at) if len(at) else apart
        open_ = tied.copy()
        open_[order] |= apart[group]
        return pa.table({"row_id": row[open_], "base": base[open_], "lo": lo[open_], "hi": lo[open_] + size[open_]})

    sent = stays.select("row_id", "base", "begin", "n", "v", "pos", "lo").mapInArrow(send, "part long, a binary, b binary, c binary, d binary, e binary, f binary, g binary")
    return sent.filter("length(a) > 0").groupBy("part").applyInArrow(meet, "row_id long, base long, lo long, hi long")


def _sieve(texts: DataFrame, length: int, gram: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Ranges (row_id, a, b) of starts in pieces that come earlier, too, and the regions where strings may still come twice."""
    pieces = materialise(_pieces(texts, length, gram, every), "pieces")
    order = F.struct("no_id", "doc_id", "row_id", "begin")
    slim = pieces.select("digest", "no_id", "doc_id", "row_id", "begin", "n")
    first = slim.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    later = slim.join(first, "digest").filter(F.col("first") != order)
    copies = materialise(later.select("row_id", F.col("begin").alias("a"), (F.col("begin") + F.col("n")).alias("b")), "copies")
    stays = pieces.join(copies.select("row_id", F.col("a").alias("begin")), ["row_id", "begin"], "left_anti")
    marks = pieces.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0] // 8
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) if marks > 1 << 16 else 1, marks // BUNDLE)
    found = materialise(_twice(stays, parts).groupBy("row_id", "base").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "open")
    discard(pieces)
    regions = materialise(_regions(texts, found, length), "regions", compression="zstd")
    discard(found)
    return copies, regions


def joined(a: np.ndarray, b: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [a, b) with those less than ``gap`` apart joined."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(a) else b
    opens = np.ones(len(a), bool)
    opens[1:] = a[1:] >= b[:-1] + gap
    at = np.flatnonzero(opens)
    return a[at], b[np.append(at[1:], len(a)) - 1] if len(a) else b


def _bundled(regions: DataFrame) -> DataFrame:
    """Regions packed in the order of their documents: bundle, rows, begins, sizes, bytes; bundles are numbered in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId()) << 16
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            rows, begins, texts = zip(*held, strict=True)
            sizes = [len(t) for t in texts]
            blobs = [np.array(x, np.int64).tobytes() for x in (rows, begins, sizes)]
            return pa.RecordBatch.from_pylist([{"bundle": number, "rows": blobs[0], "begins": blobs[1], "sizes": blobs[2], "bytes": b"".join(texts)}])

        for batch in batches:
            for row, begin, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                if held and size + len(data) > BUNDLE:
                    yield packed()
                    number, held, size = number + 1, [], 0
                held.append((row, begin, data))
                size += len(data)
        if held:
            yield packed()

    order = ["no_id", "doc_id", "row_id", "base"]
    return regions.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "bundle long, rows binary, begins binary, sizes binary, bytes binary")


class Bundle:
    """The places of a bundle: bytes of its regions one after another, nothing beyond the end of a region."""

    def __init__(self, sizes: bytes, width: int) -> None:
        self.width = width
        self.sizes = np.frombuffer(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.n = int(self.ends[-1])
        self.within = np.arange(self.n) - np.repeat(self.ends - self.sizes, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.within

    def digit(self, level: int) -> np.ndarray:
        return self.within // (self.width * 3**level) % 3

    def after(self, values: np.ndarray, step: int) -> np.ndarray:
        """The value ``step`` places on, 0 beyond the region."""
        out = np.zeros(self.n, values.dtype)
        out[: max(self.n - step, 0)] = values[step:]
        out[self.left <= step] = 0
        return out

    def letters(self, raw: np.ndarray) -> np.ndarray:
        """The bytes from each place on as big-endian numbers, filled up with 0."""
        out = raw.astype(np.uint32 if self.width == 4 else _U)
        have = 1
        while have < self.width:
            out = (out << out.dtype.type(8 * have)) | self.after(out, have)
            have *= 2
        return out

    def placed(self, table: pa.Table, kind: int, before: list[int]) -> np.ndarray:
        """What the parts of the key range have said of this bundle's places; ``before``: how many names there are ahead of each part."""
        out = np.zeros(self.n, _name_type(before))
        for k, part, x, value in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "a", "b")), strict=True):
            if k == kind:
                value = np.frombuffer(value, np.uint32)
                out[_undone(x, len(value))] = value + out.dtype.type(before[part])
        return out


def _name_type(before: list[int]) -> type:
    return np.uint32 if before[-1] < 1 << 32 else np.uint64


def _steps(x: np.ndarray) -> bytes:
    """Ascending places as differences, in 2 bytes each where they fit."""
    step = np.diff(x, prepend=0)
    return step.astype(np.uint16 if len(x) and step.max() < 1 << 16 else np.uint32).tobytes()


def _undone(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32), dtype=np.int64)


_SENT = "part long, bundle long, x binary, keys binary, more binary"
_SAID = "part long, bundle long, a binary, b binary, names long, ties long"


def _sent(bundle: int, part: np.ndarray, x: np.ndarray, keys: list[np.ndarray], more: np.ndarray) -> list[dict]:
    """A row for each part of the key range that places of a bundle go to."""
    order = np.argsort(part, kind="stable")
    part, x, more = part[order], x[order], more[order]
    keys = [k[order] for k in keys]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(at, np.append(at[1:], len(part)), strict=True):
        out.append({"part": int(part[a]), "bundle": bundle, "x": _steps(x[a:b]), "keys": b"".join(k[a:b].tobytes() for k in keys), "more": more[a:b].tobytes()})
    return out


def _received(table: pa.Table, kinds: list[type]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The places of all bundles that came to a part: bundles, how many of each, places, keys, and the byte beside."""
    more = [np.frombuffer(m, np.uint8) for m in table.column("more").to_pylist()]
    sizes = np.array([len(m) for m in more])
    xs = [_undone(x, n) for x, n in zip(table.column("x").to_pylist(), sizes, strict=True)]
    keys: list[list] = [[] for _ in kinds]
    for data, n in zip(table.column("keys").to_pylist(), sizes, strict=True):
        at = 0
        for j, kind in enumerate(kinds):
            keys[j].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return table.column("bundle").to_numpy(), sizes, np.concatenate(xs), [np.concatenate(k) for k in keys], np.concatenate(more)


def _answers(table: pa.Table, bundles: np.ndarray, sizes: np.ndarray, x: np.ndarray, value: np.ndarray, names: int, ties: int) -> pa.Table:
    at = np.cumsum(sizes) - sizes
    part = table.column("part")[0].as_py()
    rows = [
        {"part": part, "bundle": int(b), "a": _steps(x[a : a + n]), "b": value[a : a + n].tobytes(), "names": 0 if i else names, "ties": 0 if i else ties}
        for i, (b, a, n) in enumerate(zip(bundles, at, sizes, strict=True))
    ]
    kinds = {"part": pa.int64(), "bundle": pa.int64(), "a": pa.binary(), "b": pa.binary(), "names": pa.int64(), "ties": pa.int64()}
    return pa.Table.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _named(kinds: list[type]):
    def run(table: pa.Table) -> pa.Table:
        """Names of the triples of a part, in their order; equal ones have one name."""
        bundles, sizes, x, keys, _ = _received(table, kinds)
        order = np.lexsort(keys[::-1])
        same = _same_as_before(*[k[order] for k in keys])
        name = np.empty(len(x), np.uint32)
        name[order] = np.cumsum(~same)
        return _answers(table, bundles, sizes, x, name, int((~same).sum()), int(same.sum()))

    return run


def _less(of: list[np.ndarray], than: list[np.ndarray]) -> np.ndarray:
    """How many of ``of`` come before each of ``than``, by all keys; equal ones come first."""
    n = len(of[0])
    order = np.lexsort([np.concatenate([a, b]) for a, b in zip(of[::-1], than[::-1], strict=True)])
    before = np.cumsum(order < n)
    out = np.empty(len(than[0]), np.int64)
    theirs = order >= n
    out[order[theirs] - n] = before[theirs]
    return out


def merged(digit: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """The order of the places of a level: the sample by rank, the rest by (letter, rank of the next), merged.

    Keys are the letter, the next letter (not of digit 1), a rank and another: of a place of digit 0 the ranks of the next place and of the one
    after; of digit 1 the rank of the next place, of digit 2 of the one after, then the own rank. Places that agree as
    far as ranks go may come in any order.
    """
    letter, after, rank, other = keys
    rest, one, two = (np.flatnonzero(digit == d) for d in range(3))
    rest = rest[np.lexsort((rank[rest], letter[rest]))]
    sample = np.flatnonzero(digit > 0)
    sample = sample[np.argsort(other[sample], kind="stable")]
    ahead = _less([letter[one], rank[one]], [letter[rest], rank[rest]])
    ahead = np.maximum.accumulate(ahead) if len(ahead) else ahead
    more = _less([letter[two], after[two], rank[two]], [letter[rest], after[rest], other[rest]])
    ahead = ahead + (np.maximum.accumulate(more) if len(more) else more)
    place = np.arange(len(rest)) + ahead
    out = np.empty(len(digit), np.int64)
    taken = np.zeros(len(digit), bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = sample
    return out


def _ranked(kinds: list[type]):
    def run(table: pa.Table) -> pa.Table:
        """Ranks of the places of a level that came to a part."""
        bundles, sizes, x, keys, digit = _received(table, kinds)
        rank = np.empty(len(x), np.uint32)
        rank[merged(digit, keys)] = np.arange(1, len(x) + 1)
        return _answers(table, bundles, sizes, x, rank, len(x), 0)

    return run


def _repeated(kinds: list[type]):
    def run(table: pa.Table) -> pa.Table:
        """The places of a part whose string stands earlier, too: neighbours in the order of all suffixes are compared."""
        bundles, sizes, x, keys, digit = _received(table, kinds)
        order = merged(digit, keys[:4])
        place = np.repeat(bundles.astype(_U) << _U(32), sizes) | x.astype(_U)
        same = _same_as_before(keys[0][order], keys[4][order])
        group = np.cumsum(~same) - 1
        first = np.minimum.reduceat(place[order], np.flatnonzero(~same))
        gone = np.empty(len(x), bool)
        gone[order] = place[order] != first[group]
        kept = np.add.reduceat(gone, np.cumsum(sizes) - sizes, dtype=np.int64)
        has = kept > 0
        return _answers(table, bundles[has], kept[has], x[gone], np.zeros(int(gone.sum()), np.uint32), 0, 0)

    return run


def _prefixes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two letters as one value that numpy can search."""
    size = first.dtype.itemsize
    return np.stack([first, second], 1).astype(f">u{size}").reshape(-1).view(f"S{2 * size}")


def _own(bundles: DataFrame, whole: bool) -> DataFrame:
    """The bundles themselves, with their bytes or only the sizes of their regions."""
    data = F.col("bytes") if whole else F.lit(None).cast("binary")
    return bundles.select("bundle", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), F.col("sizes").alias("a"), data.alias("b"))


def _repeats(bundles: DataFrame, length: int, n: int, parts: int) -> DataFrame:
    """(bundle, a): places whose string of ``length`` bytes stands earlier in some bundle."""
    spark = bundles.sparkSession
    count = bundles.count()
    each = max(1, min(SAMPLED, 200 * parts) // max(count, 1))
    width = 4 if n < 1 << 32 else 8

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b = Bundle(sizes, width)
                letters = b.letters(np.frombuffer(data, np.uint8))
                at = np.sort(mix(np.arange(number * 7919 + 1, number * 7919 + 1 + each, dtype=_U)) % _U(b.n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(_prefixes(letters[at], b.after(letters, width)[at])), pa.binary())], names=["prefix"])

    prefixes = np.sort(np.array([r["prefix"] for r in bundles.select("bundle", "sizes", "bytes").mapInArrow(sample, "prefix binary").collect()], f"S{2 * width}"))
    splits = prefixes[np.arange(1, parts) * len(prefixes) // parts] if len(prefixes) else prefixes

    def part_of(level: int, letter: np.ndarray, after: np.ndarray) -> np.ndarray:
        if level == 0:
            return np.searchsorted(splits, _prefixes(letter, after), "right")
        return np.searchsorted(np.array(ahead[level][1:-1], np.int64), letter.astype(np.int64), "left")

    def level_of(table: pa.Table, level: int) -> tuple[int, Bundle, np.ndarray, np.ndarray, np.ndarray]:
        """The bundle with its letters at a level, where the level has places, and its bytes."""
        own = table.column("kind").to_pylist().index(0)
        b = Bundle(table.column("a")[own].as_py(), width)
        raw = np.frombuffer(table.column("b")[own].as_py() or b"", np.uint8)
        letters = b.placed(table, 1, ahead[level]) if level else b.letters(raw)
        there = letters > 0 if level else np.ones(b.n, bool)
        return table.column("bundle")[0].as_py(), b, letters, there, raw

    sent = pa.schema([("part", pa.int64()), ("bundle", pa.int64()), ("x", pa.binary()), ("keys", pa.binary()), ("more", pa.binary())])

    def triples(level: int):
        def run(table: pa.Table) -> pa.Table:
            number, b, letters, there, _ = level_of(table, level)
            x = np.flatnonzero(there & (b.digit(level) > 0))
            step = width * 3**level
            keys = [letters[x], b.after(letters, step)[x], b.after(letters, 2 * step)[x]]
            return pa.Table.from_pylist(_sent(number, part_of(level, keys[0], keys[1]), x, keys, np.zeros(len(x), np.uint8)), schema=sent)

        return run

    def for_merge(level: int, before: list[int]):
        def run(table: pa.Table) -> pa.Table:
            number, b, letters, there, raw = level_of(table, level)
            rank = b.placed(table, 2, before)
            step = width * 3**level
            digit = b.digit(level).astype(np.uint8)
            next_, second = b.after(rank, step), b.after(rank, 2 * step)
            after = b.after(letters, step)
            keys = [letters, np.where(digit == 1, after.dtype.type(0), after), np.where(digit == 2, second, next_), np.where(digit == 0, second, rank)]
            if level == 0:
                hashes = np.zeros(b.n, _U)
                whole = _window_hashes(raw, length)
                hashes[: len(whole)] = whole
                keys.append(hashes)
            # Below, strings start where ``length`` bytes are left, and each level asks for ranks at most two steps on: no others are made.
            x = np.flatnonzero(there & (b.left >= length - width * (3**level - 1)))
            keys = [k[x] for k in keys]
            return pa.Table.from_pylist(_sent(number, part_of(level, keys[0], after[x]), x, keys, digit[x]), schema=sent)

        return run

    def alone(run):
        """The same for bundles that need nothing from elsewhere: they stay where they are."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):  # a bundle at a time
                    yield from run(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

        return each

    def said(table: DataFrame, kind: int) -> DataFrame:
        return table.select("bundle", F.lit(kind).alias("kind"), "part", "a", "b")

    def counted(table: DataFrame) -> tuple[list[int], int]:
        """How many names there are ahead of each part, one number a part, and how many equal triples there were."""
        told = {r["part"]: r for r in table.groupBy("part").agg(F.sum("names").alias("names"), F.sum("ties").alias("ties")).collect()}
        before = [0]
        for p in range(parts):
            before.append(before[-1] + (told[p]["names"] if p in told else 0))
        return before, sum(r["ties"] for r in told.values())

    names: list[DataFrame] = []
    ahead: list[list[int]] = [[]]
    letter = kind = np.uint32 if width == 4 else _U
    level = 0
    while width * 3**level < length:
        if level:
            moved = _own(bundles, False).unionByName(said(names[-1], 1)).groupBy("bundle").applyInArrow(triples(level), _SENT)
        else:
            moved = _own(bundles, True).mapInArrow(alone(triples(0)), _SENT)
        named = moved.groupBy("part").applyInArrow(_named([kind] * 3), _SAID)
        names.append(materialise(named, "names"))
        level += 1
        before, ties = counted(names[-1])
        ahead.append(before)
        kind = _name_type(before)
        if not ties:  # all names differ: they are ranks
            break
    rank = names[-1]
    for at in range(level - 1, -1, -1):
        source = _own(bundles, at == 0).unionByName(said(rank, 2))
        source = source.unionByName(said(names[at - 1], 1)) if at else source
        letters, ranks = _name_type(ahead[at]) if at else letter, _name_type(before)
        moved = source.groupBy("bundle").applyInArrow(for_merge(at, before), _SENT).groupBy("part")
        done = moved.applyInArrow(_ranked([letters, letters, ranks, ranks]) if at else _repeated([letters, letters, ranks, ranks, _U]), _SAID)
        spent, rank = [rank, *names[at - 1 : at]] if at else [rank], materialise(done, "ranks")
        discard(*spent)
        before, _ = counted(rank) if at else (before, 0)
    return rank


def _starts_of(bundles: DataFrame, repeats: DataFrame) -> DataFrame:
    """(row_id, a, b): ranges of starts in the documents, from places in the bundles."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        own = kinds.index(0)
        sizes = np.frombuffer(table.column("c")[own].as_py(), np.int64)
        rows, begins = (np.frombuffer(table.column(c)[own].as_py(), np.int64) for c in ("a", "b"))
        marks = [_undone(x, len(y) // 4) for k, x, y in zip(kinds, table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True) if k]
        x = np.sort(np.concatenate([np.zeros(0, np.int64), *marks]))
        ends = np.cumsum(sizes)
        region = np.searchsorted(ends, x, "right")
        opens = np.ones(len(x), bool)
        opens[1:] = (x[1:] != x[:-1] + 1) | (region[1:] != region[:-1])
        at = np.flatnonzero(opens)
        region = region[at]
        shift = begins[region] - (ends - sizes)[region]
        return pa.table({"row_id": rows[region], "a": x[at] + shift, "b": x[np.append(at[1:], len(x)) - 1] + 1 + shift if len(x) else x})

    meta = bundles.select("bundle", F.lit(0).alias("kind"), F.col("rows").alias("a"), F.col("begins").alias("b"), F.col("sizes").alias("c"))
    marks = repeats.select("bundle", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("c"))
    return meta.unionByName(marks).groupBy("bundle").applyInArrow(run, "row_id long, a long, b long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay), spans.

    Texts are UTF-8 bytes, null counting as empty. A byte goes if a string of ``length`` bytes that covers it starts earlier, too: in a
    row with a smaller doc_id (null ones last, rows with equal ids in the order they are read) or earlier in the same
    text. Strings are judged on the input. ``spans`` are the maximal runs that go, as begin and end. Texts shorter than
    ``length`` stay whole, an empty table gives an empty result, other columns are ignored. Of a very long text 256 KiB are looked at
    together; its bytes and the regions that it shares are held whole. Strings are compared by the order of the suffixes, their
    first letter and a 64-bit hash.
    """
    spark = ship(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    ids = F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id")
    held = materialise(docs.select(*ids, text), "texts", compression="zstd")
    texts, copies = held.withColumn("base", F.lit(0).cast("long")), []
    for share, every in ROUNDS:
        done, regions = _sieve(texts, length, max(1, int(length * share)), every)
        copies.append(done)
        if len(copies) > 1:
            discard(texts)
        texts = regions
    bundles = materialise(_bundled(texts), "bundles", compression="zstd")
    discard(texts)
    n = bundles.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    gone = copies[0]
    for more in copies[1:]:
        gone = gone.unionByName(more)
    if n:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(-(-n // BUNDLE), min(2 * tasks, -(-n // 65_536)))
        gone = gone.unionByName(_starts_of(bundles, _repeats(bundles, length, n, parts)))
    ranges = gone.groupBy("row_id").agg(F.collect_list(F.struct("a", "b")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, SECTION * 16):
                rows = []
                for i in range(part.num_rows):
                    data = memoryview(part.column(1)[i].as_buffer())
                    starts = part.column(2)[i]
                    spans: list[list[int]] = []
                    if starts.is_valid:
                        spans = np.stack(joined(starts.values.field(0).to_numpy(), starts.values.field(1).to_numpy() + length - 1, 1), 1).tolist()
                    at, kept = 0, []
                    for a, b in spans:
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                    whole = b"".join(kept)
                    rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(whole).hexdigest(), whole, spans))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    rows = held.join(ranges, "row_id", "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
