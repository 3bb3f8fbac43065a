"""Suffix sort, change applier and ranked search against plain Python."""

import datetime
import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tidewater.llm import changes, ranked, suffixes

# ---- repeated strings


def plain_repeats(rows, length):
    """rows: (doc_id, text) in the order in which they are read."""
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        kept = bytes(c for c, x in zip(data, gone, strict=True) if not x)
        spans = sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1]))
        out.append((rows[i][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(df, length):
    found = suffixes.remove_repeats(df, length).collect()
    for r in found:
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=str)


def texts_with_repeats():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 60)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages)[rng.randrange(20) :], word()]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[7][1]), (101, rows[7][1][:60] + "X" + rows[7][1][61:]), (3, rows[3][1]), (None, rows[9][1]), (None, None), (102, ""), (103, "short")]
    rows += [(110, "=" * 9000), (111, "ab" * 700 + "=" * 300), (112, "\0" * 400), (113, "x" * 99 + "\0" * 50)]
    return rows


@pytest.mark.parametrize("length", [100, 23])
def test_repeats_equal_plain_python(spark, length):
    rows = texts_with_repeats()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kept string").coalesce(1)
    assert repeats(df, length) == plain_repeats(rows, length)


def test_a_long_text_is_cut_in_sections(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, base), (2, base[1000:299_000] + "tail"), (3, "HEAD" + base[150_000:150_400])]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    assert [(g[0], g[2], g[3]) for g in got] == [(1, 0, 0), (2, 298_000, 1), (3, 400, 1)]


def test_repeats_of_an_empty_table(empty):
    assert suffixes.remove_repeats(empty).count() == 0


def test_merge_gives_the_order_of_suffixes():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    true = sorted(range(400), key=lambda i: text[i:])
    rank = np.empty(400, np.int64)
    rank[true] = np.arange(1, 401)
    at = lambda a, k: np.concatenate([a[k:], np.zeros(k, a.dtype)])
    letter = np.frombuffer(text, np.uint8).astype(np.int64)
    digit = np.arange(400) % 3
    sample = np.where(digit > 0, rank, 0)
    keys = [letter, at(letter, 1), np.where(digit == 2, at(sample, 2), at(sample, 1)), np.where(digit == 0, at(sample, 2), sample)]
    assert suffixes.merged(digit, keys).tolist() == true


# ---- changes


def plain_changes(rows, batches=12, first_day=19723, days=160, patience=3):
    """rows: distinct (change_id, client_id, seq, op, valid_at, city, balance)."""
    rank = {}
    for c in {r[1] for r in rows}:
        rank[c] = {s: i + 1 for i, s in enumerate(sorted({r[2] for r in rows if r[1] == c}))}
    feed = defaultdict(list)
    for cid, client, seq, op, at, city, balance in rows:
        if at is None or (h := zlib.crc32(str(cid).encode())) % 11 == 0:
            continue
        day = (at.date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
        feed[min(batches, 1 + (day - first_day) * batches // days)].append((day, cid, client, rank[client][seq], op, city, balance))
    follows, held, state, last, out, latest = defaultdict(lambda: 1), defaultdict(dict), defaultdict(lambda: [None, None]), {}, [], None

    def apply(c, batch, missed):
        while follows[c] in held[c]:
            _, cid, _, _, op, city, balance = held[c].pop(follows[c])
            now = state[c]
            if op == "D":
                now[:] = [None, None]
            elif op in "IU":
                now[0] = city if op == "I" or city is not None else now[0]
                now[1] = balance if op == "I" or balance is not None else now[1]
            follows[c] += 1
            last[c] = len(out)
            out.append([cid, c, "applied", batch, missed, now[0], None if now[1] is None else math.floor(100 * now[1] + 0.5), op != "D"])
            missed = 0

    for b in range(1, batches + 2):
        for c in list(held):
            while held[c] and (b > batches or (latest is not None and min(r[0] for r in held[c].values()) + patience <= latest)):
                least = min(held[c])
                missed, follows[c] = least - follows[c], least
                apply(c, b, missed)
        for r in sorted(feed.get(b, []), key=lambda r: r[:2]):
            if r[3] in held[r[2]] or r[3] < follows[r[2]]:
                out.append([r[1], r[2], "rejected", b, 0, None, None, False])
            else:
                held[r[2]][r[3]] = r
                apply(r[2], b, 0)
        latest = max([*([] if latest is None else [latest]), *(r[0] for r in feed.get(b, []))], default=None)
    for i, o in enumerate(out):
        o[7] = o[7] and last.get(o[1]) == i
    return sorted(map(tuple, out), key=str)


def some_changes(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.05 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(120), hours=rng.randrange(24))
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None, *range(4, 30)]), rng.randrange(1, 40), rng.choice("IUUUUD"), at, rng.choice([None, "x", "y", "z"]), rng.choice([None, 1.005, -2.5, 70.25])))
    return rows


class FakeMap(dict):
    def iterator(self):
        return iter(list(self.items()))

    updateValue, removeKey = dict.__setitem__, dict.pop


@pytest.mark.parametrize("seed", range(6))
def test_a_bucket_equals_a_plain_loop(seed):
    rows = some_changes(400, seed)
    want = plain_changes(rows)
    one = changes.Applier(3)
    one.state = FakeMap()
    feed = defaultdict(list)
    ranks = {c: {s: i + 1 for i, s in enumerate(sorted({r[2] for r in rows if r[1] == c}))} for c in {r[1] for r in rows}}
    for cid, client, seq, op, at, city, balance in rows:
        h = zlib.crc32(str(cid).encode())
        if at is not None and h % 11:
            day = (at.date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
            feed[min(12, 1 + (day - 19723) * 12 // 160)].append((client, ranks[client][seq], day, cid, op, city, balance))
    got, latest = [], changes.NEVER
    columns = [c.split()[0] for c in changes.FEED.split(", ")]
    for b in range(1, 14):
        taken, lines = set(), [(0, True, False, b, latest if b < 13 else changes.ALWAYS, False, 0, 0, 0, 0, None, None, None)]
        for client, n, day, cid, op, city, balance in sorted(feed[b], key=lambda r: (r[2], r[3])):
            late = (client, n) in taken
            taken.add((client, n))
            lines.append((0, False, late, b, None, client is None, client or 0, n, day, cid, op, city, balance))
            latest = max(latest, day)
        for part in one.handleInputRows((0,), iter([pd.DataFrame(lines, columns=columns)]), None):
            got += [tuple(None if pd.isna(x) else x for x in r) for r in part.itertuples(index=False)]
    assert sorted(got, key=str) == want and not one.state


def test_changes_through_the_stream(spark):
    rows = some_changes(300, 11)
    named = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double, batch string, n int"
    df = spark.createDataFrame([(*r, "b", 1) for r in rows + rows[:40]], named)
    got = changes.apply_changes(df, batches=3).select("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current").collect()
    assert sorted(map(tuple, got), key=str) == plain_changes(rows, batches=3)
    assert changes.apply_changes(df.limit(0), batches=1, buckets=2).count() == 0


class FakeGroup:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None


def test_a_bucket_s_state_comes_back_as_it_was():
    held = {(False, 3, 2): (19800, 7, "U", None, 1.005, None, None, None), (True, 0, 0): (None, 8, "I", "é", None, 4, 2, 9)}
    group = FakeGroup()
    changes.Stored(held).into(group)
    assert dict(changes.Stored.of(group)) == held
    changes.Stored().into(group)
    assert not group.exists and not changes.Stored.of(group)


def test_a_stream_leaves_no_native_store_behind(spark):
    """Each opening of a RocksDB store keeps half a MB of native memory, and every start opens all partitions."""
    was = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    rows = [(i, i % 3, i, "I", datetime.datetime(2024, 1, 1 + i), "x", 1.0) for i in range(20)]
    made = []
    path = changes.new_path
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(changes, "new_path", lambda *a: made.append(path(*a)) or made[-1])
        changes.apply_changes(spark.createDataFrame(rows, "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double"), batches=2)
    names = {f.suffix for f in pathlib.Path(made[-1].removeprefix("file://"), "checkpoint", "state").rglob("[0-9]*.*")}
    assert ".delta" in names and not names & {".zip", ".changelog"}
    assert was == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None))


def test_dense_ranks_over_parts(spark):
    pairs = [(c, s) for c in (None, 1, 2) for s in (None, *range(0, 90, 3))]
    got = {(r[0], r[1]): r[2] for r in changes._numbered(spark.createDataFrame(pairs, "client_id long, seq long")).collect()}
    assert got == {(c, s): i + 1 for c in (None, 1, 2) for i, s in enumerate((None, *range(0, 90, 3)))}


# ---- search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, n_all = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for (d, bag), n in zip(bags, lengths, strict=True):
            m = 10 + 90 * n * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in wanted if t in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if b else d, -s) for r, (s, b, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"part_postings": 50, "block_terms": 20}])
def test_search_equals_plain_python(spark, docs, rows, sizes):
    items = [(1, rows[3][1]), (2, "W1 w2 w2 w3 nowhere"), (2, "w390"), (3, None), (4, ""), (5, "é ß 漢字 😀 mark"), (None, rows[8][1][:200]), (6, "absent only")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string")
    got = ranked.ranked_search(docs, asked, k=4, **sizes).collect()
    assert sorted(map(tuple, got), key=str) == plain_search([(r[0], r[1]) for r in rows], items, 4)


def test_search_stops_early():
    rng = np.random.default_rng(2)
    n = 20_000
    share = np.sort(rng.pareto(1.2, n) * 1000).astype(np.int64)[::-1].copy() + 1
    part = ranked.Part(np.arange(n), np.zeros(n, bool), np.arange(n + 1), np.zeros(n, np.int64), share, 1)
    nothing = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    best = part.search(np.array([0]), np.ones(1, bool), 10, nothing)
    assert best[0].tolist() == share[:10].tolist() and part.accesses < 100


def test_search_of_empty_tables(spark, empty, docs):
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.ranked_search(empty, asked).count() == 0
    assert ranked.ranked_search(docs, asked.limit(0)).count() == 0
