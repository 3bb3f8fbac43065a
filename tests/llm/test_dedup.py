import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidewater.llm import bagminhash, exact_dedup, line_dedup
from tidewater.llm.components import components
from tidewater.llm.wordhash import Words


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    got = exact_dedup.exact_dedup(docs, fan_in_bits=1, rounds=3).collect()
    assert len(got) == len(rows)
    for g in got:
        mine = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == g["text_sha256"])
        best = min(mine, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert (g["keep_id"], g["group_size"]) == (best[0], len(mine))
    assert sum(g["kept"] for g in got) == len(groups)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_of_an_empty_table(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (-5, 159)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[i] == -5 for i in [-5, *range(100, 160)])


def test_near_classes_equal_brute_force(docs, rows):
    bags = [bagminhash.bag(r[1] or "") for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bagminhash.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r[0])
    name = {k: min(v, key=lambda d: (d is None, d or 0)) for k, v in classes.items()}
    want = sorted(((r[0] is None, r[0] or 0), name[find(i)], len(classes[find(i)])) for i, r in enumerate(rows) if name[find(i)] is not None)
    got = bagminhash.near_duplicates(docs).collect()
    assert sorted(((g["doc_id"] is None, g["doc_id"] or 0), g["class_id"], g["class_size"]) for g in got if g["class_id"] is not None) == want
    assert sum(g["kept"] for g in got) == len(classes)


def test_near_of_an_empty_table(empty):
    assert bagminhash.near_duplicates(empty).count() == 0


def test_signature_estimates_weighted_jaccard():
    rng = random.Random(1)
    table = dict(zip(words := [f"{x}{i}".encode() for x in "xy" for i in range(60)], Words(pa.array(words)).hash, strict=True))
    a = [f"x{rng.randrange(60)}".encode() for _ in range(900)]
    b = a[:700] + [f"y{rng.randrange(60)}".encode() for _ in range(200)]
    one = lambda w: np.array([table[x] for x in w], np.uint64)

    true = bagminhash.weighted_jaccard(Counter(a), Counter(b))
    same = (bagminhash.signature(one(a), 4000) == bagminhash.signature(one(b), 4000)).mean()
    assert abs(same - true) < 0.035


def test_signature_does_not_depend_on_order():
    x = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    x = np.concatenate([x, x[:20], x[:5]])
    assert (bagminhash.signature(x, 200) == bagminhash.signature(x[::-1].copy(), 200)).all()


def lines_gone(rows):
    seen, gone = [], defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for place, words in line_dedup.word_lines(r[1] or ""):
            w = set(words)
            if any(len(w & s) / len(w | s) >= 0.8 - 1e-12 for s in seen):
                gone[r[0]].append(place)
            seen.append(w)
    return gone


def test_lines_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    base = [[f"t{rng.randrange(90)}" for _ in range(rng.randrange(1, 25))] for _ in range(60)]
    data = []
    for i in range(50):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            line = list(rng.choice(base))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = f"u{rng.randrange(500)}"
            lines.append(" ".join(line))
        data.append((i, "\n".join(lines), "s"))
    data += [(90, None, "s"), (91, "\n \n", None), (None, data[0][1], "s")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(data, "doc_id long, text string, n int" if False else "doc_id long, text string, words string").write.parquet(path)
    docs = spark.read.parquet(path)
    gone = lines_gone(data)
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {r[0]: gone[r[0]] for r in data}
    left = line_dedup.without_lines(docs, line_dedup.removed_lines(docs))
    assert left.columns == docs.columns
    for r in left.collect():
        text = next(d[1] for d in data if d[0] == r["doc_id"])
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[r["doc_id"]])
        assert r["text"] == want


def test_lines_of_an_empty_table(empty):
    assert line_dedup.line_dedup(empty).count() == 0


def test_prefixes_lose_no_pair():
    for n in range(1, 60):
        for m in range(n, 75):
            need = line_dedup.least_overlap(n, m)
            if need <= n and n / m >= 0.8:  # two sets that can be similar
                assert line_dedup.prefix_length(n) > n - need
                assert line_dedup.prefix_length(m) > m - need


def test_a_group_of_copies_around_a_hidden_base(spark):
    """Copies are like their base but hardly like each other, and the base has the largest id."""
    rng = random.Random(4)
    base = [f"b{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(260):
        copy = list(base)
        for _ in range(1 + i % 6):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows.append((9999, " ".join(base)))
    bags = [bagminhash.bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bagminhash.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    assert 1 < len(set(want.values())) < 150
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 80, 600):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n * 3 // 4], rng.integers(0, 2**63, n // 3).astype(np.uint64), a[:2]])
        from collections import Counter

        ca, cb = Counter(a.tolist()), Counter(b.tolist())
        apart = sum(abs(ca[k] - cb[k]) for k in ca | cb)
        cells = sum(bin(int(x) & (2**64 - 1)).count("1") for x in bagminhash.parity(a) ^ bagminhash.parity(b))
        assert cells <= apart


def test_lines_of_repeated_rows_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    long = [f"v{rng.randrange(10**6)}" for _ in range(30_000)]
    same = "a line of six whole words\n\nand some other line of words here"
    near = list(long)
    near[7] = "changed"
    data = [(5, same), (5, same), (5, same), (2, " ".join(long)), (9, " ".join(near)), (9, "a line of six whole words\nnew"), (None, same), (None, same), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "x", 1, True, "y") for d, t in data], "doc_id long, text string, removed string, n_lines int, _h boolean, _d string")
    got = line_dedup.line_dedup(docs).collect()
    found = sorted((r["doc_id"] or -1, r["n_lines"], r["n_removed"], tuple(r["removed"])) for r in got)
    gone = (2, 2, (0, 2))
    assert found == sorted([(2, 1, 0, ()), (5, 2, 0, ()), (5, *gone), (5, *gone), (9, 1, 1, (0,)), (9, 2, 1, (0,)), (-1, *gone), (-1, *gone), (-1, 0, 0, ()), (-1, 0, 0, ())])
    left = line_dedup.without_lines(docs, line_dedup.removed_lines(docs))
    assert left.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert texts == Counter([(5, same), (5, ""), (5, ""), (2, data[3][1]), (9, ""), (9, "new"), (None, ""), (None, ""), (None, None), (None, None)])


def test_frequent_words_lose_no_line(spark, monkeypatch):
    """With every word frequent, classes meet by the earliest of each word and then by all that is left open."""
    rng = random.Random(12)
    base = [[f"t{rng.randrange(60)}" for _ in range(rng.randrange(4, 20))] for _ in range(12)]
    data = []
    for i in range(120):
        line = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            line[rng.randrange(len(line))] = f"t{rng.randrange(60)}"
        data.append((i, " ".join(line)))
    gone = lines_gone(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for few in (line_dedup.FEW, 0):
        monkeypatch.setattr(line_dedup, "FEW", few)
        assert {r["doc_id"] for r in line_dedup.line_dedup(docs).collect() if r["n_removed"]} == {k for k, v in gone.items() if v}


def test_words_of_a_batch_equal_plain_splitting():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB \n\t\x0b\r\x85é漢") for _ in range(rng.randrange(60))).encode() for _ in range(300)]
    texts += [b"", b" ", b"x" * 200_000 + b" y " + b"Z" * 70_000, b"", b"a"]
    got, known, i = Words(pa.array([b"zz", *texts], pa.binary()).slice(1)), {}, 0
    for t, text in enumerate(texts):
        for k, line in enumerate(text.lower().split(b"\n")):
            for word in line.split():
                assert (got.text[i], got.line[i]) == (t, k) and known.setdefault(word, got.hash[i]) == got.hash[i]
                i += 1
    assert i == len(got.hash) == got.in_text.sum() and len(set(known.values())) == len(known)
    assert not len(Words(pa.array([], pa.binary())).hash) and not len(Words(pa.array([b"", None], pa.binary())).hash)
