import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import lm
from tidewater.llm.queries import tokenizer_path

pytest.importorskip("sentencepiece")
MODEL = tokenizer_path("piece_bpe_32k.model")


def random_model(seed=0, n=300):
    rng = np.random.default_rng(seed)
    classes = lm.Classes(rng.integers(0, 50, n).astype(float))
    weights = {k: (w + rng.standard_normal(w.shape) * 0.3).astype(np.float32) for k, w in lm.start_weights(classes.prior).items()}
    return weights, classes


def test_classes_share_one_probability():
    for counts in (np.zeros(300), np.arange(2000.0), np.r_[np.zeros(1500), 10.0]):
        c = lm.Classes(counts)
        total = np.bincount(c.outputs, weights=np.exp(c.within), minlength=c.size)
        assert np.allclose(total[np.unique(c.outputs)], 1) and c.inputs.max() < lm.INPUTS - 1


def test_attention_is_causal():
    w, _ = random_model()
    a = np.random.default_rng(1).integers(0, 200, (1, lm.WINDOW))
    b = a.copy()
    b[0, 20:] = 5
    x, y = lm.log_classes(w, a, 0), lm.log_classes(w, b, 0)
    assert np.allclose(x[:, :20], y[:, :20], atol=1e-5) and not np.allclose(x[:, 20:], y[:, 20:])
    assert np.allclose(np.exp(x).sum(axis=-1), 1, atol=1e-4)


def test_each_id_is_scored_once():
    w, c = random_model()
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 300, n) for n in (1, 5, 31, 32, 33, 48, 49, 200, 1000)]
    got = lm.Scorer(w, c).scores(texts)
    for ids, score in zip(texts, got, strict=True):
        want = 0.0
        for t, i in enumerate(ids):
            a = 0 if t < lm.WINDOW else (t - lm.WINDOW) // lm.STRIDE * lm.STRIDE + lm.STRIDE
            row = [lm.INPUTS - 1 if p == 0 else c.inputs[ids[p - 1]] for p in range(a, t + 1)]
            row += [0] * (lm.WINDOW - len(row))
            want += lm.log_classes(w, np.array([row]), 0)[0, t - a, c.outputs[i]] + c.within[i]
        assert math.isclose(score, want, rel_tol=1e-3, abs_tol=1e-2)


def test_gradients_equal_differences():
    w, _ = random_model(3)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    rng = np.random.default_rng(4)
    inputs, targets = rng.integers(0, 200, (3, lm.WINDOW)), rng.integers(0, 20, (3, lm.WINDOW))
    mask = (rng.random((3, lm.WINDOW)) < 0.8).astype(np.float64)

    def loss():
        logs = lm.log_classes(w, inputs, 0)
        rows, cols = np.indices(targets.shape, sparse=True)
        return -(logs[rows, cols, targets] * mask).sum() / mask.sum()

    grads = lm.gradients(w, inputs, targets, mask)
    for k, v in w.items():
        for _ in range(4):
            at = (inputs[0, 0], rng.integers(0, lm.WIDTH)) if k == "embed" else tuple(rng.integers(0, s) for s in v.shape)
            old = v[at]
            v[at] = old + 1e-4
            up = loss()
            v[at] = old - 1e-4
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-4, k


def test_small_logits_need_no_shift(monkeypatch):
    """Where a bound tells that nothing overflows, no row is searched for its largest."""
    w, c = random_model(6)
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 300, n) for n in (1, 40, 700)]
    inputs, targets = rng.integers(0, 200, (40, lm.WINDOW)), rng.integers(0, 20, (40, lm.WINDOW))
    mask = np.ones(inputs.shape, np.float32)
    usual = lm._SAFE
    monkeypatch.setattr(lm, "_SAFE", 0.0)
    want, grads = lm.Scorer(w, c).scores(texts), lm.gradients(w, inputs, targets, mask)
    monkeypatch.setattr(lm, "_SAFE", usual)
    monkeypatch.setattr(lm, "_top", lambda x: pytest.fail("a shift that nothing needs"))
    assert np.allclose(lm.Scorer(w, c).scores(texts), want, rtol=1e-5)
    for k, g in lm.gradients(w, inputs, targets, mask).items():
        assert np.allclose(g, grads[k], atol=1e-6), k


def test_large_weights_need_no_shift_while_logits_are_small(monkeypatch):
    """What counts are the values themselves: a product of norms was far above them for trained weights, and every row was shifted."""
    w, c = random_model(6)
    w = w | {"out": np.concatenate([np.full_like(w["out"][:1], 200), w["out"][1:]]), "w2": w["w2"] * [0, *[1] * (lm.WIDTH - 1)]}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    for k in ("embed", "place", "o"):
        w[k][:, 0] = 0
    w["embed"][:, 1], w["out"][1] = 50, 0.01
    w["q"][1], w["k"][1], w["v"][1], w["w1"][1] = 0, 0, 0, 0
    ids = np.random.default_rng(7).integers(0, 300, 700)
    inputs, targets = c.inputs[ids[: 20 * lm.WINDOW].reshape(20, lm.WINDOW)], c.outputs[ids[-20 * lm.WINDOW :].reshape(20, lm.WINDOW)]
    assert np.abs(lm.log_classes(w, inputs, 0)).max() < 40
    monkeypatch.setattr(lm, "_top", lambda x: pytest.fail("a shift that nothing needs"))
    assert np.isfinite(lm.Scorer(w, c).scores([ids])).all()
    assert all(np.isfinite(g).all() for g in lm.gradients(w, inputs, targets, np.ones(inputs.shape, np.float32)).values())


def test_large_logits_are_shifted():
    """Weights that exp can't take unshifted: scores and gradients stay finite, unlikely classes keep their own score."""
    w, c = random_model(8)
    w = w | {"out": w["out"] * 60, "bias": w["bias"] - 200, "q": w["q"] * 90}
    ids = np.random.default_rng(9).integers(0, 300, lm.WINDOW)
    row = np.array([[lm.INPUTS - 1, *c.inputs[ids[:-1]]]])
    logs = lm.log_classes(w, row, 0)[0, np.arange(lm.WINDOW), c.outputs[ids]]
    assert logs.min() < -80
    assert math.isclose(lm.Scorer(w, c).scores([ids])[0], logs.sum() + c.within[ids].sum(), rel_tol=1e-4)
    assert all(np.isfinite(g).all() for g in lm.gradients(w, row, c.outputs[ids][None], np.ones((1, lm.WINDOW), np.float32)).values())


def test_training_learns_an_order():
    counts = np.full(50, 10.0)
    c = lm.Classes(counts)
    start = np.random.default_rng(0).integers(0, 50, 1500)
    rows = (start[:, None] + 3 * np.arange(lm.WINDOW + 1)[None, :]) % 50
    model = lm.Adam(lm.start_weights(c.prior))
    before = lm.Scorer(model.w, c).scores([rows[0]])[0]
    for seed in range(2):
        model.train(c.inputs[rows[:, :-1]], c.outputs[rows[:, 1:]], np.ones((1500, lm.WINDOW), np.float32), seed)
    assert lm.Scorer(model.w, c).scores([rows[0]])[0] > 0.5 * before


def test_base_scores_equal_brute_force(docs, rows):
    got = lm.score(docs, MODEL).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(t for r in rows if not out(r[0]) for t in tokens(r[1]))
    n, v = counts.total(), len(counts)
    want = []
    for r in rows:
        ts = tokens(r[1])
        want.append((str(r[0]), out(r[0]), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)))
    assert sorted((str(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == sorted(want)
    assert all(g["score"] < 0 and math.isfinite(g["score"]) for g in got)


def test_rare_words_meet_their_counts(docs, monkeypatch):
    want = {(r["doc_id"], round(r["base_score"], 6), r["n_known"]) for r in lm.score(docs, MODEL, rounds=1).collect()}
    monkeypatch.setattr(lm, "SENT_WORDS", 3)
    assert {(r["doc_id"], round(r["base_score"], 6), r["n_known"]) for r in lm.score(docs, MODEL, rounds=1).collect()} == want


def test_scores_of_an_empty_table(empty):
    assert lm.score(empty, MODEL).count() == 0


def test_held_out_text_is_better_than_its_shares(spark, tmp_path):
    """Attention beats the same model without training on documents it has not seen."""
    rng = np.random.default_rng(0)
    vocabulary = [f"{a}{b}" for a in ("the", "on", "ver", "sta", "lin") for b in ("er", "ing", "ed", "ow", "al")]
    rows = []
    for i in range(1500):
        at = rng.integers(0, 25)
        rows.append((i, " ".join(vocabulary[(at + 2 * k) % 25] for k in range(200))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trained = {r["doc_id"]: r["score"] for r in lm.score(df, MODEL).filter("held_out").collect()}
    plain = {r["doc_id"]: r["score"] for r in lm.score(df, MODEL, rounds=0).filter("held_out").collect()}
    assert len(trained) > 20 and sum(trained.values()) > 0.9 * sum(plain.values())


def test_ids_tell_the_text():
    own = lm.codec(MODEL)
    said = lm.surfaces(own)
    for text in ("", " a", "a  b ", "\n\té ß 漢字 😀 \\x00", "A,!! WAS.!!\r\n"):
        (ids,) = lm._ids(own, [text])
        assert b"".join(map(said.__getitem__, ids.tolist()))[1:] == text.encode()


def test_every_window_of_the_training_documents_is_trained_on(spark, docs, rows, monkeypatch):
    own = lm.codec(MODEL)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    want = Counter()
    for r in rows:
        if not out(r[0]):
            x = [-1, *lm._ids(own, [r[1] or ""])[0].tolist()]
            for a in range(0, len(x) - 1, lm.WINDOW):
                window = x[a : a + lm.WINDOW + 1]
                want[tuple(window + [-1] * (lm.WINDOW + 1 - len(window)))] += 1
    n = own.sp.get_piece_size()
    gathered = lm.materialise(lm._gather(docs, MODEL), "gathered", by="kind")
    learnt = gathered.filter("kind = 4 AND NOT held_out").select("key")
    for most in (7, lm.RUN_WINDOWS):
        monkeypatch.setattr(lm, "RUN_WINDOWS", most)
        runs = list(lm.runs_of(iter(learnt.toArrow().to_batches()), n))
        assert all(len(x) == most for x in runs[:-1])
        assert Counter(tuple((r.astype(int) - 1).tolist()) for x in runs for r in x) == want
    assert sum(want.values()) > 16 * 20  # a sixteenth would be far from it

    keys = lambda df: Counter(bytes(r["key"]) for r in df.collect())
    for rounds in (1, 3):  # each document has its turn, once
        assert sum((keys(lm._share(gathered, turn, rounds)) for turn in range(rounds)), Counter()) == keys(learnt)


def test_weights_of_the_partitions_are_averaged_by_their_windows(spark):
    """Two partitions train by themselves from the same weights; what ``_fit`` gives equals the mean of plain loops."""
    rng = np.random.default_rng(5)
    n = 200
    rows = [(i, 4, False, rng.integers(0, n, int(k)).astype("<u2").tobytes()) for i, k in enumerate(rng.integers(1, 400, 60))]
    gathered = spark.createDataFrame(rows, "doc_id long, kind int, held_out boolean, key binary").repartition(2)
    classes = lm.Classes(np.arange(1.0, n + 1))
    got = lm._fit(gathered, classes, 1)
    parts = gathered.select(lm.F.spark_partition_id().alias("p"), "key").collect()
    start, sums, total = lm.start_weights(classes.prior), 0, 0
    for p in {r["p"] for r in parts}:
        ids = np.concatenate([lm.cut(np.frombuffer(r["key"], "<u2"), "<u2") for r in parts if r["p"] == p]).astype(int) - 1
        model = lm.Adam(start)
        inputs = np.where(ids[:, :-1] >= 0, classes.inputs[ids[:, :-1]], lm.INPUTS - 1)
        model.train(inputs, classes.outputs[np.maximum(ids[:, 1:], 0)], (ids[:, 1:] >= 0).astype(np.float32), seed=(0, p, 0))
        sums, total = sums + model.flat.astype(float) * len(ids), total + len(ids)
    assert np.allclose(lm.flatten(got), sums / total, atol=1e-5) and not np.allclose(lm.flatten(got), lm.flatten(start), atol=1e-3)


def test_frequent_ids_have_classes_of_their_own():
    counts = np.arange(32_000, 0, -1.0)
    c = lm.Classes(counts)
    sizes = np.bincount(c.outputs)
    assert c.size == 128 and (sizes == 1).sum() == 112 and (c.outputs[:112] == np.arange(112)).all()
    assert np.allclose(c.within[:112], 0)


def test_words_are_those_of_a_plain_split():
    texts = ["", " ", "A b\tÉ a\r\n\x0b\x0cB  ", " x  y\x1cz", "b"]
    keys, which, owner = lm.lower_words(lm.pa.array(texts))
    assert len(set(keys.to_pylist())) == len(keys)
    assert [(int(o), keys[int(i)].as_py()) for i, o in zip(which, owner, strict=True)] == [(k, w) for k, t in enumerate(texts) for w in t.encode().lower().split()]


def test_a_word_of_many_texts_is_segmented_once(monkeypatch):
    own, asked = lm.codec(MODEL), []
    packed = own.id_table.packed
    monkeypatch.setattr(own.id_table, "packed", lambda chunks: asked.extend(chunks) or packed(chunks))
    texts = ["same words again", "same  words ", "", " ", "a▁same words", "same"] * 20
    assert own.ids(texts) == [np.array(own.sp.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for t in texts]
    assert len(asked) == len(set(asked)) > 2


def test_counts_of_batches_that_are_cut(spark):
    """Long texts: a batch goes through in several pieces, the last of which begin inside its buffers."""
    rows = [(i, f"Word{i % 3} again▁ {i} " * 10_000) for i in range(40)]
    got = lm._gather(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), MODEL).toArrow().to_pylist()
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter()
    for r in got:
        counts[bytes(r["key"])] += r["n"] if r["kind"] == 0 else 0
    assert +counts == Counter(w for t in learnt for w in t.encode().lower().split())
    assert {r["doc_id"]: r["text"] for r in got if r["kind"] == 4} == dict(rows)
    assert sum(r["n"] for r in got if r["kind"] == 3) == len(learnt)
