"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy.

One layer of masked attention reads the last 32 subword ids. The next id is drawn in two steps: a class
from the attention layer (each frequent id is a class of its own, the others share classes by
frequency), then the id within its class by its add-one share of the training ids. Counts cover every
id of every training document; the layer is fitted on all their windows, each once, by the tasks that read them: these train
side by side from the same weights, and a distributed sum averages what comes of it, in a few turns. Scoring slides windows of
32 by 16: the first scores all its ids, each later one its last 16, so each id is scored once.

Beside it stands a unigram score over words, whose counts cover all training documents too. A bounded
table of frequent words goes to every task; all other words of a document meet their counts in a join.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialise, spent_shuffles_go
from tidewater.llm.pieces import MARK, codec
from tidewater.llm.wordhash import pieces_of
from tidewater.session import ship

WINDOW, STRIDE = 32, 16
INPUTS, HEADS, TAILS, WIDTH, HIDDEN = 1024, 112, 16, 16, 32
#: Windows that are put in a random order together.
RUN_WINDOWS = 16_384
#: Tasks that add up the weights of a turn.
SUMS = 16
#: Frequent words that are sent to every task, at most.
SENT_WORDS = 131_072
_FLUSH = 500_000


# ---------------------------------------------------------------- the model


class Classes:
    """How ids become inputs and outputs, from the training counts alone."""

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        order = np.lexsort((np.arange(n), -counts))
        self.inputs = np.empty(n, np.int32)  # INPUTS - 1 is the beginning
        self.outputs = np.empty(n, np.int32)
        heads = min(HEADS, n)
        self.outputs[order[:heads]] = np.arange(heads)
        own = min(INPUTS - 1 - TAILS, n)
        self.inputs[order[:own]] = np.arange(own)
        for target, first, base in ((self.outputs, heads, heads), (self.inputs, own, own)):
            rest = order[first:]
            if len(rest):
                share = np.cumsum(counts[rest] + 1.0)
                target[rest] = base + np.minimum(TAILS - 1, (TAILS * (share - 1e-9) / share[-1]).astype(np.int32))
        self.size = heads + TAILS
        total = np.bincount(self.outputs, weights=counts + 1.0, minlength=self.size)
        self.within = np.log(counts + 1.0) - np.log(total[self.outputs])
        self.prior = np.log(np.maximum(total, 1e-9) / total.sum())


def start_weights(prior: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    small = lambda *shape: (rng.standard_normal(shape) * 0.08).astype(np.float32)
    return {
        "embed": small(INPUTS, WIDTH), "place": small(WINDOW, WIDTH), "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, WIDTH),
        "o": small(WIDTH, WIDTH), "w1": small(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": small(HIDDEN, WIDTH),
        "out": np.zeros((WIDTH, len(prior)), np.float32), "bias": prior.astype(np.float32),
    }


def flatten(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, w in like.items():
        out[k] = np.asarray(flat[at : at + w.size], np.float32).reshape(w.shape)
        at += w.size
    return out


_MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), np.float32(0), np.float32(-1e9))


#: A class less likely than exp of this counts as that: far under the rounding of a sum, and its products stay normal numbers.
_LEAST = np.float32(-60)
_CELLS = np.arange(INPUTS * WIDTH).reshape(INPUTS, WIDTH)  # where an input's weights lie
_ONES = np.ones(1024, np.float32)  # a product with it sums rows faster than sum() does
#: Windows at once: few enough that what is made of them stays in the processor's cache.
AT_ONCE = 64


def _top(x: np.ndarray) -> np.ndarray:
    """The largest of each row, kept as an axis; by halves, which numpy does faster than max() on short rows."""
    while x.shape[-1] > 4 and x.shape[-1] % 2 == 0:
        half = x.shape[-1] // 2
        x = np.maximum(x[..., :half], x[..., half:])
    return x.max(axis=-1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= _top(x)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def log_classes(w: dict[str, np.ndarray], inputs: np.ndarray, first: int) -> np.ndarray:
    """Log probabilities of the classes after each place from ``first`` on; inputs is (windows, WINDOW)."""
    x = w["embed"][inputs] + w["place"]
    xq = x[:, first:]
    q = (xq @ w["q"]) * np.float32(WIDTH**-0.5)
    att = q @ (x @ w["k"]).transpose(0, 2, 1)
    att += _MASK[first:]
    z = xq + (_softmax(att) @ (x @ w["v"])) @ w["o"]
    h = z @ w["w1"]
    h += w["b1"]
    np.maximum(h, 0, out=h)
    y = z + h @ w["w2"]
    logits = y @ w["out"]
    logits += w["bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=-1, keepdims=True))
    return logits


#: Exponents that all lie within this of 0 need no shift: nothing overflows, and products of exponentials stay normal numbers.
_SAFE = 60.0
#: Rows of the output layer at once: few enough that their logits stay in the processor's cache.
ROWS = 256


def _fits(x: np.ndarray) -> bool:
    """Whether all of them may be raised without a shift; the two looks cost less than the search of each row for its largest."""
    return bool(-_SAFE < x.min() and x.max() < _SAFE)


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """Of the logits, in place; unless they fit, each row is shifted by its largest first, so that only shares of a row's sum have a meaning."""
    if not _fits(logits):
        logits -= _top(logits)
        np.maximum(logits, _LEAST, out=logits)
    return np.exp(logits, out=logits)


def _with_one(y: np.ndarray) -> np.ndarray:
    """The rows with a 1 behind them, so that a product with weights and biases is one."""
    out = np.empty((len(y), y.shape[1] + 1), y.dtype)
    out[:, :-1], out[:, -1] = y, 1
    return out


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the places where ``mask`` is 1; all places of the windows are rows of one product."""
    kind, scale = w["out"].dtype, w["q"].dtype.type(WIDTH**-0.5)
    windows = lambda rows: rows.reshape(*inputs.shape, -1)
    flat = lambda parts: parts.reshape(-1, parts.shape[-1])
    x = w["embed"].take(inputs, axis=0)
    x += w["place"]
    x = flat(x)
    qkv = np.concatenate([w["q"] * scale, w["k"], w["v"]], axis=1)
    three = lambda parts: (parts[..., :WIDTH], parts[..., WIDTH : 2 * WIDTH], parts[..., 2 * WIDTH :])
    q, k, v = three(windows(x @ qkv))
    a = q @ k.transpose(0, 2, 1)
    fits = _fits(a)
    a += _MASK
    if not fits:
        a -= _top(a)
    np.exp(a, out=a)
    a *= (1 / (flat(a) @ np.ones(WINDOW, kind))).reshape(*inputs.shape, 1)
    c = flat(a @ v)
    z = x + c @ w["o"]
    h = z @ w["w1"]
    h += w["b1"]
    np.maximum(h, 0, out=h)
    y = h @ w["w2"]
    y += z
    share = (mask.ravel() / max(1.0, float(mask.sum()))).astype(kind)
    hit, y1, out = targets.ravel(), _with_one(y), np.concatenate([w["out"], w["bias"][None]])
    ones = np.ones(out.shape[1], kind)
    g_out, dy, back = np.zeros_like(out), np.empty_like(y), np.ascontiguousarray(w["out"].T)
    for at in range(0, len(y), ROWS):
        rows, to = y1[at : at + ROWS], slice(at, at + ROWS)
        p = _exponentials(rows @ out)
        total = p @ ones
        p[np.arange(len(p)), hit[to]] -= total
        each = (share[to] / total)[:, None]  # a row's p counts so much; its few inputs and results are scaled, not its many classes
        g_out += (rows * each).T @ p
        np.matmul(p, back, out=dy[to])
        dy[to] *= each
    g = {"out": g_out[:-1], "bias": g_out[-1]}
    g["w2"] = h.T @ dy
    dh = dy @ w["w2"].T
    dh *= h > 0
    g["w1"], g["b1"] = z.T @ dh, np.ones(len(dh), kind) @ dh
    dz = dh @ w["w1"].T
    dz += dy
    g["o"] = c.T @ dz
    dc = dz @ w["o"].T
    ds = windows(dc) @ v.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dc, c).reshape(*inputs.shape, 1)  # sum of da * a over a row is dc . c
    ds *= a
    d = np.empty((*inputs.shape, 3 * WIDTH), kind)
    dq, dk, dv = three(d)
    np.matmul(ds, k, out=dq)
    np.matmul(ds.transpose(0, 2, 1), q, out=dk)
    np.matmul(a.transpose(0, 2, 1), windows(dc), out=dv)
    d = flat(d)
    g["q"], g["k"], g["v"] = three(x.T @ d)
    g["q"] *= scale  # q holds the scale already, and so does qkv
    dx = dz
    dx += d @ qkv.T
    g["place"] = windows(dx).sum(axis=0)
    cells = _CELLS.take(inputs.ravel(), axis=0)
    g["embed"] = np.bincount(cells.ravel(), weights=dx.ravel(), minlength=w["embed"].size).astype(dx.dtype).reshape(w["embed"].shape)
    return g


class Adam:
    """Weights that are trained on runs of windows, one after another; all are views of one vector, so a step is a few operations."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 4e-3) -> None:
        self.flat = flatten(weights).astype(np.float32)
        self.w, at = {}, 0
        for k, x in weights.items():
            self.w[k] = self.flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.m, self.s, self.rate, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), rate, 0

    def train(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, seed: object, batch: int = 32) -> None:
        """One pass over the windows, in an order drawn from ``seed``."""
        order = np.random.default_rng(seed).permutation(len(inputs))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            self.steps += 1
            got = gradients(self.w, inputs[part], targets[part], mask[part])
            g = np.concatenate([got[k].ravel() for k in self.w])
            self.m += np.float32(0.1) * (g - self.m)
            g *= g
            g -= self.s
            g *= np.float32(0.01)
            self.s += g
            np.sqrt(self.s, out=g)
            g += np.float32(1e-8)
            np.divide(self.m, g, out=g)
            g *= np.float32(self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
            self.flat -= g


class Scorer:
    """Natural-log probabilities of texts given as subword ids, the end id included.

    Keys and values depend on an id and its place only, so both projections are taken once for the
    vocabulary and once for the places; a window looks them up.
    """

    def __init__(self, weights: dict[str, np.ndarray], classes: Classes) -> None:
        self.w, self.c = weights, classes
        self.places, keep = weights["place"], lambda x: np.ascontiguousarray(x, np.float32)
        self.keys, self.place_keys = keep(weights["embed"] @ weights["k"]), keep(weights["place"] @ weights["k"])
        vo = weights["v"] @ weights["o"]
        self.values, self.place_values = keep(weights["embed"] @ vo), keep(weights["place"] @ vo)
        self.asks = keep(weights["q"] * WIDTH**-0.5)
        self.out = keep(np.concatenate([weights["out"], weights["bias"][None]]))

    def targets(self, inputs: np.ndarray, targets: np.ndarray, first: int) -> np.ndarray:
        """Log probabilities of the target classes at the places from ``first`` on."""
        w, n = self.w, len(inputs)
        xq = w["embed"].take(inputs[:, first:], axis=0)
        xq += self.places[first:]
        keys, values = self.keys.take(inputs, axis=0), self.values.take(inputs, axis=0)
        keys += self.place_keys
        values += self.place_values
        asks = xq.reshape(-1, WIDTH) @ self.asks
        att = asks.reshape(xq.shape) @ keys.transpose(0, 2, 1)
        fits = _fits(att)
        att += _MASK[first:]
        if not fits:
            att -= _top(att)
        np.exp(att, out=att)
        mixed = att @ values
        mixed *= (1 / (att.reshape(-1, WINDOW) @ _ONES[:WINDOW])).reshape(*att.shape[:2], 1)
        mixed += xq
        z = mixed.reshape(-1, WIDTH)
        h = z @ w["w1"]
        h += w["b1"]
        np.maximum(h, 0, out=h)
        y = h @ w["w2"]
        y += z
        y, hit, said = _with_one(y), targets.ravel(), np.empty(len(z), np.float32)
        ones = _ONES[: self.out.shape[1]]
        for at in range(0, len(y), ROWS):
            p, to = y[at : at + ROWS] @ self.out, slice(at, at + ROWS)
            if not _fits(p):
                p -= _top(p)
                said[to] = p[np.arange(len(p)), hit[to]]
                np.maximum(p, _LEAST, out=p)
            else:
                said[to] = p[np.arange(len(p)), hit[to]]
            said[to] -= np.log(np.exp(p, out=p) @ ones)
        return said.reshape(n, -1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """One per text; each id of each text is scored once, in batches of windows over padded texts."""
        sizes = np.array([len(t) for t in texts])
        ids = np.concatenate(texts)
        begin = np.cumsum(sizes) - sizes
        later = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        room = WINDOW + STRIDE * later
        offset = np.cumsum(room) - room
        place = np.repeat(offset - begin, sizes) + np.arange(len(ids))
        inputs, targets = np.zeros(room.sum() + 1, np.int32), np.zeros(room.sum(), np.int32)
        real = np.zeros(room.sum(), np.float32)
        inputs[place + 1] = self.c.inputs[ids]  # the input at a place is the id before it
        inputs[offset] = INPUTS - 1
        targets[place], real[place] = self.c.outputs[ids], 1.0
        out = np.add.reduceat(self.c.within[ids], begin)
        owner = np.arange(len(texts))
        step = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later) + 1
        for first, d, a in ((0, owner, offset), (WINDOW - STRIDE, np.repeat(owner, later), np.repeat(offset, later) + STRIDE * step)):
            for i in range(0, len(d), AT_ONCE):
                at = a[i : i + AT_ONCE, None]
                scored = at + np.arange(first, WINDOW)
                logs = self.targets(inputs[at + np.arange(WINDOW)], targets[scored], first)
                out += np.bincount(d[i : i + AT_ONCE], weights=(logs * real[scored]).sum(axis=1), minlength=len(texts))
        return out


# ---------------------------------------------------------------- over a corpus


def held_out() -> Column:
    """Whether a document is kept from training; a null doc_id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _ids(own, texts: list[str] | pa.Array) -> list[np.ndarray]:
    """Subword ids of each text and the end id."""
    return [np.frombuffer(x, "<u4")[1:] for x in own.ids(texts)]


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts with A-Z in lower case; for each word in order which of them it is, and its text's number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = lists.flatten(), np.array(pc.list_parent_indices(lists), np.int64)
    real = np.array(pc.binary_length(words), np.int64) > 0
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()), np.array(coded.indices, np.int64), owner[real]


def surfaces(own) -> list[bytes]:
    """What each id stands for in a text; a text cut at markers is these joined, less the first blank."""
    out = []
    for i in range(own.sp.get_piece_size()):
        piece = own.sp.id_to_piece(i)
        out.append(b"" if own.sp.is_control(i) else bytes([int(piece[3:5], 16)]) if own.sp.is_byte(i) else piece.replace(MARK, " ").encode())
    return out


def _gather(docs: DataFrame, model_file: str) -> DataFrame:
    """Rows (kind, key, n, ...): of training documents 0 word counts, 1 subword counts, 3 documents;
    of all documents 4 their subword ids, so that texts are segmented once (with the text where ids don't tell it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        words: list[pa.Table] = []  # counts of words; rows of a word are added up when there are many
        pieces = np.zeros(own.sp.get_piece_size(), np.int64)
        seen = 0

        def out(kind: int, keys, counts, doc_ids=None, held=None, texts=None) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * n, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                    doc_ids if doc_ids is not None else pa.nulls(n, pa.int64()), held if held is not None else pa.nulls(n, pa.bool_()),
                    texts if texts is not None else pa.nulls(n, pa.string()),
                ],
                names=["kind", "key", "n", "doc_id", "held_out", "text"],
            )

        nowhere = lambda n: pa.nulls(n, pa.int64())

        def added() -> pa.Table:
            return pa.TableGroupBy(pa.concat_tables(words), "key", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["key", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for part in added().to_batches(50_000) if words else []:
                yield out(0, part.column(0).cast(pa.binary()), part.column(1))
            words.clear()

        for batch in batches:
            for part in pieces_of(batch, 2):
                texts, learns = part.column(2), pc.invert(part.column(1))
                ids = _ids(own, texts)
                marked = pc.match_substring(texts, MARK)
                rest = texts if not own.separable else texts.take(pc.replace_with_mask(nowhere(len(texts)), marked, pa.array(np.flatnonzero(marked))))
                yield out(4, [x.astype(_kind(len(pieces))).tobytes() for x in ids], [len(x) for x in ids], part.column(0), part.column(1), rest)
                learnt = [x for x, learn in zip(ids, learns.to_pylist(), strict=True) if learn]
                if learnt:
                    pieces += np.bincount(np.concatenate(learnt), minlength=len(pieces))
                seen += len(learnt)
                keys, which, _ = lower_words(texts.filter(learns))
                words.append(pa.table({"key": keys, "n": np.bincount(which, minlength=len(keys))}))
                if sum(map(len, words)) > 2 * _FLUSH:
                    words[:] = [added()]
                    if len(words[0]) > _FLUSH:
                        yield from flush()
        yield from flush()
        hit = np.flatnonzero(pieces)
        yield out(1, [struct.pack("<I", i) for i in hit.tolist()], pieces[hit].tolist())
        yield out(3, [b""], [seen])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(run, "kind int, key binary, n long, doc_id long, held_out boolean, text string")


def cut(ids: np.ndarray, kind: str) -> np.ndarray:
    """All windows of a text, one a row: the id before it, then its ids, each plus 1; 0 where there is none."""
    n = -(-len(ids) // WINDOW)
    padded = np.zeros(n * WINDOW + 1, kind)
    padded[1 : len(ids) + 1] = ids
    padded[1 : len(ids) + 1] += 1
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[::WINDOW]


def runs_of(batches: Iterator[pa.RecordBatch], vocabulary: int) -> Iterator[np.ndarray]:
    """All windows of the texts whose ids come, RUN_WINDOWS at a time; only the windows of one text and of a run are held."""
    kind, wide = _kind(vocabulary), _kind(vocabulary + 1)
    held, size = [], 0
    for batch in batches:
        for key in batch.column(0):
            rows = cut(np.frombuffer(key.as_buffer(), kind), wide)
            while len(rows):
                held.append(rows[: RUN_WINDOWS - size])
                size += len(held[-1])
                rows = rows[len(held[-1]) :]
                if size == RUN_WINDOWS:
                    yield np.concatenate(held)
                    held, size = [], 0
    if held:
        yield np.concatenate(held)


def _kind(values: int) -> str:
    return "<u2" if values <= 65536 else "<u4"


def _trainer(sent, turn: int):
    """Trains on all windows of a partition, and gives the weights that come of it, times their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, classes = sent.value
        model, n, task = Adam(now), 0, TaskContext.get().partitionId()
        for rows in runs_of(batches, len(classes.inputs)):
            ids = rows.astype(np.int32) - 1
            before, after = ids[:, :-1], ids[:, 1:]
            inputs = np.where(before >= 0, classes.inputs[before], INPUTS - 1)
            model.train(inputs, classes.outputs[np.maximum(after, 0)], (after >= 0).astype(np.float32), seed=(turn, task, n))
            n += len(rows)
        if n:
            yield _weighed(n, model.flat.astype(np.float64) * n)

    return run


def _weighed(n: int, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["n", "w"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of what came, a row at a time."""
    n, w = 0, None
    for batch in batches:
        for size, more in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = np.frombuffer(more.as_buffer(), np.float64)
            n, w = n + size, more.copy() if w is None else w + more
    if n:
        yield _weighed(n, w)


def _share(gathered: DataFrame, turn: int, rounds: int) -> DataFrame:
    """Ids of the training documents whose turn it is: each has one turn, and a turn has three times the documents of those before."""
    dealt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(4**rounds))
    return gathered.filter("kind = 4 AND NOT held_out").filter((dealt >= (4**turn if turn else 0)) & (dealt < 4 ** (turn + 1))).select("key")


def _fit(gathered: DataFrame, classes: Classes, rounds: int) -> dict[str, np.ndarray]:
    """Partitions train side by side, where their ids lie, from the same weights; only weights move, and their mean goes into the next turn."""
    weights = start_weights(classes.prior)
    spark = gathered.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((weights, classes))  # about 20,000 weights, and two numbers for each subword
        trained = _share(gathered, turn, rounds).mapInArrow(_trainer(sent, turn), "n long, w binary")
        with spent_shuffles_go(spark):
            sums = trained.repartition(SUMS).mapInArrow(_added, "n long, w binary").collect()  # SUMS rows at most
        sent.unpersist()
        if sums:
            total = np.sum([np.frombuffer(r["w"], np.float64) for r in sums], axis=0)
            weights = unflatten(total / sum(r["n"] for r in sums), weights)
    return weights


def score(docs: DataFrame, model_file: str, rounds: int = 3) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of non-blank characters with A-Z in lower case, then one end for each document. Null
    text counts as empty and has the end alone. base_score: log10 of (c + 1) / (N + V + 1), summed; c is
    the token's count in the training documents, N all their tokens, V their kinds. score: log10 of the
    model's probability of the text's subword ids and their end. Without training documents all counts
    are 0. Repeated rows are scored alike; the ids of a very long text are held whole, its windows by runs; an empty table gives an empty result; other columns are ignored.
    """
    spark = ship(docs.sparkSession)
    gathered = materialise(_gather(docs, model_file), "gathered", by="kind")
    counts = materialise(gathered.filter("kind = 0").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "counts")
    trained = gathered.filter("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + trained, n_kinds + (1 if trained else 0)
    # The most frequent words, found by a histogram of counts: no more than SENT_WORDS of them.
    level = F.floor(8 * F.log2("c")).cast("int")
    steps = sorted(((r["s"], r["k"]) for r in counts.groupBy(level.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)  # 512 at most
    least, sum_ = None, 0
    for step, k in steps:
        if sum_ + k > SENT_WORDS:
            break
        least, sum_ = step, sum_ + k
    frequent = counts.filter(level >= least) if least is not None else counts.limit(0)
    top = {bytes(r["word"]): r["c"] for r in frequent.collect()}
    rare_counts = counts.filter(level < least) if least is not None else counts
    piece_counts = np.zeros(codec(model_file).sp.get_piece_size(), np.float64)
    for r in gathered.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():  # a row per subword at most
        piece_counts[struct.unpack("<I", r["key"])[0]] = r["n"]
    classes = Classes(piece_counts)
    weights = _fit(gathered, classes, rounds)
    kind = _kind(len(piece_counts))
    sent = spark.sparkContext.broadcast((top, weights, classes, kind, surfaces(codec(model_file))))  # bounded: SENT_WORDS, subwords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, w, c, kind, said = sent.value
        said = pa.array(said, pa.large_binary())
        logs = {k: float(np.log10(v + 1)) for k, v in frequent_words.items()}
        scorer = Scorer(w, c)
        for batch in batches:
            for part in pieces_of(batch, 2, 1 << 20):
                ids = [np.frombuffer(x, kind) for x in part.column(2).to_pylist()]
                natural = scorer.scores(ids)
                ends = np.cumsum([len(x) for x in ids])
                joined = said.take(pa.array(np.concatenate(ids)))
                edges = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1][np.concatenate([[0], ends])].tolist()
                raw = memoryview(joined.buffers()[2] or b"")
                # A first blank, which no text has, parts no words.
                texts = [bytes(raw[a:b]) if t is None else t.encode() for a, b, t in zip(edges, edges[1:], part.column(3).to_pylist(), strict=False)]
                keys, which, owner = lower_words(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
                each = np.fromiter(map(logs.get, keys.to_numpy(zero_copy_only=False).tolist(), repeat(0.0)), float, len(keys))[which]  # logarithms of 2 and more, so 0 stands for a word that isn't there
                n = np.bincount(owner, minlength=len(ids)) + 1
                known = np.bincount(owner[each > 0], minlength=len(ids))
                sums = np.bincount(owner, weights=each, minlength=len(ids))
                pairs, rare_n = np.unique(owner[each == 0] * len(keys) + which[each == 0], return_counts=True)
                lists = np.searchsorted(pairs, np.arange(len(ids) + 1) * len(keys)).astype(np.int32)
                rare = pa.ListArray.from_arrays(lists, keys.take(pa.array(pairs % max(1, len(keys)))).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()),
                        pa.array(natural / np.log(10.0), pa.float64()), rare, pa.ListArray.from_arrays(lists, pa.array(rare_n, pa.int64())),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", "sums", "score", "rare", "rare_n"],
                )

    slim = gathered.filter("kind = 4").select("doc_id", "held_out", "key", "text")
    done = slim.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, sums double, score double, rare array<binary>, rare_n array<long>")
    done = materialise(done.withColumn("row_id", F.monotonically_increasing_id()), "scored")
    discard(gathered)
    rows = done.select("row_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row_id", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    more = rows.join(rare_counts, "word").groupBy("row_id").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("more_known"))
    end = float(np.log10(trained + 1))
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    return done.join(more, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if trained else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
