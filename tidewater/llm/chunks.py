"""A bounded table of distinct chunks, filled a batch at a time, for tokenizers that are slow on repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cut_texts(texts: pa.Array, plain: np.ndarray, odd: np.ndarray, cut: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the plain texts, cut at each blank, then of the odd ones by ``cut``; how many each text has, and which texts these are."""
    lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
    words, sizes = lists.flatten(), np.array(pc.list_value_length(lists), np.int64)
    if odd.any():
        apart = [cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        words = pa.concat_arrays([words, pa.array([w for ws in apart for w in ws], words.type)])
        sizes = np.concatenate([sizes, [len(ws) for ws in apart]])
    return words, sizes, np.concatenate([np.flatnonzero(plain), np.flatnonzero(odd)])


def as_texts(texts: list[str] | pa.Array) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


class ChunkTable:
    """Maps each distinct chunk to what ``segment`` makes of it, once while it stays in the table.

    Two generations bound the memory: when the young one is full it becomes the old one, and chunks
    that are asked for again move back up. What is dropped is segmented anew if it returns, so the
    result never depends on the bound.
    """

    def __init__(self, segment: Callable[[list[str]], Iterable], most: int = 500_000) -> None:
        self.segment, self.most = segment, most
        self.young: dict = {}
        self.old: dict = {}

    def packed(self, chunks: list[str]) -> list:
        """One entry per chunk; all that are missing are segmented in one call."""
        found = list(map(self.young.get, chunks))
        if None in found:
            holes = [i for i, x in enumerate(found) if x is None]
            missing = [chunks[i] for i in holes]
            fresh = dict.fromkeys(missing)  # small beside the table, so what follows stays in the processor's cache
            if self.old:
                fresh.update(zip(fresh, list(map(self.old.get, fresh)), strict=True))
            new = [c for c, x in fresh.items() if x is None]
            if new:
                fresh.update(zip(new, self.segment(new), strict=True))
            for i, c in zip(holes, missing, strict=True):
                found[i] = fresh[c]
            self.young.update(fresh)
            if len(self.young) > self.most:
                self.old, self.young = self.young, {}
        return found

    def joined(self, chunks: pa.Array, ends: np.ndarray) -> list[bytes]:
        """The entries of all chunks up to each end, joined; a chunk that comes often is looked up once, and Arrow joins."""
        if not len(chunks):
            return [b""] * len(ends)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() takes ten times as long
        found = pa.array(self.packed(distinct), pa.large_binary()).take(coded.indices)
        _, offsets, data = found.buffers()
        edges = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1][np.concatenate([[0], ends])].tolist()
        raw = memoryview(data or b"")
        return [bytes(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
