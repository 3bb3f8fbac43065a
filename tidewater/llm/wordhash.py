"""Words of whole batches of texts as 64-bit hashes, in numpy: no object is made for a word.

A word is a run of bytes other than 20 and 09 to 0D (hex), or of another set of bytes; A-Z count as a-z. Its hash is a polynomial over a
random number for each byte value, mod 2**64, through a finaliser: the same in every process and at every
place of a text. Sums of powers over a region give the hash of any word in it by one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once; few enough that what is made of them stays in the processor's cache.
REGION = 1 << 16

_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
#: Bytes of the terms of a search: letters and digits of ASCII, and all bytes of other characters.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = REGION if n <= REGION else 1 << (n - 1).bit_length()
    if size not in _powers_of:
        pair = _powers(_BASE, size), _powers(_BACK, size)
        if size > REGION:  # for one word longer than a region
            return pair
        _powers_of[size] = pair
    return _powers_of[size]


class Words:
    """The words of some texts, in order: hash, text (its number), line (how many \\n of its text come before)."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray = _IS_WORD) -> None:
        """``texts`` holds binary values; a null counts as empty. ``is_word`` says of each byte whether words hold it."""
        n = len(texts)
        wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        _, ends, data = texts.buffers()
        edge = np.frombuffer(ends, wide)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None and edge[-1] > edge[0] else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        inner = edge[1:-1][(edge[1:-1] > 0) & (edge[1:-1] < len(raw))]
        word = is_word[raw]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        begin[inner] = word[inner]
        end[:-1] &= ~word[1:]
        end[inner - 1] = word[inner - 1]
        first, last = np.flatnonzero(begin), np.flatnonzero(end)
        breaks = np.flatnonzero(raw == 10)
        self.n_texts = n
        self.in_text = np.diff(np.searchsorted(first, edge))
        self.text = np.repeat(np.arange(n), self.in_text)
        before = np.bincount(np.searchsorted(first, breaks), minlength=len(first) + 1).cumsum()[: len(first)]
        self.line = before - np.searchsorted(breaks, edge[:-1])[self.text]
        self.hash = self._hashes(raw, first, last)

    @staticmethod
    def _hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), _U)
        done = 0
        while done < len(first):
            at = first[done]
            stop = max(done + 1, int(np.searchsorted(last, at + REGION)))  # whole words only, one at least
            a, b = first[done:stop] - at, last[done:stop] - at
            power, back = _both_powers(int(b[-1]) + 1)
            sums = _BYTE[raw[at : at + b[-1] + 1]]
            sums *= power[: len(sums)]
            np.cumsum(sums, out=sums)
            value = sums[b]
            value[1:] -= sums[a[1:] - 1]
            value *= back[a]
            out[done:stop] = value
            done = stop
        return mix(out)


def pieces_of(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``most_bytes`` together; a longer text is a slice of its own."""
    texts = batch.column(column)
    sizes = np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop
