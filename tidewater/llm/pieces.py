"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model none of whose pieces has a whitespace marker after another character, no merge crosses the
place before a marker that follows a non-marker. Texts are cut there; each distinct marked word is
segmented and decoded once, and ids and surfaces are joined back by position. Models with other rules
(crossing pieces, a normaliser, dropped blanks) are encoded whole, by the same library.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.chunks import ChunkTable, as_texts, cut_texts
from tidewater.session import ship

MARK = "▁"


class PieceCodec:
    """Encodes with begin and end ids, exactly as the library; one per worker process."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.lone = self.sp.piece_to_id(MARK)
        self.separable = self._separable()
        self.table = ChunkTable(self._segment)
        self.id_table = ChunkTable(self._segment_ids)
        self.begin, self.end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)

    def _separable(self) -> bool:
        """Whether cutting before markers gives the library's own result, judged from the model itself."""
        sp = self.sp
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if any(a != MARK and b == MARK for a, b in zip(piece, piece[1:], strict=False)):
                return False
        # identity normaliser, a dummy prefix, blanks kept, bytes for the unknown: seen from its behaviour
        probe = "  a Ａ  é é ① "
        ids = sp.encode(probe)
        return sp.decode(ids) == probe and sp.encode(" a") != sp.encode("a") and sp.unk_id() not in ids

    def _lists(self, words: list[str]) -> list[list[int]]:
        """The library itself puts the marker before a text, but adds none to an empty one."""
        return [ids or [self.lone] for ids in self.sp.encode(words, num_threads=1)]

    def _segment(self, words: list[str]) -> Iterator[tuple[bytes, bytes]]:
        lists = self._lists(words)
        for ids, text in zip(lists, self.sp.decode(lists, num_threads=1), strict=True):
            yield array("I", ids).tobytes(), b" " + text.encode()

    def _segment_ids(self, words: list[str]) -> Iterator[bytes]:
        return (array("I", ids).tobytes() for ids in self._lists(words))

    def _cut(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """All marked words of the texts that can be cut, and where each text's words end; -1 for the others."""
        words: list[str] = []
        ends = []
        for text in texts:
            if text and self.separable and MARK not in text:
                words += marked_words(text)
                ends.append(len(words))
            else:
                ends.append(-1)
        return words, ends

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, begin and end ids included."""
        texts = as_texts(texts)
        cuts = ~np.array(pc.match_substring(texts, MARK), bool) & (np.array(pc.binary_length(texts), np.int64) > 0) & self.separable
        odd = np.array(pc.match_substring_regex(texts, r"\A | \z|  "), bool) & cuts
        words, sizes, order = cut_texts(texts, cuts & ~odd, odd, marked_words)
        out = [b""] * len(texts)
        for i, body in zip(order.tolist(), self.id_table.joined(words, np.cumsum(sizes)), strict=True):
            out[i] = self.begin + body + self.end
        for i in np.flatnonzero(~cuts).tolist():
            out[i] = self.begin + array("I", self.sp.encode(texts[i].as_py())).tobytes() + self.end
        return out

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """As ``ids``, each with the decoded text in UTF-8."""
        words, ends = self._cut(texts)
        found, at, out = self.table.packed(words), 0, []
        for text, end in zip(texts, ends, strict=True):
            if end < 0:
                ids = self.sp.encode(text) if text else []
                body, decoded = array("I", ids).tobytes(), self.sp.decode([self.bos, *ids, self.eos]).encode()
            else:
                part, at = found[at:end], end
                body, decoded = b"".join([x[0] for x in part]), b"".join([x[1] for x in part])[1:]
            out.append((self.begin + body + self.end, decoded))
        return out


def marked_words(text: str) -> list[str]:
    """The text cut before each marker that follows another character, each part without its first marker.

    Marked, a text has a marker in front and one for each blank; runs of blanks stay with the word they precede.
    """
    words = text.split(" ")
    if "" not in words:
        return words
    out, blanks = [], 0
    for i, w in enumerate(words):
        blanks += i > 0
        if w:
            out.append(" " * (blanks - (len(out) > 0)) + w)
            blanks = 0
    if blanks:
        out.append(" " * (blanks - (len(out) > 0)))
    return out


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_pieces(docs: DataFrame, model_file: str, id_column: str = "doc_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit, with begin and end ids), decoded.

    Null text counts as empty and gives the begin and end ids alone. Whole texts of any length are read;
    repeated rows give repeated results; an empty table gives an empty one; of the other columns those named in
    ``columns`` stay.
    No shuffle: each task works on its own rows, so a lost executor costs only its running tasks.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                done = own.encode_decode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x[0] for x in done], pa.binary()),
                        pa.array([x[1] for x in done], pa.binary()).cast(pa.string()),
                        *(part.column(i) for i in range(2, part.num_columns)),
                    ],
                    names=["doc_id", "ids", "decoded", *columns],
                )

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *columns)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[2:])
    return slim.mapInArrow(run, f"doc_id long, ids binary, decoded string{more}")


def piece_digests(encoded: DataFrame, *more: str) -> DataFrame:
    """The contract's columns from the operator's output, and others of it that are named."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
