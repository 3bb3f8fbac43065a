"""Token-id files: independent zstandard frames, per-frame checksums and a trailing seek table.

Layout of a shard, all integers little-endian:

    frames        each a zstandard frame of the ids (unsigned 32-bit) of some consecutive documents
    doc table     one zstandard frame: per document  doc_id int64, has_id u8, frame u32, n_tokens u64
    seek table    per frame  offset u64, packed bytes u64, raw bytes u64, crc32 of the raw bytes u32
    footer        doc table offset u64, its packed bytes u64, seek table offset u64, frames u32,
                  documents u64, crc32 of doc table and seek table as stored u32, magic 8 bytes

A reader seeks to the footer, reads the two tables and decompresses only frames it needs.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.chunks import ChunkTable, as_texts, cut_texts
from tidewater.llm.common import materialise, new_path
from tidewater.llm.wordhash import pieces_of
from tidewater.session import ship

MAGIC = b"TWTOKID1"
FOOTER = struct.Struct("<QQQIQI8s")
SEEK = struct.Struct("<QQQI")
DOCS = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("n_tokens", "<u8")])
FRAME_BYTES = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; documents come in order, frames close at about ``frame_bytes``."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 1) -> None:
        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.at, self.seek, self.docs = 0, [], []
        self.raw: list[bytes] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._close_frame()
        self.raw.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        self.docs.append((doc_id or 0, doc_id is not None, len(self.seek), len(ids) // 4))

    def _close_frame(self) -> None:
        raw = b"".join(self.raw)
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.seek.append((self.at, len(packed), len(raw), zlib.crc32(raw)))
        self.at += len(packed)
        self.raw, self.size = [], 0

    def close(self) -> None:
        if self.raw:
            self._close_frame()
        table = self.packer.compress(np.array(self.docs, DOCS).tobytes())
        seek = b"".join(SEEK.pack(*row) for row in self.seek)
        self.sink.write(table)
        self.sink.write(seek)
        self.sink.write(
            FOOTER.pack(
                self.at, len(table), self.at + len(table), len(self.seek), len(self.docs),
                zlib.crc32(seek, zlib.crc32(table)), MAGIC,
            )
        )


class ShardReader:
    """Random access to a shard through any seekable file."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        if size < FOOTER.size:
            raise ValueError("not a token shard: too short")
        source.seek(size - FOOTER.size)
        at, packed, seek_at, frames, n_docs, check, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard: no magic")
        source.seek(at)
        table, seek = source.read(packed), source.read(frames * SEEK.size)
        if zlib.crc32(seek, zlib.crc32(table)) != check:
            raise ValueError("token shard: damaged tables")
        self.unpacker = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unpacker.decompress(table, max_output_size=max(1, n_docs * DOCS.itemsize)), DOCS)
        self.seek = [SEEK.unpack_from(seek, i * SEEK.size) for i in range(frames)]

    def frame(self, i: int) -> bytes:
        at, packed, raw, check = self.seek[i]
        self.source.seek(at)
        data = self.unpacker.decompress(self.source.read(packed), max_output_size=max(1, raw))
        if len(data) != raw or zlib.crc32(data) != check:
            raise ValueError(f"token shard: frame {i} fails its checksum")
        return data

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        """Every document in order, one frame in memory at a time."""
        held, data, at = -1, b"", 0
        for doc_id, has_id, frame, n in self.docs.tolist():
            if frame != held:
                held, data, at = frame, self.frame(frame), 0
            yield (doc_id if has_id else None), data[at : at + 4 * n]
            at += 4 * n

    def get(self, doc_ids: Iterable[int]) -> dict[int, bytes]:
        """Only the requested documents (the first of a repeated id); only their frames are decompressed."""
        wanted, out = set(doc_ids), {}
        start = np.zeros(len(self.docs) + 1, np.int64)
        np.cumsum(self.docs["n_tokens"], out=start[1:])
        first = np.searchsorted(self.docs["frame"], np.arange(len(self.seek) + 1))
        held, data = -1, b""
        for row in np.flatnonzero(np.isin(self.docs["doc_id"], list(wanted)) & (self.docs["has_id"] == 1)):
            doc_id, frame = int(self.docs["doc_id"][row]), int(self.docs["frame"][row])
            if doc_id in out:
                continue
            if frame != held:
                held, data = frame, self.frame(frame)
            at = 4 * int(start[row] - start[first[frame]])
            out[doc_id] = data[at : at + 4 * int(self.docs["n_tokens"][row])]
        return out


def read_documents(uri: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of the requested documents of one shard."""
    store, path = _open(uri)
    with store.open_input_file(path) as source:
        found = ShardReader(source, source.size()).get(doc_ids)
    return {k: np.frombuffer(v, "<u4") for k, v in found.items()}


class ByteCodec:
    """A byte-level tokenizer behind a table of distinct words; one per worker process."""

    def __init__(self, tokenizer_file: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.words, self.parts = ChunkTable(self._after_blank), ChunkTable(self._segment)
        # Words may be cut apart only where no rule looks across a single blank between two non-blanks.
        pre = str(self.tok.pre_tokenizer)
        self.separable = self.tok.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
        self.between, self.between_id = self._separator()

    def _separator(self) -> tuple[str | None, int]:
        """The model's only added token, if texts are cut at it before any rule looks at them and no two of it overlap."""
        added = list(self.tok.get_added_tokens_decoder().items())
        if self.separable and len(added) == 1:
            ((i, token),) = added
            text = token.content
            bordered = any(text.startswith(text[k:]) for k in range(1, len(text)))
            if text.startswith(SPECIAL) and not (token.lstrip or token.rstrip or token.single_word or token.normalized or bordered):
                return text, i
        return None, -1

    def _segment(self, chunks: list[str]) -> Iterator[bytes]:
        """The library takes many chunks as one text, with the added token between them; it cuts there first of all."""
        if self.between is None or any(SPECIAL in c for c in chunks):
            for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False):
                yield array("I", e.ids).tobytes()
            return
        for at in range(0, len(chunks), TOGETHER):
            ids = np.array(self.tok.encode_batch_fast([self.between.join(chunks[at : at + TOGETHER])], add_special_tokens=False)[0].ids, np.uint32)
            begin, raw = 0, ids.tobytes()
            for end in (4 * np.flatnonzero(ids == self.between_id)).tolist():
                yield raw[begin:end]
                begin = end + 4
            yield raw[begin:]

    def _after_blank(self, words: list[str]) -> Iterator[bytes]:
        """Of words that stand after a single blank; new ones are cut further, for their parts come more often."""
        parts: list[str] = []
        ends = []
        for w in words:
            parts += [f" {w}"] if w.isalnum() or SPECIAL in w else PART.split(f" {w}")
            ends.append(len(parts))
        found, at = self.parts.packed(parts), 0
        for end in ends:
            yield found[at] if end == at + 1 else b"".join(found[at:end])
            at = end

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = as_texts(texts)
        if not self.separable:
            return list(self._segment(texts.to_pylist()))
        odd = np.array(pc.match_substring_regex(texts, BESIDE_BLANK), bool)
        words, sizes, order = cut_texts(texts, ~odd, odd, blank_words)
        ends = np.cumsum(sizes)
        first = np.zeros(len(words), bool)
        first[ends - sizes] = True
        heads = self.parts.packed(words.filter(pa.array(first)).to_pylist())
        rests = self.words.joined(words.filter(pa.array(~first)), ends - np.arange(1, len(ends) + 1))
        out: list[bytes] = [b""] * len(texts)
        for i, head, rest in zip(order.tolist(), heads, rests, strict=True):
            out[i] = head + rest
        return out


#: Places inside a word where a rule always ends: before a mark after a letter, around a single line end.
PART = re.compile(r"(?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])(?=[.,;:!?])|(?<=[.,;:!?])(?=\n)|(?<=[^\s]\n)(?=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])")
SPECIAL = "<|"
#: Chunks that the library takes as one text.
TOGETHER = 512
#: White space other than the blank.
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


#: A blank at an end of the text or beside other white space.
BESIDE_BLANK = r"\A | \z|  " + f"| [{''.join(WHITE)}]|[{''.join(WHITE)}] "


def blank_words(text: str) -> list[str]:
    """Cut at each blank that stands alone between two characters that are not white space."""
    words = text.split(" ")
    out = [words[0]]
    for w in words[1:]:
        last = out[-1]
        if w and last and not w[0].isspace() and not last[-1].isspace():
            out.append(w)
        else:
            out[-1] = f"{last} {w}"
    return out


@lru_cache(maxsize=2)
def codec(tokenizer_file: str) -> ByteCodec:
    return ByteCodec(tokenizer_file)


def write_token_files(docs: DataFrame, tokenizer_file: str, uri: str, shards: int | None = None, end_id: int = 0) -> DataFrame:
    """Encode and write every document in ascending doc_id; returns the manifest, one row per shard.

    Rows are dealt to shards by ranges of doc_id and sorted within (null ids first, ties by text), so a
    shard's number is its place in the corpus. Null text counts as empty; an empty text has the end id
    alone; repeated rows are written each time; an empty table writes no shard. Columns but doc_id and
    text are ignored. A shard is written under a name of its own attempt and then renamed, so lost and
    repeated tasks leave whole files only. Memory: one frame and one batch.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (slim.repartitionByRange(shards, "doc_id") if shards else slim.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, writer = codec(tokenizer_file), None
        shard = TaskContext.get().partitionId()
        store, root = _open(uri)
        final, draft = f"{root}/shard-{shard:08d}.twt", f"{root}/_draft-{shard:08d}-{uuid.uuid4().hex}"
        sink = None
        for batch in batches:
            for part in pieces_of(batch, 1):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(draft)
                    writer = ShardWriter(sink)
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1)), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(draft, final)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int64()), "path": [f"{uri}/shard-{shard:08d}.twt"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())}
            )

    # Written once: reading the manifest again must not write the shards again.
    return materialise(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all shards. A damaged frame raises.
    """
    spark = ship(manifest.sparkSession)
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    jobs = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = _open(path)
                with store.open_input_file(inner) as source:
                    rows, start = [], base
                    for doc_id, ids in ShardReader(source, source.size()):
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) >= 8192:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return jobs.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files_of(spark: SparkSession, docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write to a fresh folder of the shared directory and read the files back."""
    return read_token_files(write_token_files(docs, tokenizer_file, new_path(spark, "tokens")))
