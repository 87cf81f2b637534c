"""Token-id files of independent zstandard frames with a trailing seek table, and their reader.

A file holds documents in ascending key order, one zstandard frame for each, then an index frame (keys, 64-bit, then
counts, 64-bit), then the seek table of the public seekable format: a skippable frame with the compressed size,
decompressed size and checksum (low 32 bits of XXH64 of the content) of each frame.  A reader fetches the tail, the
index and the frames it wants; ``fetch_documents`` does so for a table of keys.  Ids are stored as 16-bit words when the
vocabulary allows, else as 32-bit words; the index frame begins with that width and the number of null keys.

A task writes each frame as soon as it is encoded and keeps only the index.  Files are written under a temporary name
and renamed, so that a task that runs again leaves one whole file.

Null text: empty, which gives just the end id.  Rows that repeat a key are documents of their own, in the order of their texts.
Rows with a null key are kept and come before all others.  An empty table gives an empty list of files.  A very long
text is one frame.  Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, documents, scratch_path
from .tokens import encoder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FILES = "file string, first_id long, last_id long, nulls long, docs long, tokens long"
#: Texts that are encoded at once.
ROWS = 256


class FrameWriter:
    """Writes frames, the index and the seek table to ``out``; keeps 28 bytes a document."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.squeeze = out, width, zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.keys, self.counts, self.table, self.nulls = array("q"), array("q"), array("I"), 0

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.squeeze.compress(raw)
        self.table.extend((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(packed)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        """The next document; null keys come first."""
        self.nulls += key is None
        self.keys.append(key or 0)
        self.counts.append(len(ids))
        self._frame(ids.astype(self.dtype).tobytes())

    def end(self) -> None:
        self._frame(struct.pack("<II", self.width, self.nulls) + np.array(self.keys, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        body = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table) // 3, 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads single documents of a file; every frame's checksum is verified."""

    def __init__(self, source):
        """``source``: an open, seekable binary file."""
        import zstandard

        self.source, self.open = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        source.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(frames, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self.frame(frames - 1)
        self.width, self.nulls = struct.unpack("<II", index[:8])
        self.keys, self.counts = np.frombuffer(index, "<i8", offset=8).reshape(2, frames - 1)

    def places(self, key: int | None) -> range:
        """The documents that have ``key``."""
        if key is None:
            return range(self.nulls)
        return range(*(self.nulls + int(np.searchsorted(self.keys[self.nulls :], key, side)) for side in ("left", "right")))

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, check = (int(x) for x in self.table[k])
        self.source.seek(int(self.at[k]))
        raw = self.open.decompress(self.source.read(packed), max_output_size=size) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.frame(k), "<u2" if self.width == 2 else "<u4").astype("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode ``text``, write the files in ascending key order, return one row per file (FILES)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if len(b))
        head = next(batches, None)
        if head is None:
            return
        encode = encoder(vocabulary)
        where, root = _filesystem(folder)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(tmp := f"{root}/.{uuid.uuid4().hex}") as out:
            frames = FrameWriter(out, 2 if max(encode.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
            for batch in chain([head], batches):
                for at in range(0, len(batch), ROWS):
                    keys, texts = (batch.column(k).slice(at, ROWS).to_pylist() for k in (0, 1))
                    for key, ids in zip(keys, encode([x or "" for x in texts]), strict=True):
                        frames.add(key, np.append(ids, np.uint32(end_id)))
            frames.end()
        n, some = len(frames.keys), frames.nulls < len(frames.keys)
        first, last = (frames.keys[frames.nulls], frames.keys[-1]) if some else (None, None)
        name = f"{root}/tokens-{0 if frames.nulls else 1}-{first or 0:020d}-{uuid.uuid4().hex}.zst"
        where.move(tmp, name)
        found = {"file": [name], "first_id": [first], "last_id": [last], "nulls": [frames.nulls], "docs": [n], "tokens": [sum(frames.counts)]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "file" else pa.int64()) for k, v in found.items()})

    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = dealt.repartitionByRange(partitions, "key") if partitions else dealt.repartitionByRange("key")
    return dealt.sortWithinPartitions("key", F.coalesce("text", F.lit(""))).mapInArrow(write, FILES)


def in_order(files: list) -> list:
    """Rows of FILES in the order of their documents."""
    return sorted(files, key=lambda f: (f["first_id"] is not None and not f["nulls"], f["first_id"] is not None, f["first_id"] or 0, f["last_id"] or 0))


def read_token_files(spark, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document; ``files``: (name, ids before it), one row a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, _ = _filesystem(folder)
                with where.open_input_file(row["file"]) as source:
                    reader = FrameReader(source)
                    starts = row["start"] + np.concatenate([[0], np.cumsum(reader.counts)[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(reader.ids(k).tobytes()) for k in range(len(reader.keys))]
                    keys = pa.array(reader.keys, mask=np.arange(len(reader.keys)) < reader.nulls)
                    yield pa.RecordBatch.from_pydict({"doc_id": keys, "start": starts, "n_tokens": reader.counts, "ids_crc32": pa.array(crc, pa.int64())})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(files, "file string, start long").repartition(len(files)).mapInArrow(read, schema)


def fetch_documents(keys: DataFrame, folder: str, files: list) -> DataFrame:
    """key, ids of the documents that have one of ``keys`` (one column; null asks for null keys), however often it is named.

    ``files``: rows of FILES.  Only the tails, indexes and wanted frames of files that may have a key are read.
    """
    ranges = [(f["file"], f["first_id"], f["last_id"], f["nulls"] > 0) for f in in_order(files)]
    known = [x for x in ranges if x[1] is not None]
    # The files' ranges follow each other; only keys at their ends may be in two of them.
    last = np.array([x[2] for x in known], np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int | None]] = []
            for k in batch.column(0).to_pylist():
                if k is None:
                    out += [(x[0], None) for x in ranges if x[3]]
                    continue
                at = int(np.searchsorted(last, k))
                while at < len(known) and known[at][1] <= k:
                    out.append((known[at][0], k))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], ["file", "key"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name, source, reader = _filesystem(folder)[0], None, None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if source is not None:
                            source.close()
                        name, source = row["file"], where.open_input_file(row["file"])
                        reader = FrameReader(source)
                    got = [reader.ids(k) for k in reader.places(row["key"])]
                    yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(got), pa.int64()), pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32()))], ["key", "ids"])
        finally:
            if source is not None:
                source.close()

    (column,) = keys.columns
    wanted = keys.select(F.col(column).cast("long").alias("key")).distinct().mapInArrow(find, "file string, key long")
    # A file's keys stay together in a task and in order.
    return wanted.repartition("file").sortWithinPartitions("file", "key").mapInArrow(fetch, "key long, ids array<int>")


def token_files(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write all documents, then read them back.  The driver sees one row for each file, never one for each document."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    with batches_of(docs.sparkSession, ROWS):
        files = in_order(write_token_files(docs, folder, vocabulary, end_id, key, text).collect())
    before = accumulate((f["tokens"] for f in files), initial=0)
    out = read_token_files(docs.sparkSession, folder, [(f["file"], n) for f, n in zip(files, before, strict=False)])
    return out.withColumnRenamed("doc_id", key) if key != "doc_id" else out


def op3_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2)
