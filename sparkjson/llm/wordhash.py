"""Hashes of words and word windows for whole Arrow batches at once, and a bounded bitmap of shared hashes.

Words are runs of bytes other than space and U+0009..U+000D of the UTF-8 text, which is the same as for characters.
A word's hash takes in its bytes eight at a time, each step mixed by the finalizer of MurmurHash3; a word of more than
``LONG`` bytes has BLAKE2b instead.  A window's hash joins those of its two halves, again mixed, so no sum or product
of words makes two windows meet.  There are two lanes with different constants: one gives 64 bits, for filters and
for shingles of a pair of documents; more bits, for equality in a whole corpus, come from both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Text bytes that are hashed in one step (or one whole text, if that is longer), and rows that are copied at once.
STEP_BYTES, STEP_ROWS = 500_000, 512
#: Words of more bytes are hashed one by one.
LONG = 256
#: Odd constants of the two lanes.
LANES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Keeps the first 0..8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _join(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    p, q = LANES[lane]
    return mix(mix(a + np.uint64(p)) * np.uint64(q) + b)


def hash_words(data: np.ndarray, first: np.ndarray, last: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of the words data[first:last]."""
    p, q = (np.uint64(x) for x in LANES[lane])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = last - first
    out = mix((eight[first] & _FIRST[np.minimum(size, 8)]) + p)
    out = mix(out * q + size.astype(np.uint64))
    more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        part = eight[first[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
        out[more] = mix(out[more] * q + part)
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[first[k] : last[k]].tobytes(), digest_size=8, salt=bytes([lane])).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


class Words:
    """Word hashes of some texts; ``at[k]:at[k+1]`` are the words of text k."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        separator = (data == 32) | ((data >= 9) & (data <= 13))
        if lower:
            data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        before[:1], before[1:] = True, separator[:-1]
        after[-1:], after[:-1] = True, separator[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(data)]] = True
        after[inner[inner > 0] - 1] = True
        first = np.flatnonzero(~separator & before)
        last = np.flatnonzero(~separator & after) + 1
        self.lanes = lambda lane: hash_words(data, first, last, lane)
        self.hash = self.lanes(0)
        self.at = np.searchsorted(first, offsets)

    def windows(self, width: int, lane: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each word on; places whose window leaves the text are junk.

        Joined from windows of one, two, four, .. words, as the bits of ``width`` say.
        """
        n = len(self.hash)
        power, size, out, used = self.hash if lane == 0 else self.lanes(lane), 1, None, 0
        while size <= width <= n:
            if width & size:
                out = power if out is None else _join(out[: len(power) - used], power[used:], lane)
                used += size
            size *= 2
            if size <= width:
                power = _join(power[: -(size // 2)], power[size // 2 :], lane)
        return np.concatenate([out, np.zeros(n - len(out), np.uint64)]) if out is not None else np.zeros(n, np.uint64)

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word's text and its place in it."""
        sizes = np.diff(self.at)
        return np.repeat(np.arange(len(sizes)), sizes), np.arange(len(self.hash)) - np.repeat(self.at[:-1], sizes)


def steps(keys: pa.Array, texts: pa.Array, lower: bool = False) -> Iterator[tuple[np.ndarray, Words]]:
    """(keys, words) for stretches of a batch of about STEP_BYTES; a null text is empty, null keys make an object array."""
    for at in range(0, len(texts), STEP_ROWS):
        some, own = texts.slice(at, STEP_ROWS).cast(pa.large_string()).fill_null(""), keys.slice(at, STEP_ROWS)
        ids = np.array(own.to_pylist(), object) if own.null_count else own.to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)
        k = 0
        while k < len(ids):
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + STEP_BYTES, "right")) - 1)
            yield ids[k:end], Words(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], lower)
            k = end


class Bitmap:
    """A fixed-size set of hashes by their leading bits: no false negatives, some false positives."""

    def __init__(self, log2: int, buckets: list):
        self.log2, self.bits = log2, np.zeros(max(1, (1 << log2) >> 3), np.uint8)
        for number, bits in buckets:
            self.bits[(number - 1) * 4096 : number * 4096] = np.frombuffer(bits, np.uint8)[: len(self.bits)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log2)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def bitmap_of(hashes: DataFrame, name: str, least_log2: int = 20, most_log2: int = 29) -> Bitmap:
    """The bitmap of a one-column DataFrame of signed 64-bit hashes, with about 16 bits for each of them.

    Its size is bounded by 2**most_log2 bits (64 MiB); beyond that it only lets more pass.
    """
    (column,) = hashes.columns
    hashes = materialize(hashes, name)
    n = hashes.count()
    log2 = min(most_log2, max(least_log2, int(16 * n).bit_length()))
    at = F.shiftrightunsigned(column, 64 - log2) + 1  # buckets of Spark's bitmaps count from 1
    buckets = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return Bitmap(log2, [(r["bucket"], bytes(r["bits"])) for r in buckets.collect()])
