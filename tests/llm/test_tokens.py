import base64
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from cases import empty, frame, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkjson.llm import bpe
from sparkjson.llm.packing import pack, pack_documents, plan
from sparkjson.llm.token_files import FrameReader, FrameWriter, fetch_documents, token_files, write_token_files
from sparkjson.llm.tokens import Encoder

WORDS = P.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_library():
    texts = [r[1] or "" for r in rows()] + ["It's HER'S, isn't?  ÜBERGRÖSSE. 3.14 a1b2 x²", "naïvé   é", "ª º µ ÀÉÎ-õ's"]
    t = library()
    assert [x.tolist() for x in Encoder(WORDS)(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files_against_the_library(spark):
    t, at, want = library(), 0, []
    docs = sorted([(r[0], r[1] or "") for r in rows()] + [(None, "no id " * 30)], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for i, text in docs:
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_files(frame(spark, with_null_id=True), WORDS, 2).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files(empty(spark), WORDS, 2).collect() == []


def test_fetch_reads_only_what_is_asked_for(spark, tmp_path):
    files = write_token_files(frame(spark, with_null_id=True), str(tmp_path), WORDS, 2, partitions=3).collect()
    assert len(files) == 3 and sum(f["nulls"] for f in files) == 1
    t, want = library(), Counter()
    for i, text in [(r[0], r[1]) for r in rows()] + [(None, "no id " * 30)]:
        if i in (1, 120, 500, None):
            want[(i, tuple(t.encode(text or "", add_special_tokens=False).ids + [2]))] += 1
    asked = spark.createDataFrame([(1,), (120,), (500,), (120,), (999,), (-5,), (None,)], "k long")
    got = fetch_documents(asked, str(tmp_path), files).collect()
    assert Counter((r.key, tuple(r.ids)) for r in got) == want
    assert fetch_documents(asked, str(tmp_path), []).collect() == []


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def frames_of(keys, ids, width):
    out = io.BytesIO()
    writer = FrameWriter(out, width)
    for k, x in zip(keys, ids, strict=True):
        writer.add(k, x)
    writer.end()
    return out.getvalue()


def test_a_reader_fetches_the_tail_and_the_wanted_frames():
    rng = np.random.default_rng(0)
    raw = frames_of(range(500), [rng.integers(0, 60000, 400, dtype=np.uint16) for _ in range(500)], 2)
    source = Counting(raw)
    reader = FrameReader(source)
    (k,) = reader.places(123)
    assert len(reader.ids(k)) == 400 and source.taken < len(raw) / 20


def test_frames_are_independent_and_checked():
    ids = [np.array(x, np.uint16) for x in ([1, 2, 3], [], [65535] * 1000)]
    raw = frames_of([None, 6, 9], ids, 2)
    reader = FrameReader(io.BytesIO(raw))
    assert reader.nulls == 1 and reader.keys[1:].tolist() == [6, 9] and reader.ids(2).tolist() == [65535] * 1000 and reader.ids(1).tolist() == []
    assert [list(reader.places(k)) for k in (None, 6, 7, 9)] == [[0], [1], [], [2]]
    import zstandard

    assert zstandard.ZstdDecompressor().decompress(raw[: reader.table[0][0]], max_output_size=6) == ids[0].tobytes()
    broken = bytearray(raw)
    broken[int(reader.at[2]) + 8] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        FrameReader(io.BytesIO(bytes(broken))).ids(2)


def test_packing(spark):
    t, want = library(), Counter()
    for r in rows():
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, s in enumerate(range(0, len(ids), 512)):
            part = ids[s : s + 512]
            want[(r[0], k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    got = pack_documents(frame(spark), WORDS, capacity=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 512
    assert len(sequences) <= first_fit([r.length for r in got], 512)
    assert pack(spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long"), 512).collect() == []


def first_fit(lengths, capacity):
    """Sequences that first fit, longest first, needs."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(capacity - n)
        else:
            rooms[k] -= n
    return len(rooms)


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(0)
    for counts in ({4096: 3}, {1: 5000}, {2049: 7, 2047: 5}, {int(n): int(c) for n, c in zip(rng.integers(1, 4097, 900), rng.integers(1, 40, 900), strict=True)}):
        runs, held = plan(dict(counts), 4096), Counter()
        for number, lengths in runs:
            assert sum(lengths) <= 4096 and number > 0
            for n in lengths:
                held[n] += number
        assert held == Counter(counts)
        assert sum(n for n, _ in runs) <= first_fit([n for n, c in counts.items() for _ in range(c)], 4096)


@pytest.mark.parametrize("words", [0, 1000])
def test_bpe_against_tiktoken(spark, words):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.Vocabulary(spark, path)
    docs = frame(spark).where("doc_id < 120 OR doc_id > 400").where("doc_id NOT IN (401, 402)" if words == 0 else "true")
    got = bpe.encode(docs, vocabulary, P.PATTERN, words=words).select("text", "ids", bpe.decode(vocabulary, F.col("ids")).alias("back")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert list(r.ids) == own.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    if words:
        assert bpe.encode(empty(spark), vocabulary, P.PATTERN).collect() == []


def test_bpe_plan_does_not_hold_the_ranks(spark):
    vocabulary = bpe.Vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.encode(frame(spark), vocabulary, P.PATTERN, words=1000).select("ids")
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 100_000


def test_encoder_does_not_go_through_its_caches():
    import public_tokenizers

    from sparkjson.llm.tokens import Encoder

    class Cache(dict):
        def keys(self):
            raise AssertionError("the whole cache is read for each batch")

    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encode.chunks, encode.pieces = Cache(), Cache()
    texts = ["The cat, ÀÉß x1 (a) a.b", "the CAT, Straße! 12", "", "日本 x"]
    want = [encode.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode(texts)] == want and [x.tolist() for x in encode(texts[::-1])] == want[::-1]
