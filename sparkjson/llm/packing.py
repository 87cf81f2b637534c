"""Best-fit packing by linear grouping.

Only how many pieces have each length matters for the plan, so the driver plans on a histogram of at most
``capacity`` lengths, whatever the number of documents.  Large lengths are put into groups of equal cardinality and
rounded up to the longest of their group; configurations of the few rounded sizes are chosen by a bounded knapsack,
fullest first, each used as often as the counts allow.  The actual lengths of a group then take its places, longest
first, and all small lengths, longest first, go to the open sequence with the least room that is enough.

The plan is a list of runs (number of sequences, lengths in one of them).  A piece finds its sequence from its rank
among the pieces of its length; ranks come from counts by (length, hash bucket), so that a length which a third of
all pieces share is dealt over many tasks.

Null text: empty, which gives the end id only.  Rows that repeat a doc_id, or have none, are packed as documents of
their own, told apart by their digest and order.  An empty table gives no rows.  A very long text is cut into pieces of
``capacity``.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, documents, materialize
from .tokens import encoder

BATCH_ROWS = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and end id, cut into pieces of ``capacity`` only if there are more; one row per piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, body in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids = np.append(body, np.uint32(end_id)).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for name, value in zip(out, (doc, n, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()], list(out))

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(cut, PIECES)


#: Numbers of groups, and shares of the capacity from which a length is large, that ``plan`` tries.
SETTINGS = ((12, 1 / 8), (24, 1 / 8), (24, 1 / 4), (24, 1 / 2))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (sequences, lengths of each) that hold ``counts[length]`` pieces of each length: the best of SETTINGS."""
    return min((grouped_plan(counts, capacity, *s) for s in SETTINGS), key=lambda runs: sum(n for n, _ in runs))


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[int, tuple[int, ...]]]:
    """One plan by linear grouping."""
    runs: list[tuple[int, tuple[int, ...]]] = []
    left = Counter({n: c for n, c in counts.items() if c})
    big = sorted((n for n in left if n >= capacity * large), reverse=True)
    # Linear grouping: equal numbers of pieces, rounded up to the longest of the group.
    total, member, queues = sum(left[n] for n in big), {}, defaultdict(list)
    seen = 0
    for n in big:
        group = seen * groups // max(1, total)
        member[n] = group
        queues[group].append([n, left[n]])
        seen += left[n]
    rounded = {g: q[0][0] for g, q in queues.items()}
    supply = {g: sum(c for _, c in q) for g, q in queues.items()}

    def configuration() -> tuple[int, ...]:
        """The groups of one sequence: the largest rounded size that is left, then the fullest choice of the rest."""
        first = max((g for g in supply if supply[g]), key=lambda g: rounded[g])
        room = capacity - rounded[first]
        best: dict[int, tuple[int, ...]] = {0: ()}
        for g in sorted((g for g in supply if supply[g]), key=lambda g: -rounded[g]):
            size, most = rounded[g], supply[g] - (g == first)
            for used in sorted(best, reverse=True):
                for k in range(1, min(most, (room - used) // size) + 1):
                    best.setdefault(used + k * size, best[used] + (g,) * k)
        return (first, *best[max(best)])

    open_runs: list[list] = []  # number, lengths
    while any(supply.values()):
        config = Counter(configuration())
        times = min(supply[g] // k for g, k in config.items())
        # Actual lengths take the places; a run ends where one of its places changes its length.
        places = [g for g, k in config.items() for _ in range(k)]
        taken = {g: [] for g in config}
        for g, k in config.items():
            need = times * k
            supply[g] -= need
            while need:
                head = queues[g][0]
                use = min(need, head[1])
                taken[g].append([head[0], use])
                head[1] -= use
                need -= use
                if not head[1]:
                    queues[g].pop(0)
        done = 0
        streams = []  # each place takes its own stretch of the group's pieces
        for g, k in config.items():
            flat = taken[g]
            for _ in range(k):
                stretch, need = [], times
                while need:
                    use = min(need, flat[0][1])
                    stretch.append([flat[0][0], use])
                    flat[0][1] -= use
                    need -= use
                    if not flat[0][1]:
                        flat.pop(0)
                streams.append(stretch)
        assert len(streams) == len(places)
        while done < times:
            step = min(s[0][1] for s in streams)
            open_runs.append([step, tuple(s[0][0] for s in streams)])
            for s in streams:
                s[0][1] -= step
                if not s[0][1]:
                    s.pop(0)
            done += step

    # Small lengths: best fit, longest first, into the least room that is enough.
    by_room: dict[int, list[list]] = defaultdict(list)
    for number, lengths in open_runs:
        by_room[capacity - sum(lengths)].append([number, lengths])
    rooms = sorted(by_room)
    for n in sorted((n for n in left if n < capacity * large), reverse=True):
        need = left[n]
        while need:
            at = np.searchsorted(rooms, n)
            if at == len(rooms):
                each = capacity // n
                full, rest = divmod(need, each)
                fresh = [(full, (n,) * each), (1, (n,) * rest)]
                need = 0
                for number, lengths in fresh:
                    if number and lengths:
                        _open(by_room, rooms, capacity - n * len(lengths), number, lengths)
                continue
            room = rooms[at]
            number, lengths = by_room[room].pop()
            each = min(room // n, max(1, need // number))
            use = min(number, need // each)
            if use < number:
                by_room[room].append([number - use, lengths])
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            _open(by_room, rooms, room - n * each, use, lengths + (n,) * each)
            need -= use * each
    for stack in by_room.values():
        runs += [(number, lengths) for number, lengths in stack]
    return runs


def _open(by_room: dict, rooms: list, room: int, number: int, lengths: tuple) -> None:
    if room not in by_room:
        rooms.insert(int(np.searchsorted(rooms, room)), room)
    by_room[room].append([number, lengths])


def plan_table(runs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces of that length in a sequence), one row a run and length."""
    out, rank, sequence = [], Counter(), 0
    for number, lengths in runs:
        for n, each in Counter(lengths).items():
            out.append((n, rank[n], number * each, sequence, each))
            rank[n] += number * each
        sequence += number
    return out


#: Rows of one length and bucket, on the average, if all rows had one length.
BUCKET_ROWS = 20_000


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``rank``, from 0, among the rows of the same length, without a task that sees a whole length."""
    buckets = max(16, total // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("inside")).drop("bucket", "first", "inside")


#: Rows of the plan that are broadcast, 40 bytes each.
MOST_BROADCAST = 1_000_000


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` (PIECES) with sequence_id and offset; at most ``capacity`` in a sequence, no gaps from 0."""
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan_table(plan(counts, capacity))
    # Places are bounded by the capacity and the number of runs, not by documents: they grow with the lengths that occur.
    places = spark.createDataFrame(table, "length long, from_rank long, ranks long, sequence long, each long")
    at = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("ranks"))
    seated = (
        ranked(rows, sum(counts.values()))
        .join((F.broadcast(places) if len(table) <= MOST_BROADCAST else places).withColumnRenamed("length", "of"), (F.col("length") == F.col("of")) & at)
        .withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each")).cast("long"))
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return seated.select(*rows.columns, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    with batches_of(docs.sparkSession, BATCH_ROWS):
        cut = materialize(pieces(docs, vocabulary, end_id, capacity), "pieces")
    return pack(cut, capacity)


def op4_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
