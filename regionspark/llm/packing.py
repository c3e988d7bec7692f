"""Best-fit packing planned on the histogram of lengths.

1. Every text becomes ids followed by an end id; only texts longer than a sequence are cut, into full pieces and a rest.
   A piece is kept as its length and checksum, so what follows moves a few bytes for each piece; on request it keeps its
   ids, and ``sequences`` puts them together.
2. The plan sees counts of pieces by length only (at most ``capacity`` numbers). Lengths are placed in falling order;
   each takes, among the sequences that have room, those with the least room first. Sequences with equal room are
   handled as ranges, so the work depends on the capacity and not on the number of documents. Handling a range of
   sequences with room r for length L leaves it r mod L < r / 2 at most, so a range is handled at most log2(capacity)
   times, and a length splits one range at most: the plan has at most about capacity x log2(capacity) entries.
3. A piece gets its rank among the pieces of its length (bucket counts, prefix sums, rank in the bucket) and joins the
   planned slots on its length and rank: an entry of the plan holds a range of ranks, so both sides meet by blocks of
   ``RANKS`` ranks. The plan's side has its entries and one row for each block of pieces.

Defined cases: a null text counts as empty and is the end id alone; rows that repeat are packed each; rows with a null
id are packed like the others; very long texts are cut into as many pieces as they need; pieces of one length take their
slots by a hash of id and piece, and all orders of them use as many sequences; an empty table gives an empty table. Only
the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, ends_of, slices
from .common import cut, offsets_by_bucket, partitions, tidied

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Ranks in one block of the join with the plan, and rows of the plan's side up to which it is broadcast.
RANKS, BROADCAST_ROWS = 4096, 200_000


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with its ids on request."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        end = int(end_id).to_bytes(4, "little")
        for part in parts:
            ids, position = part.column(0).to_pylist(), 0
            for some in slices(part.column(1)):
                encoded, counts = coder.column(some)
                raw, cuts = encoded.astype("<i4", copy=False).tobytes(), (4 * ends_of(counts)).tolist()
                rows: list[tuple] = []
                for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                    stream = raw[first:last] + end
                    rows += [
                        (ids[position], k, at // 4, len(cut_ids) // 4, zlib.crc32(cut_ids), *([np.frombuffer(cut_ids, "<i4")] if keep_ids else []))
                        for k, at in enumerate(range(0, len(stream), 4 * capacity))
                        if (cut_ids := stream[at : at + 4 * capacity])
                    ]
                    position += 1
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), PIECES + ", ids array<int>" * keep_ids)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in a sequence, used before): pieces of ``length`` with ranks
    from the first on fill, so many in each, the sequences from the first on, behind what they hold already."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, sequences)
    made, entries = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, sequences: int, room: int) -> None:
            """Fills the range, or as much of it as there are pieces for; what is not touched keeps its room."""
            nonlocal left, rank
            each = room // length
            full = min(sequences, left // each)
            if full:
                entries.append((length, rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                ranges[room - each * length].append((first, full))
            if full < sequences and left:
                entries.append((length, rank, first + full, left, capacity - room))
                ranges[room - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < sequences:
                ranges[room].append((first + full, sequences - full))

        for room in range(length, capacity + 1):
            if not left:
                break
            held, ranges[room] = ranges[room], []
            for k, (first, sequences) in enumerate(held):
                if not left:
                    ranges[room] += held[k:]
                    break
                place(first, sequences, room)
        if left:
            new = -(-left // (capacity // length))
            first, made = made, made + new
            place(first, new, capacity)
    return np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)


def ranked(found: DataFrame, capacity: int) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their rank within their length, and the counts by length; no window holds a whole length."""
    buckets = max(64, partitions(found.sparkSession))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    starts = offsets_by_bucket(sizes, "length", "bucket", "n", "first").select("length", "bucket", "first")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    out = found.withColumn("place", F.row_number().over(inside)).join(starts, ["length", "bucket"])
    return out.withColumn("rank", F.col("first") + F.col("place") - 1).drop("bucket", "place", "first"), counts


def planned_slots(spark: SparkSession, counts: dict[int, int], capacity: int) -> DataFrame:
    """The plan as rows (length, block, first, upto, each, sequence, used): pieces of ``length`` with ranks from first to
    before upto, as far as they are in the block, take ``each`` places in a sequence from ``sequence`` on, behind what is
    used there."""
    entries = plan(counts, capacity)
    same = np.append(entries[1:, 0] == entries[:-1, 0], False) if len(entries) else np.zeros(0, dtype=bool)
    upto = np.where(same, np.append(entries[1:, 1], 0), [counts[int(n)] for n in entries[:, 0]]) if len(entries) else np.zeros(0, dtype=np.int64)
    blocks = (upto - 1) // RANKS - entries[:, 1] // RANKS + 1
    rows = [[int(x) for x in (length, first, last, each, sequence, used)] for (length, first, sequence, each, used), last in zip(entries.tolist(), upto.tolist(), strict=True)]
    slots = spark.createDataFrame(rows, "length long, first long, upto long, each long, sequence long, used long")
    of_block = F.explode(F.sequence(F.floor(F.col("first") / RANKS), F.floor((F.col("upto") - 1) / RANKS)))
    slots = slots.withColumn("block", of_block)
    return F.broadcast(slots) if blocks.sum() <= BROADCAST_ROWS else slots


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, with its ids on request."""
    found = cut(pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids))
    rows, counts = ranked(found, capacity)
    slots = planned_slots(docs.sparkSession, counts, capacity)
    met = rows.withColumn("block", F.floor(F.col("rank") / RANKS)).join(slots, ["length", "block"])
    met = met.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("upto"))).withColumn("behind", F.col("rank") - F.col("first"))
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(F.col("behind") / F.col("each"))).alias("sequence_id"),
        (F.col("used") + F.col("behind") % F.col("each") * F.col("length")).alias("offset"), *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of every sequence, from packed pieces with their ids; a sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
