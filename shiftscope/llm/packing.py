"""Token packing by Karmarkar-Karp multiway differencing.

A task tokenizes whole texts, cuts each document into pieces and packs the pieces it has gathered:
full pieces fill a sequence alone, the others are packed a group at a time.  In a group every piece
is first a partition of its own into k windows, one of them loaded.  The two partitions with the
largest imbalance are merged, the fullest window of one with the emptiest of the other, until one
is left: near-equal windows.  k starts at the group's tokens over the capacity and rises until no window exceeds it.

Groups are cut by a count of pieces, so a group is bounded, needs no shuffle, and the same input
partition always gives the same sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered
from .token_ids import END, encoder, vocabulary_path

CAPACITY = 4096
#: Tails of documents are cut into pieces of at most this many tokens: small pieces even out the windows
PIECE = 512
GROUP = 1500


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, list[list[int]]]:
    """Karmarkar-Karp: ``sizes`` into ``windows`` sets with near-equal sums -> (sums, indexes of each)."""
    # a partition keeps its loaded windows only, in order of load; the rest are empty
    heap: list[tuple[int, int, list[int], list[list[int]]]] = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [n], [[i]]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        a, b = len(sums_a), len(sums_b)
        if a < b:
            sums_a, sets_a, sums_b, sets_b, a, b = sums_b, sets_b, sums_a, sets_a, b, a
        # the fullest window of b meets the emptiest of a (an empty one while there are any)
        free = windows - a
        for j in range(b):
            if j < free:
                sums_a.append(sums_b[j])
                sets_a.append(sets_b[j])
            else:
                k = a - 1 - (j - free)
                sums_a[k] += sums_b[j]
                sets_a[k] = sets_a[k] + sets_b[j] if len(sets_a[k]) < 64 else [*sets_a[k], *sets_b[j]]
        order = sorted(range(len(sums_a)), key=sums_a.__getitem__, reverse=True)
        sums_a = [sums_a[k] for k in order]
        sets_a = [sets_a[k] for k in order]
        low = sums_a[-1] if len(sums_a) == windows else 0
        tick += 1
        heapq.heappush(heap, (low - sums_a[0], tick, sums_a, sets_a))
    if not heap:
        return np.zeros(0, np.int64), []
    return np.array(heap[0][2]), heap[0][3]


def packed(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sets of indexes, none over ``capacity`` tokens; the count of windows rises whenever it is exceeded.

    Sizes over the capacity are an error: cut them first."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError(f"a piece of {max(sizes)} tokens does not fit into {capacity}")
    windows = -(-sum(sizes) // capacity)
    while True:
        sums, sets = difference(sizes, windows)
        if sums.max() <= capacity:
            return sets
        windows += 1


def pieces(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: full sequences, then a tail in near-equal parts."""
    full, tail = divmod(n, capacity)
    parts = -(-tail // piece)
    return [capacity] * full + [tail // parts + (i < tail % parts) for i in range(parts)]


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, piece: int = PIECE,
                     group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, ``with_ids``, the piece's ids as little-endian unsigned 32-bit bytes.

    A NULL or empty text is the end id alone.  Repeated rows are packed each; a NULL id passes
    through.  Every id of a document lies in exactly one piece; no sequence exceeds ``capacity``."""
    path = vocabulary or vocabulary_path()
    names = [x.split()[0] for x in OUT.split(", ")]
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        sequence = TaskContext.get().partitionId() << 33
        held: list[list] = []

        def emit(rows: list[list]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
            blobs = [pa.array([r[7] for r in rows], pa.binary())] if with_ids else []
            return pa.RecordBatch.from_arrays(columns + blobs, names + ["ids"] * with_ids)

        def pack(rows: list[list]) -> list[list]:
            nonlocal sequence
            for members in packed([r[2] for r in rows], capacity):
                offset = 0
                for i in sorted(members):
                    rows[i][5], rows[i][6] = sequence, offset
                    offset += rows[i][2]
                sequence += 1
            return rows

        for batch in gathered(batches, "text", 4 << 20):
            done: list[list] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                total, start = len(ids) // 4, 0
                for n in pieces(total, capacity, piece):
                    own = ids[4 * start:4 * (start + n)]
                    row = [doc_id, start, n, zlib.crc32(own), total, -1, 0, own if with_ids else None]
                    if n == capacity:
                        row[5] = sequence
                        sequence += 1
                        done.append(row)
                    else:
                        held.append(row)
                    start += n
            # the last group keeps its rest for the next batch
            while len(held) >= 2 * group:
                done += pack(held[:group])
                held = held[group:]
            if done:
                yield emit(done)
        if held:
            yield emit(pack(held))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, OUT + ", ids binary" * with_ids)
