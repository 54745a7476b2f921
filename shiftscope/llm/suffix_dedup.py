"""Passages that repeat across documents, found with an enhanced suffix array.

A byte is removed when it is covered by a ``length``-byte string (50) that also starts in a document with a
smaller id.  The work is dealt so that equal strings meet without sorting the suffixes of the corpus together:

1. Exact copies of a whole text are one class; only its smallest id goes on.
2. Every string of ``length`` bytes is represented by the smallest hash among the ``GRAM``-byte grams in it,
   its anchor (winnowing: a function of the string alone).  Anchors that lie in two documents are found
   by a shuffle on the hash; a task sends each anchor that it already knows as shared only once.
3. Around each shared anchor lie the strings it represents: its context, at most ``2 * length - GRAM`` bytes.
   Contexts meet by the anchor's hash; a task keeps of equal contexts the smallest id's and settles the others.
4. There, the suffixes that start these strings are sorted; the common-prefix lengths of neighbours form an
   interval tree, which a stack scan walks.  An interval with diverse left neighbours is a maximal repeat: all
   its occurrences share ``lcp`` bytes and not all of them can be extended to the left.  Repeats that can be
   extended are covered by their extension and are skipped.  The occurrences outside the smallest document are removed.
5. The spans of a document are merged and cut out of its whole text.

Limits: an id must name one text (rows repeating an id must agree on it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered, stash
from .words import mix

LENGTH, GRAM = 50, 24
#: parts per shuffle partition; a task works on one part at a time
#: parts of the first shuffle per shuffle partition, and the bytes of text beyond which there are more; the second has four times as many
_PARTS, _PART_BYTES = 8, 4 << 20
#: stands for the documents of a batch that know of a shared anchor already
_KNOWN = np.iinfo(np.int64).min
_BATCH = 2 << 20
_WHOLE = (1 << 31) - 1
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number (short by seven positions)."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    return x


def string_hashes(x8: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
    """Hash of the ``length`` (at least 8) bytes from each position in ``at``."""
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] != length - 8:
        offsets.append(length - 8)
    out = None
    for k, o in enumerate(offsets):
        part = x8[at.start + o:at.stop + o] if isinstance(at, slice) else x8[at + o]
        part = part * _C[k % 7]
        part ^= part >> np.uint64(29)
        out = part if out is None else (out + part) * _C[(k + 3) % 7]
    return mix(out)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(hash, position, first, last)`` of the anchors of the documents ``data[starts:ends]``; the strings an
    anchor represents start at ``first .. last``."""
    empty = np.empty(0, np.int64)
    long = ends - starts >= length
    if not long.any():
        return np.empty(0, np.uint64), empty, empty, empty
    n = len(data) - gram + 1
    x8 = eights(data)
    hashes = string_hashes(x8, slice(0, n), gram)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    # sliding minimum over the grams of a string, by doubling
    width, reach = length - gram + 1, 1
    low = key
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[long]] += 1
    np.add.at(inside, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:len(low)], dtype=np.int8))
    chosen = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    position = chosen[edge]
    return hashes[position], position, at[edge], at[np.concatenate((edge[1:], [len(at)])) - 1]


def lcp_intervals(lcp: np.ndarray, docs: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan: ``(lcp, first, last, smallest doc)`` of every interval of common prefix ``least`` or more.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i; ``lcp[0]`` is 0."""
    stack: list[list[int]] = []  # [lcp, first, smallest doc]
    values, owner = lcp.tolist(), docs.tolist()
    n = len(values)
    for i in range(1, n + 1):
        now = values[i] if i < n else 0
        first, low = i - 1, owner[i - 1]
        while stack and stack[-1][0] > now:
            height, first, inner = stack.pop()
            low = min(low, inner)
            yield height, first, i - 1, low
            if stack and stack[-1][0] >= now:
                stack[-1][2] = min(stack[-1][2], low)
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = min(stack[-1][2], low)
            else:
                stack.append([now, first, low])


def maximal_repeats(data: np.ndarray, at: np.ndarray, ends: np.ndarray, left: np.ndarray, docs: np.ndarray, least: int,
                    widest: int) -> list[tuple[int, np.ndarray, int]]:
    """``(lcp, occurrences, smallest doc)`` of the maximal repeats among the suffixes ``data[at:ends]``.

    ``left`` holds the byte before each suffix, or a number of its own where there is none; occurrences
    index into ``at``.  Suffixes count up to ``widest`` bytes."""
    if len(at) < 2:
        return []
    size = np.minimum(ends - at, widest)
    column = np.arange(widest)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(widest, np.uint8))), widest)[at]
    rows[column >= size[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{widest}").ravel(), kind="stable")
    rows, size, left, docs = rows[order], size[order], left[order], docs[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), widest)
    lcp = np.concatenate(([0], np.minimum(common, np.minimum(size[1:], size[:-1]))))
    lcp[lcp < least] = 0
    # diverse to the left: some neighbour in the interval has another byte before it
    change = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    return [(height, order[first:last + 1], low) for height, first, last, low in lcp_intervals(lcp, docs, least)
            if change[last] > change[first]]


def _covered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, length: int, widest: int) -> tuple[np.ndarray, ...]:
    """``(context, offset, size)`` of the spans to remove, for contexts ``data[starts:ends]`` of ``docs``."""
    n = ends - starts - length + 1
    owner = np.repeat(np.arange(len(starts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[owner] + offset
    hashes = string_hashes(eights(data), at, length)
    # suffixes whose string occurs once, in one document only, or always after the same byte need no sorting
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    run = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1))
    before = np.where(offset > 0, data[at - 1].astype(np.int64), 256 + np.arange(len(at)))[order]
    doc = docs[owner][order]
    spread = np.minimum.reduceat(doc, run) != np.maximum.reduceat(doc, run)
    diverse = np.minimum.reduceat(before, run) != np.maximum.reduceat(before, run)
    keep = np.sort(order[np.repeat(spread & diverse, np.diff(np.concatenate((run, [len(order)]))))])
    left = np.where(offset[keep] > 0, data[at[keep] - 1].astype(np.int64), 256 + keep)
    contexts, offsets, sizes = [], [], []
    for height, members, low in maximal_repeats(data, at[keep], ends[owner[keep]], left, docs[owner[keep]], length, widest):
        members = keep[members]
        later = members[docs[owner[members]] > low]
        contexts.append(owner[later])
        offsets.append(offset[later])
        sizes.append(np.full(len(later), height))
    if not contexts:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(contexts), np.concatenate(offsets), np.concatenate(sizes)


def _buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8") for t in texts]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw) + bytes(64), np.uint8), ends - [len(x) for x in raw], ends


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int32()))


def _by_doc(docs: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Rows (doc_id, list, ...) from parallel arrays."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    edge = np.flatnonzero(np.concatenate((docs[1:] != docs[:-1], [True]))) if len(docs) else np.empty(0, np.int64)
    lists = [_lists(v[order], edge + 1) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(docs[edge], pa.int64()), *lists], ["doc_id", *(f"v{k}" for k in range(len(values)))])


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


_SENT = "part int, known boolean, docs binary, owner binary, starts binary, sizes binary, bytes binary"


def _sent(part: int, known: bool, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray | None = None, data: bytes | None = None) -> dict:
    table, owner = np.unique(docs, return_inverse=True)
    return {"part": part, "known": known, "docs": table.astype("<i8").tobytes(), "owner": owner.astype("<u4" if len(table) > 65535 else "<u2").tobytes(),
            "starts": starts.astype("<u4").tobytes(),
            "sizes": None if sizes is None else sizes.astype("<u4" if known else "<u1").tobytes(), "bytes": data}


_SCHEMA = pa.schema([("part", pa.int32()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("docs", "owner", "starts", "sizes", "bytes"))])


def _documents(row: dict) -> np.ndarray:
    table = np.frombuffer(row["docs"], "<i8")
    return table[np.frombuffer(row["owner"], "<u4" if len(table) > 65535 else "<u2")]


def _each(one, need: str):
    """A task that sends the rows of one bounded batch after another; a batch's arrays go with its call.

    Rows without ``need`` (an id, or shared anchors) send nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered((b.filter(pc.is_valid(b.column(need))) for b in batches), "text", _BATCH):
            rows = one(batch)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
    return run


def _send_anchors(length: int, gram: int, parts: int):
    """Texts -> rows for the shuffle on anchor hashes; anchors of two documents of a batch are known as shared.

    Of a hash 32 bits are sent beside its part.  Anchors that agree in them by chance only make contexts
    that are compared in full later; a part's size is bounded, so they stay rare at every size."""
    def one(batch: pa.RecordBatch) -> list[dict]:
        ids = batch.column("doc_id").to_numpy()
        data, starts, ends = _buffer(batch.column("text").to_pylist())
        hashes, position, _, _ = anchors(data, starts, ends, length, gram)
        if not len(hashes):
            return []
        order = np.argsort(hashes, kind="stable")
        hashes, position = hashes[order], position[order]
        # empty texts share their start with the next one, which is the one found
        doc = ids[np.searchsorted(starts, position, "right") - 1]
        edge = np.concatenate(([0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1))
        size = np.diff(np.concatenate((edge, [len(hashes)])))
        shared = np.repeat(np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), size)
        out = []
        if shared.any():
            out.append(_sent(int(doc[shared][0] % parts), True, doc[shared], _low(hashes[shared])))
        # each anchor is sent once a document, a shared one once for all the batch's documents
        first = np.zeros(len(hashes), bool)
        first[edge] = True
        go = np.where(shared, first, first | np.concatenate(([True], doc[1:] != doc[:-1])))
        hashes, doc = hashes[go], np.where(shared, _KNOWN, doc)[go]
        part = _part(hashes, parts)
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            out.append(_sent(int(part[lo]), False, doc[lo:hi], _low(hashes[lo:hi])))
        return out

    return _each(one, "doc_id")


def _by_part(work):
    """A task over rows sorted by part: rows known before pass through, the others go to ``work`` a part at a time.

    Both give parallel arrays ``(documents, value, ...)``, written as rows by document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                for row in batch.slice(k, 128).to_pylist():
                    if held and held[0]["part"] != row["part"]:
                        yield from (_by_doc(*found) for found in work(held))
                        held = []
                    if row["known"]:
                        yield _by_doc(_documents(row), *(np.frombuffer(row[c], "<i4") for c in ("starts", "sizes") if row[c] is not None))
                    else:
                        held.append(row)
        if held:
            yield from (_by_doc(*found) for found in work(held))
    return run


def _shared_anchors(rows: list[dict]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of a part -> documents and the sent bits of their anchors that lie in two documents."""
    docs = [_documents(row) for row in rows]
    source = np.repeat(np.arange(len(rows), dtype=np.int32), [len(d) for d in docs])
    doc = np.concatenate(docs)
    low = np.concatenate([np.frombuffer(row["starts"], "<u4") for row in rows])
    order = np.argsort(low, kind="stable")
    low, doc, source = low[order], doc[order], source[order]
    edge = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    shared = np.minimum.reduceat(source, edge) != np.maximum.reduceat(source, edge)
    keep = np.repeat(shared, np.diff(np.concatenate((edge, [len(low)])))) & (doc != _KNOWN)
    if keep.any():
        yield doc[keep], low[keep].view(np.int32)


def _send_contexts(length: int, gram: int, parts: int):
    """Texts with their shared anchors -> rows for the shuffle of contexts; equal contexts are settled in the batch."""
    widest = 2 * length - gram

    def one(batch: pa.RecordBatch) -> list[dict]:
        ids = batch.column("doc_id").to_numpy()
        data, starts, ends = _buffer(batch.column("text").to_pylist())
        hashes, position, first, last = anchors(data, starts, ends, length, gram)
        at = batch.column("shared")
        counts = at.value_lengths().to_numpy()
        row = np.searchsorted(starts, position, "right") - 1
        known = np.unique((np.repeat(np.arange(len(ids)), counts).astype(np.uint64) << np.uint64(32)) | at.flatten().to_numpy().view(np.uint32))
        own = (row.astype(np.uint64) << np.uint64(32)) | _low(hashes)
        spot = np.searchsorted(known, own)
        go = known[np.minimum(spot, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
        if not go.any():
            return []
        hashes, first, size, row = hashes[go], first[go], (last - first)[go] + length, row[go]
        doc, start = ids[row], first - starts[row]
        x8 = eights(data)
        whole = string_hashes(x8, first, length) + size.astype(np.uint64) * _C[0] + string_hashes(x8, first + size - length, length) * _C[1]
        order = np.lexsort((doc, whole))
        hashes, first, size, doc, start, whole = (x[order] for x in (hashes, first, size, doc, start, whole))
        edge = np.concatenate(([True], whole[1:] != whole[:-1]))
        low = doc[np.flatnonzero(edge)][np.cumsum(edge) - 1]
        settled = doc > low
        out = []
        if settled.any():
            out.append(_sent(int(doc[settled][0] % parts), True, doc[settled], start[settled], size[settled]))
        hashes, first, size, doc, start = (x[~settled] for x in (hashes, first, size, doc, start))
        order = np.argsort(hashes, kind="stable")
        hashes, first, size, doc, start = (x[order] for x in (hashes, first, size, doc, start))
        part = _part(hashes, parts)
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            n = size[lo:hi]
            flat = np.repeat(first[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(_sent(int(part[lo]), False, doc[lo:hi], start[lo:hi], n, data[flat].tobytes()))
        return out

    assert widest < 256
    return _each(one, "shared")


def _removed(length: int, gram: int):
    """Rows of a part -> documents, starts and sizes of the spans to remove."""
    def work(rows: list[dict]) -> Iterator[tuple[np.ndarray, ...]]:
        doc = np.concatenate([_documents(row) for row in rows])
        start = np.concatenate([np.frombuffer(row["starts"], "<u4") for row in rows]).astype(np.int64)
        size = np.concatenate([np.frombuffer(row["sizes"], "<u1") for row in rows]).astype(np.int64)
        data = np.frombuffer(b"".join(row["bytes"] for row in rows) + bytes(64), np.uint8)
        ends = np.cumsum(size)
        context, offset, n = _covered(data, ends - size, ends, doc, length, 2 * length - gram)
        if len(context):
            yield doc[context], (start[context] + offset).astype(np.int32), n.astype(np.int32)
    return work


def _texts(docs: DataFrame) -> DataFrame:
    """Ids and texts, all rows: wherever they meet something by id, Spark moves the texts by the same exchange."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, starts, sizes)``, arrays of byte spans to remove, possibly several rows an id
    and overlapping; a span of size 2^31 - 1 is the whole text.

    The number of parts follows the bytes of text, so a part does not grow with the corpus."""
    source = _texts(docs)
    keyed = source.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    classes = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last")
    copies = stash(keyed.join(classes, "key").filter("doc_id > rep").select("doc_id").distinct(), "copies")
    reps = source.join(copies, "doc_id", "left_anti")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(_PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // _PART_BYTES))
    shared = reps.mapInArrow(_send_anchors(length, gram, parts), _SENT).repartition("part").sortWithinPartitions("part") \
        .mapInArrow(_by_part(_shared_anchors), "doc_id long, v0 array<int>")
    shared = shared.groupBy("doc_id").agg(F.flatten(F.collect_list("v0")).alias("shared"))
    # an outer join, as in the end, so that both read one exchange of the texts; documents without anchors drop out in the task
    spans = source.join(shared, "doc_id", "left").mapInArrow(_send_contexts(length, gram, 4 * parts), _SENT).repartition("part").sortWithinPartitions("part") \
        .mapInArrow(_by_part(_removed(length, gram)), "doc_id long, v0 array<int>, v1 array<int>")
    whole = copies.select("doc_id", F.array(F.lit(0)).alias("v0"), F.array(F.lit(_WHOLE)).alias("v1"))
    return spans.unionAll(whole).toDF("doc_id", "starts", "sizes")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` and, ``with_text``, the
    remaining bytes (``kept binary``; a span may cut a character).

    A NULL text counts as empty.  Texts shorter than ``length`` lose nothing.  A NULL id has no order: nothing is
    removed from it or because of it.  Rows repeating an id must agree on the text and get the same result.
    Contexts that are equal within a batch are told so by 64-bit hashes of their bytes; every other removal is
    decided on bytes."""
    spans = removed_spans(docs, length, gram).groupBy("doc_id").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", _BATCH):
            rows = []
            for text, starts, sizes in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "sizes"))):
                raw = (text or "").encode("utf-8")
                if not starts:
                    rows.append((len(raw), 0, 0, raw))
                    continue
                kept, at, n_spans, removed = [], 0, 0, 0
                end = -1
                for start, size in sorted(zip(starts, sizes)):
                    stop = min(start + size, len(raw))
                    if start > end:
                        n_spans += 1
                        kept.append(raw[at:start])
                    if stop > end:
                        removed += stop - max(start, end)
                        end = at = stop
                kept.append(raw[at:])
                rows.append((len(raw), removed, n_spans, b"".join(kept)))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows])
            blobs = [pa.array([r[3] for r in rows], pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, digest, *blobs],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return _texts(docs).join(spans, "doc_id", "left").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
