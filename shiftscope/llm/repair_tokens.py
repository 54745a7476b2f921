"""Token-id files with Re-Pair grammars.

Documents are dealt into shards by range of doc_id and, inside a shard, in ascending order into blocks of
about ``BLOCK`` tokens.  A block's ids are compressed by Re-Pair: again and again the most frequent
pairs of neighbouring symbols are replaced by new nonterminals, until no pair occurs ``LEAST`` times.  Each round counts
all pairs exactly and replaces those with a ``SPREAD``-th of the greatest count or more; where two replacements would
overlap, the more frequent pair has the place, and a pair that loses too many places so, or shares a place of the round's
lookup table with another, comes again in a later round.  The block stores its rules, the
expansion length of every nonterminal, the document lengths and its first token in the shard, so any range of tokens can be decoded
by expanding only the symbols that cover it.

The file format is a Parquet table of blocks (one row each, columns as in ``FORMAT``), written
and read by Spark, so it lies wherever Spark's file systems reach; numbers are little-endian."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import gathered
from .token_ids import END, encoder, vocabulary_path

#: tokens a block is closed at; the least count of a pair worth a rule; pairs of one round differ in count up to this factor
BLOCK, LEAST, SPREAD = 1 << 20, 16, 16
_BINS = 20

FORMAT = ("shard int, block int, n_docs int, n_tokens long, first long, doc_ids binary, doc_lengths binary, n_symbols int, base int, "
          "rules binary, expansions binary, symbols binary")


def _frequent_pairs(symbols: np.ndarray, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs among ``codes`` with ``least`` occurrences that do not overlap each other, and their counts."""
    ordered = np.sort(codes)
    # a code that stands again ``least - 1`` places on: only these are looked at one by one
    starts = np.flatnonzero(ordered[least - 1:] == ordered[:max(len(ordered) - least + 1, 0)])
    pairs = ordered[starts]
    first = np.ones(len(pairs), bool)
    np.not_equal(pairs[1:], pairs[:-1], out=first[1:])
    starts, pairs = starts[first], pairs[first]
    counts = np.searchsorted(ordered, pairs, "right") - starts
    twins = np.flatnonzero((pairs >> np.uint64(32)) == (pairs & np.uint64(0xFFFFFFFF)))
    if len(twins):
        # of a run of n equal symbols, n // 2 pairs can be replaced
        same = np.flatnonzero(symbols[1:] == symbols[:-1])
        heads = np.flatnonzero(np.concatenate(([True], np.diff(same) > 1)))
        half = (np.diff(np.append(heads, len(same))) + 1) // 2
        free = np.bincount(symbols[same[heads]], weights=half, minlength=int(symbols.max()) + 1).astype(np.int64)
        counts[twins] = free[(pairs[twins] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        often = counts >= least
        pairs, counts = pairs[often], counts[often]
    return pairs, counts


def compress(ids: np.ndarray, least: int = LEAST, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, int]:
    """``(symbols, rules (n x 2), base)``: nonterminal ``base + k`` stands for the two symbols of ``rules[k]``.

    In the end no two neighbouring symbols occur together ``least`` times without overlap.  A round counts the pairs
    that hold a symbol of the last round, and those that waited: no other pair can have become frequent."""
    symbols = np.array(ids, np.uint32)
    base = int(symbols.max()) + 1 if len(symbols) else 0
    rules: list[np.ndarray] = []
    fresh, new = base, 0
    place = np.full(1 << _BINS, -1, np.int32)
    waits = np.zeros(1 << _BINS, bool)
    while len(symbols) > 1:
        codes = symbols[:-1].astype(np.uint64)
        codes <<= np.uint64(32)
        codes |= symbols[1:]
        spots = _spot(codes)
        if rules:
            young = symbols >= new
            again = waits.take(spots)
            again |= young[:-1]
            again |= young[1:]
            near = np.flatnonzero(again)
            codes, spots = codes.take(near), spots.take(near)
        else:
            near = np.arange(len(codes))
        if not len(codes):
            break
        pairs, counts = _frequent_pairs(symbols, codes, least)
        if not len(pairs):
            break
        order = np.argsort(-counts, kind="stable")
        wanted = pairs[order[:int(np.count_nonzero(counts >= -(-int(counts.max()) // spread)))]]
        # the most frequent pair of a place in the table has it
        own = _spot(wanted)
        place[own[::-1]] = np.arange(len(wanted), dtype=np.int32)[::-1]
        at = place.take(spots)
        place[own] = -1
        hit = np.flatnonzero(at >= 0)
        at = at[hit]
        real = wanted[at] == codes[hit]
        where, at = _without_overlaps(near[hit[real]], at[real])
        # the most frequent pair has all its places; another must be worth a rule beside it
        worth = np.bincount(at, minlength=len(wanted)) >= least
        keep = worth[at]
        where, at = where[keep], (np.cumsum(worth) - 1)[at[keep]]
        symbols[where] = fresh + at.astype(np.uint32)
        stay = np.ones(len(symbols), bool)
        stay[where + 1] = False
        symbols = symbols[stay]
        wanted = wanted[worth]
        rules.append(np.stack([wanted >> np.uint64(32), wanted & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        new, fresh = fresh, fresh + len(wanted)
        waits[:] = False
        waits[_spot(pairs)] = True
    return symbols, (np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)), base


def _without_overlaps(where: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places of pairs those to replace: at overlaps the lower rank has the place, and in a run
    of equal symbols every other one from the left; what is freed of its better neighbour is looked at again."""
    chosen, ranks = [], []
    while len(where):
        beside = np.diff(where) == 1
        after, before = np.append(beside, False), np.insert(beside, 0, False)
        best = np.ones(len(where), bool)
        best[:-1] &= ~beside | (rank[:-1] <= rank[1:])
        best[1:] &= ~beside | (rank[1:] <= rank[:-1])
        spot = np.flatnonzero(best)
        first = np.concatenate(([True], np.diff(where[spot]) > 1))
        order = np.arange(len(spot))
        spot = spot[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0]
        chosen.append(where[spot])
        ranks.append(rank[spot])
        left = np.ones(len(where), bool)
        left[spot] = False
        left[spot[after[spot]] + 1] = False
        left[spot[before[spot]] - 1] = False
        where, rank = where[left], rank[left]
    return np.concatenate(chosen), np.concatenate(ranks)


def _spot(codes: np.ndarray) -> np.ndarray:
    spots = codes * np.uint64(0x9E3779B97F4A7C15)
    spots >>= np.uint64(64 - _BINS)
    return spots.view(np.int64)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Expansion length of every nonterminal, and all expansions one after another.

    Rules are worked off in stretches that name earlier nonterminals only, such as those of one round."""
    lengths, starts = np.zeros(len(rules), np.int64), np.zeros(len(rules), np.int64)
    flat = np.empty(0, np.uint32)
    named = rules.max(axis=1).astype(np.int64) - base if len(rules) else np.empty(0, np.int64)
    done = 0
    while done < len(rules):
        late = np.flatnonzero(named[done:] >= done)
        upto = done + int(late[0]) if len(late) else len(rules)
        part = rules[done:upto].reshape(-1).astype(np.int64)
        inner = part >= base
        n = np.ones(len(part), np.int64)
        n[inner] = lengths[part[inner] - base]
        ends = np.cumsum(n)
        # each id of the stretch comes from the expansions so far, or is a plain id
        source = np.repeat(np.where(inner, starts[np.where(inner, part - base, 0)], 0) - (ends - n), n) + np.arange(ends[-1])
        plain = np.repeat(~inner, n)
        new = np.repeat(part, n).astype(np.uint32)
        new[~plain] = flat[source[~plain]]
        lengths[done:upto] = n[::2] + n[1::2]
        starts[done:upto] = len(flat) + np.concatenate(([0], np.cumsum(lengths[done:upto])[:-1]))
        flat = np.concatenate((flat, new))
        done = upto
    return lengths.astype(np.uint32), flat


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    lengths, flat = expansions(rules, base)
    if not len(lengths):
        return symbols
    table = np.concatenate((np.arange(base, dtype=np.uint32), flat))
    starts = np.concatenate((np.arange(base), base + np.concatenate(([0], np.cumsum(lengths[:-1], dtype=np.int64)))))
    sizes = np.concatenate((np.ones(base, np.int64), lengths.astype(np.int64)))
    n = sizes[symbols]
    ends = np.cumsum(n)
    return table[np.repeat(starts[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def token_range(block: dict, start: int, length: int) -> np.ndarray:
    """Ids ``start .. start + length`` of a block row, expanding only the symbols that cover them."""
    symbols = np.frombuffer(block["symbols"], "<u4")
    rules = np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
    base = block["base"]
    sizes = np.ones(len(symbols), np.int64)
    inner = symbols >= base
    sizes[inner] = np.frombuffer(block["expansions"], "<u4")[symbols[inner] - base]
    ends = np.cumsum(sizes)
    lo = int(np.searchsorted(ends, start, "right"))
    hi = int(np.searchsorted(ends, start + length, "left")) + 1
    skip = start - (int(ends[lo - 1]) if lo else 0)
    return expand(symbols[lo:hi], rules, base)[skip:skip + length]


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, block: int = BLOCK) -> None:
    """Encode ``docs(doc_id, text, ...)`` and write the block table to ``path``, ascending by doc_id.

    A NULL or empty text is the end id alone; rows repeating an id are documents of their own, in order
    of their text; a NULL id comes first."""
    voc = vocabulary or vocabulary_path()
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(voc)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        blobs: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            symbols, rules, base = compress(np.frombuffer(b"".join(blobs), "<u4"))
            lengths = np.array([len(x) // 4 for x in blobs], "<u4")
            ids = np.array([np.iinfo(np.int64).min if x is None else x for x in doc_ids], "<i8")
            row = {"shard": shard, "block": number, "n_docs": len(blobs), "n_tokens": int(lengths.sum()), "first": first, "doc_ids": ids.tobytes(),
                   "doc_lengths": lengths.tobytes(), "n_symbols": len(symbols), "base": base, "rules": rules.astype("<u4").tobytes(),
                   "expansions": expansions(rules, base)[0].astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in gathered(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                doc_ids.append(doc_id)
                blobs.append(enc.encode(text) + end)
                size += len(blobs[-1]) // 4
                if size >= block:
                    yield close()
                    doc_ids, blobs, first, size = [], [], first + size, 0
                    number += 1
        if blobs:
            yield close()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.binary()),
                        ("doc_lengths", pa.binary()), ("n_symbols", pa.int32()), ("base", pa.int32()), ("rules", pa.binary()),
                        ("expansions", pa.binary()), ("symbols", pa.binary())])
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FORMAT)
     .write.mode("error").option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, decoded from the files at ``path``."""
    blocks = spark.read.parquet(path)
    # a block knows its first token in its shard; the shards' own starts are one row per written file
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(
        F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["base"]).astype("<u4").tobytes()
                lengths = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                crcs = [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=docs == np.iinfo(np.int64).min), pa.array(ends - lengths + row["first"], pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(shards), "shard") \
        .select((F.col("shard_start") + F.col("first")).alias("first"), "doc_ids", "doc_lengths", "base", "rules", "symbols") \
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
