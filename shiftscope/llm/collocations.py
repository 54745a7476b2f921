"""Collocations: phrases of two to four words that stand together far more often than their parts.

Two passes over the texts find every phrase with ``least`` or more occurrences.

1. Each batch of texts is turned into its distinct phrases with counts.  A phrase's 64-bit hash names one of
   ``parts`` hash partitions (a power of two that grows with the bytes of text) and a 32-bit number in it.
   The partial counts of a partition are merged into one Misra-Gries summary whose capacity exceeds the
   partition's mass divided by ``least``: all its decrements together stay below ``least``, so no frequent
   phrase is lost.  Phrases that share a number count as one, which can only keep more.  What may be
   frequent is set in a filter of ``FILTER_BITS`` bits, its size the same for every corpus.
2. The texts are read again; phrases in the filter whose sub-phrases are in it too are counted exactly,
   by their words, by a grouped sum that Spark combines before the shuffle and spills.

The filter is the only thing sent to the tasks.  A fuller filter lets more phrases reach the exact count;
it never drops one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import gathered, stash
from .words import mix

LONGEST = 4
LEAST = 30
TOP = 2000
INSIDE_PERCENT = 80
FILTER_BITS = 1 << 28
#: bytes of text per hash partition: fewer phrase occurrences than that, so a task holds 64 MB of counts at most
PART_BYTES = 8 << 20
BATCH_BYTES = 6 << 20
#: a lang's ranking takes the best of so many buckets
BUCKETS = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)

# Characters that end a piece.
BREAKS = ".,;:!?\n\x0b\x0c\r"
_TO_STOP = bytes.maketrans(BREAKS.encode(), b"." * len(BREAKS))


class Batch:
    """The words of one language's texts in a batch, as numbers, with 0 between pieces."""

    def __init__(self, lang: str, texts: list[str]):
        joined = " . ".join(texts).encode("utf-8").lower().translate(_TO_STOP).replace(b".", b" . ")
        coded = pa.array([b".", *joined.split()], pa.binary()).dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        #: the first entry of the dictionary is the break
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8"))
        self.hashes_of_words = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.n_words = int(np.count_nonzero(self.ids))

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: ``(length, whole, hashes)`` by starting place; ``whole`` tells phrases from breaks."""
        word, whole = self.hashes_of_words[self.ids], self.ids > 0
        rolling, inside = word, whole
        for length in range(1, LONGEST + 1):
            if length > 1:
                rolling = mix(rolling[:-1] * _MUL + word[length - 1:])
                inside = inside[:-1] & whole[length - 1:]
            yield length, inside, mix(rolling + np.uint64(length))

    def distinct_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases' hashes, sorted, and their counts."""
        h = np.sort(np.concatenate([h[whole] for _, whole, h in self.hashes()]))
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        return h[starts], np.diff(np.append(starts, len(h))).astype(np.uint32)

    def counted(self, passes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: ``(length, places, counts)`` of the distinct phrases that ``passes(hashes)`` keeps and whose
        sub-phrases are kept, a place being one position of the phrase.  Phrases are told by their words' numbers."""
        kept, code = None, self.ids
        for length, whole, h in self.hashes():
            at = np.flatnonzero(whole if kept is None else whole & kept[:len(whole)] & kept[1:len(whole) + 1])
            at = at[passes(h[at])]
            keys = self.ids[at] if length == 1 else code[at] * np.int64(len(self.words)) + self.ids[at + length - 1]
            _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            yield length, at[first], counts
            kept = np.zeros(len(self.ids) + 1, bool)
            kept[at] = True
            code = np.zeros(len(self.ids), np.int64)
            code[at] = inverse

    def text(self, place: int, length: int) -> str:
        return b" ".join([self.words[i] for i in self.ids[place:place + length]]).decode("utf-8", "replace")


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Batch]]:
    for rows_of in gathered(rows, "text", BATCH_BYTES):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(rows_of.column("lang").to_pylist(), rows_of.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            yield lang, Batch(lang, texts)


def _summed(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct items with summed counts, of items that come in few sorted stretches."""
    order = np.argsort(items, kind="stable")
    items, counts = items[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1]))) if len(items) else np.empty(0, np.int64)
    return items[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def merged_summary(pieces: Iterator[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries merge of partial counts ``(items, counts)``, both unsigned 32-bit: at most ``capacity`` items
    with estimates, and the sum of all decrements, by which an estimate may be too low."""
    items, counts, lost = np.empty(0, np.uint32), np.empty(0, np.int64), 0
    waiting: list[np.ndarray] = []

    def fold() -> None:
        nonlocal items, counts, lost, waiting
        if not waiting:
            return
        # item and count in one number: a plain sort brings equal items together
        pairs = np.sort(np.concatenate(waiting))
        new, weight = _summed((pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
        items, counts = _summed(np.concatenate([items, new]), np.concatenate([counts, weight]))
        waiting = []
        if len(items) > capacity:
            cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            lost += cut
            keep = counts > cut
            items, counts = items[keep], counts[keep] - cut

    held = 0
    for item, count in pieces:
        waiting.append((item.astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64))
        held += len(item)
        if held > max(2 * capacity, 1 << 16):
            fold()
            held = 0
    fold()
    return items, counts, lost


def frequent_filter(texts: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """The bits of all phrases that may occur ``least`` times, and the number of hash partitions."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1
    while parts * PART_BYTES < size and parts < FILTER_BITS >> 10:
        parts *= 2
    part_shift, slot_bits = np.uint64(64 - (parts.bit_length() - 1)), FILTER_BITS // parts
    slot_shift = np.uint32(max(33 - slot_bits.bit_length(), 0))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _batches(rows):
            h, n = batch.distinct_hashes()
            part = (h >> part_shift).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)
            low = ((h << np.uint64(parts.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)
            used, starts = np.unique(part, return_index=True)
            ends = [*starts[1:], len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                 pa.array([n[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["part", "items", "counts"])

    def summarise(group: pa.Table) -> pa.Table:
        counts = group.column("counts").to_pylist()
        mass = sum(int(np.frombuffer(c, np.uint32).sum(dtype=np.int64)) for c in counts)
        pairs = ((np.frombuffer(i, np.uint32), np.frombuffer(c, np.uint32))
                 for i, c in zip(group.column("items").to_pylist(), counts))
        items, estimates, lost = merged_summary(pairs, mass // least + 1)
        bits = np.zeros(max(slot_bits, 8), bool)
        bits[items[estimates + lost >= least] >> slot_shift] = True
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()),
                         "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    partial = texts.mapInArrow(count, "part int, items binary, counts binary")
    slices = stash(partial.groupBy("part").applyInArrow(summarise, "part int, bits binary"), "filter")
    # FILTER_BITS / 8 bytes in all, whatever the corpus
    filled = np.zeros((parts, max(slot_bits // 8, 1)), np.uint8)
    for row in slices.toLocalIterator():
        filled[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return filled, parts


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs(lang, text, ...)`` -> ``(lang, phrase, words, f)``: every phrase of one to four words with
    ``least`` or more occurrences in its lang; and per lang one row with ``words = 0``, whose ``f`` counts
    all its words.  NULL lang: ``und``; NULL and blank texts have no words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.col("text").cast("string").alias("text")).filter("text is not null")
    filled, parts = frequent_filter(texts, least)
    sent = texts.sparkSession.sparkContext.broadcast(filled)
    part_bits, slot_bits = parts.bit_length() - 1, FILTER_BITS // parts
    slot_shift = np.uint32(max(33 - slot_bits.bit_length(), 0))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value

        def passes(h: np.ndarray) -> np.ndarray:
            part = (h >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(h), np.int64)
            slot = ((h << np.uint64(part_bits)) >> np.uint64(32)).astype(np.uint32) >> slot_shift
            return (bits[part, slot >> np.uint32(3)] >> (np.uint8(7) - (slot & np.uint32(7)).astype(np.uint8))) & np.uint8(1) > 0

        for lang, batch in _batches(rows):
            phrases, lengths, counts = [""], [0], [batch.n_words]
            for length, places, n in batch.counted(passes):
                phrases += [batch.text(p, length) for p in places]
                lengths += [length] * len(places)
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(phrases, pa.string()),
                                              pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())], ["lang", "phrase", "words", "f"])

    counted = texts.mapInArrow(count, "lang string, phrase string, words int, f long") \
        .groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return stash(counted.filter((F.col("f") >= least) | (F.col("words") == 0)).select("lang", "phrase", "words", "f"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """``docs(lang, text, ...)`` -> ``(lang, rank, phrase, a, l, r, n, score)``, each lang's best ``top``.

    ``a``, ``l`` and ``r`` are the occurrences of the phrase and of the two parts of its lowest-scoring cut
    (ties: the first cut), ``score = floor(2000000 a / (l + r))`` in whole numbers, ``n`` the words of the
    lang.  A phrase inside a longer frequent one with ``inside_percent`` of its occurrences is left out.
    Ranked by score, then a, both falling, then by the phrase's bytes.  Repeated rows count each time;
    other columns, also clashing ones, are ignored; an empty table gives no rows."""
    f = phrase_counts(docs, least)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = f.filter("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    split = candidates.withColumn("w", F.split("phrase", " ", -1))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    # a candidate's sub-phrases are looked for by the greatest count of a longer one: one row per sub-phrase
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: part(i, n)))))
    covered = split.filter("words >= 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter(
        F.col("outer").isNull() | (100 * wide("outer") < inside_percent * wide("a"))).select("lang", "phrase", "words", "a")
    # parts of the candidates: many may begin or end with one word; skewed partitions are split by Spark
    cuts = kept.withColumn("w", F.split("phrase", " ", -1)).select(
        "lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
            k.alias("k"), part(F.lit(1), k).alias("first"), part(k + 1, F.col("words") - k).alias("rest")))).alias("cut")) \
        .select("lang", "phrase", "a", "cut.*")
    side = lambda key, count: f.filter(f"words between 1 and {LONGEST - 1}").select("lang", F.col("phrase").alias(key), F.col("f").alias(count))
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = Window.partitionBy("lang", "bucket").orderBy(*order)
    few = best.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))) \
        .withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top).drop("rank", "bucket")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = f.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
