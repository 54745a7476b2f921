"""Near-duplicate documents: MinHash bands propose pairs, a sequential Bayesian test on the
signatures prunes them, the full shingle sets confirm what is left.

1. A task turns each whole text into its set of distinct shingles (64-bit hashes), a MinHash
   signature and a key of the set.  Equal sets are one class; its smallest id goes on alone.
2. ``hashes / rows`` bands of the signature are the buckets.  Every member of a bucket is paired
   with one hub of the bucket (its smallest id), never with all the others.
3. For each pair the signatures are compared ``step`` hashes at a time.  With a uniform prior
   the similarity given m equal hashes of n is Beta(m + 1, n - m + 1); the pair is dropped as
   soon as P(similarity >= threshold) falls below ``miss``.
4. Survivors are confirmed on the full sets in exact integer arithmetic.
5. Where documents sharing a hub lie in several components, the links between these are found
   by an exact overlap count on the documents' differences from the hub.  Inside a component no
   further pair can change the result, so none is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import gathered, stash
from .words import mix, shingle_set

WORDS = 5
PERCENT = 75
HASHES = 128
ROWS = 4
STEP = 16
MISS = 1e-6
_SEED = 20_011


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(_SEED))
    return (base[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (base[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], n_hashes: int = HASHES) -> np.ndarray:
    """MinHash signatures (rows x ``n_hashes``, unsigned 32-bit) of non-empty sets."""
    a, b = _coefficients(n_hashes)
    out = np.empty((len(sets), n_hashes), np.uint32)
    block: list[int] = []

    def close() -> None:
        flat = np.concatenate([sets[i] for i in block])
        starts = np.cumsum([0] + [len(sets[i]) for i in block[:-1]])
        low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
        for k in range(n_hashes):
            h = low * a[k] + b[k]
            h ^= h >> np.uint32(15)
            h ^= high
            h *= np.uint32(0x9E3779B1)
            out[block, k] = np.minimum.reduceat(h, starts)

    size = 0
    for i, s in enumerate(sets):
        block.append(i)
        size += len(s)
        if size > 20_000:
            close()
            block, size = [], 0
    if block:
        close()
    return out


def least_matches(n_hashes: int, step: int, percent: int, miss: float) -> list[int]:
    """For n = step, 2 step, ...: the fewest equal hashes of n with which a pair stays.

    P(Beta(m + 1, n - m + 1) >= t) equals P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(step, n_hashes + 1, step):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


def plausible(sig_a: np.ndarray, sig_b: np.ndarray, step: int = STEP, percent: int = PERCENT,
              miss: float = MISS) -> np.ndarray:
    """Which pairs of signatures survive every step of the sequential test."""
    alive = np.arange(len(sig_a))
    matches = np.zeros(len(sig_a), np.int64)
    for k, least in enumerate(least_matches(sig_a.shape[1], step, percent, miss)):
        cols = slice(k * step, (k + 1) * step)
        matches[alive] += (sig_a[alive, cols] == sig_b[alive, cols]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    keep = np.zeros(len(sig_a), bool)
    keep[alive] = True
    return keep


def document_sketches(docs: DataFrame, words: int = WORDS, n_hashes: int = HASHES) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n_shingles, set_key, sig)``; an empty set has NULL key and signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", 4 << 20):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full], n_hashes)):
                    keys[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        sketch, "doc_id long, n_shingles long, set_key binary, sig binary")


def _survivors(pairs: DataFrame, reps: DataFrame, percent: int, step: int, miss: float, n_hashes: int) -> DataFrame:
    """Pairs ``(a, b)`` that pass the size bound and the sequential test on the signatures."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig_a, sig_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, n_hashes)
                            for c in ("sig_a", "sig_b"))
            keep = pa.array(plausible(sig_a, sig_b, step, percent, miss))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
            .select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a long, b long"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs ``(a, b)`` with 100 * |A & B| >= percent * |A | B| on the full shingle sets."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, None
        for batch in gathered(batches, "text_b", 4 << 20):
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
                if a != last:
                    last, set_a = a, shingle_set(ta, words)
                set_b = shingle_set(tb, words)
                both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(set_a) + len(set_b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    text_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return (text_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))


def _overlaps(strays: pd.DataFrame, members: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Linked pairs (stray, member) of different components, from differences to a common hub.

    Per stray, one pass over the posting lists of its elements counts |Dx & Dm| for all members;
    |X & M| follows from |X ^ M| = |Dx| + |Dm| - 2 |Dx & Dm|."""
    diffs = [np.frombuffer(d, np.uint64) for d in members["diff"]]
    sizes = np.array([len(d) for d in diffs], np.int64)
    elements = np.concatenate(diffs) if diffs else np.empty(0, np.uint64)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], np.repeat(np.arange(len(diffs)), sizes)[order]
    ids, comps, counts = (members[c].to_numpy() for c in ("doc", "component", "n"))
    for doc, comp, n, diff in zip(strays["doc"], strays["component"], strays["n"], strays["diff"]):
        own = np.frombuffer(diff, np.uint64)
        lo, hi = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
        spans = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=len(ids))
        apart = len(own) + sizes - 2 * common
        both = (n + counts - apart) // 2
        for k in np.flatnonzero((100 * both >= percent * (n + counts - both)) & (comps != comp)):
            yield int(doc), int(ids[k])


def _links_between_components(pairs: DataFrame, found: DataFrame, texts: DataFrame, words: int, percent: int,
                              cell_bytes: int = 16 << 20) -> DataFrame:
    """Links missed by pairing with hubs alone: between documents that share a hub but no component.

    Documents of one bucket were both paired with its hub h, and near copies differ little from
    it, so each is held as its difference D from h's set.  Documents outside h's component are
    matched against all documents paired with h, in cells of bounded size, by counting shared
    elements of the differences: exact, and no pair is written unless it is a link."""
    label = found.withColumnRenamed("id", "doc")
    near = pairs.select(F.col("a").alias("hub"), F.col("b").alias("doc")).unionAll(
        pairs.select(F.col("a").alias("hub"), F.col("a").alias("doc")).distinct())
    near = near.join(label, "doc", "left").select("hub", "doc", F.coalesce("component", "doc").alias("component"))
    hub_of = near.filter("hub = doc").select("hub", F.col("component").alias("hub_component"))
    split = near.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")) \
        .filter("lo <> hi and n > 2").select("hub")
    rows = near.join(hub_of, "hub").join(split, "hub", "left_semi")
    held = rows.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc") \
        .join(texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("hub_text")), "hub") \
        .select("hub", "doc", "component", F.expr("component <> hub_component").alias("stray"), "text", "hub_text")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = None, None
        for batch in gathered(batches, "text", 4 << 20):
            n, diff = [], []
            for hub, text, hub_text in zip(*(batch.column(c).to_pylist() for c in ("hub", "text", "hub_text"))):
                if hub != last:
                    last, base = hub, shingle_set(hub_text, words)
                own = shingle_set(text, words)
                n.append(len(own))
                diff.append(np.setxor1d(own, base, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("hub", "doc", "component", "stray")), pa.array(n, pa.int64()), pa.array(diff, pa.binary())],
                ["hub", "doc", "component", "stray", "n", "diff"])

    diffs = stash(held.mapInArrow(differences, "hub long, doc long, component long, stray boolean, n long, diff binary"), "differences")
    cells = diffs.groupBy("hub").agg(F.sum(F.length("diff")).alias("size")) \
        .select("hub", F.ceil(F.greatest(F.col("size"), F.lit(1)) / F.lit(cell_bytes)).cast("int").alias("cells"))
    placed = diffs.join(cells, "hub").withColumn("cell", F.expr("cast(pmod(hash(doc), cells) as int)"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    cols = ["doc", "component", "n", "diff"]
    crossed = placed.filter("stray").select("hub", F.col("cell").alias("i"), everywhere.alias("j"), F.lit(True).alias("query"), *cols) \
        .unionAll(placed.select("hub", everywhere.alias("i"), F.col("cell").alias("j"), F.lit(False), *cols))

    def match(cell: pd.DataFrame) -> pd.DataFrame:
        links = _overlaps(cell[cell["query"]], cell[~cell["query"]], percent)
        return pd.DataFrame(list(links), columns=["a", "b"], dtype="int64")

    return crossed.groupBy("hub", "i", "j").applyInPandas(match, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, n_hashes: int = HASHES,
                    rows: int = ROWS, step: int = STEP, miss: float = MISS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per id.

    Documents are linked when their shingle sets have Jaccard similarity of ``percent`` or more;
    ``component_id`` is the smallest id reachable over links, ``kept`` marks it.  A NULL or blank
    text has an empty set and is linked with nothing.  Equal texts are linked.  Rows with a NULL id
    have no identity and are left out; rows repeating an id count as one document if their texts are equal.
    Other columns are ignored.  A pair at the threshold shares no band with probability
    (1 - 0.75^4)^32 = 5e-6, one at 0.8 with 5e-8."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    sketched = stash(document_sketches(texts, words, n_hashes), "sketches")
    classes = sketched.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = stash(sketched.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
                   .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"),
                           F.col("set_key").isNull().alias("blank")).distinct(), "classes")
    reps = sketched.filter("set_key is not null").dropDuplicates(["doc_id"]).join(
        member.filter("rep = doc_id and not blank").select("doc_id").distinct(), "doc_id", "left_semi") \
        .select("doc_id", "n_shingles", "sig")
    bands = n_hashes // rows
    width = 4 * rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                                 lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * width + 1, F.lit(width)))))
    keyed = reps.select("doc_id", band.alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).filter("n > 1")
    buckets = stash(keyed.join(shared, "key").select("key", "doc_id", "hub"), "buckets")
    reps = stash(reps.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"), "representatives")

    def links(pairs: DataFrame) -> DataFrame:
        return confirmed(_survivors(pairs, reps, percent, step, miss, n_hashes), texts, words, percent)

    pairs = stash(buckets.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    edges = stash(confirmed(_survivors(pairs, reps, percent, step, miss, n_hashes), texts, words, percent), "links")
    found = stash(components(edges), "components")
    more = stash(_links_between_components(pairs, found, texts, words, percent), "more")
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
    return member.join(found.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")) \
        .withColumn("kept", F.expr("doc_id = component_id"))


def unique_documents(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group (its smallest id), unchanged.

    Rows that repeat an id are one document: one of them stays.  Rows without an id cannot be named in
    a group and stay."""
    gone = stash(near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct(), "duplicates")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = stash(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(
        left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
