"""Quality rules: counts over words and lines of a document, and lines that too many documents
of a host share.

A task reads each whole text once and gives the base counts, one row of (line hash, words) per
distinct normalised line, and a hash of the whole text.  Spark then counts, per host and line, the
distinct texts: copies of one text count once, texts that differ anywhere count each.  Lines above the limit are removed from the texts, and a document of which
too little is left is rejected.  The first document that holds a line (smallest id) keeps it, so no
content leaves the corpus altogether.  The lines are cut by Spark functions that build the same hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gathered, stash
from .words import HASHES, windows

WINDOW = 5
#: Base rule: fewer words fail, and more than so many percent of words in repeated windows
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line is removed when more distinct documents of a host hold it, however large the host is
LINE_LIMIT = 10
#: A document is rejected when fewer than so many percent of its words, or fewer than MIN_WORDS, are left
LEAST_PERCENT_LEFT = 20
_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEED = 42  # of Spark's xxhash64

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _hash(data: bytes) -> int:
    """As Spark's ``xxhash64``: signed."""
    value = xxhash.xxh64_intdigest(data, _SEED)
    return value - (value >> 63 << 64)


def base_counts(text: str | None) -> tuple[tuple[int, int, int, int, int], list[tuple[int, int]]]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` and the distinct
    normalised lines as (hash, words).  A normalised line is its lower-cased words joined by one space."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    letters = b"".join(words)
    chars = len(letters) if letters.isascii() else len(letters.decode("utf-8"))
    symbols = len(raw.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in raw.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        dup += line in seen
        seen.add(line)
        key = _hash(b" ".join(parts).lower())
        lines[key] = lines.get(key, 0) + len(parts)
    repeat = 0
    if len(words) > WINDOW:
        grams = windows(np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)), WINDOW)
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(grams) + 1, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeat = int((np.cumsum(cover) > 0).sum())
    return (len(words), chars, symbols, dup, repeat), list(lines.items())


def line_tables(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, host)`` -> base counts, ``lines`` and ``content``, a hash of the whole text, per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", 4 << 20):
            base, lines, content = [], [], []
            for t in batch.column("text").to_pylist():
                counts, own = base_counts(t)
                base.append(counts)
                lines.append(own)
                content.append(_hash((t or "").encode("utf-8")))
            ends = np.cumsum([0] + [len(x) for x in lines])
            hashes = pa.array([h for x in lines for h, _ in x], pa.int64())
            sizes = pa.array([n for x in lines for _, n in x], pa.int32())
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([hashes, sizes], ["line", "words"]))
            columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns, held, pa.array(content, pa.int64())],
                                             ["doc_id", "host", *names, "lines", "content"])

    names = [x.split()[0] for x in BASE.split(", ")]
    return docs.mapInArrow(read, f"doc_id long, host string, {BASE}, lines array<struct<line:long,words:int>>, content long")


def common_lines(tables: DataFrame, limit: int = LINE_LIMIT, share: int | None = None) -> DataFrame:
    """``(host, line, first_id)`` of the lines held by more than ``limit`` distinct documents of the host
    and, if ``share`` is given, by more than one in ``share`` of them.  Counting goes over (host, line, content) first,
    combined on the map side, so a line that a third of all documents hold is spread out."""
    each = tables.select("host", "doc_id", "content", F.explode("lines.line").alias("line"))
    counts = (each.groupBy("host", "line", "content").agg(F.min("doc_id").alias("first_id"))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first_id").alias("first_id")))
    found = counts.filter(F.col("n_docs") > limit)
    if share is None:
        return found.select("host", "line", "n_docs", "first_id")
    hosts = tables.groupBy("host", "content").agg(F.count(F.lit(1)).alias("x")).groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    return (found.join(hosts, "host")
            .filter(F.col("n_docs") * share > F.col("n_host")).select("host", "line", "n_docs", "first_id"))


def _source(docs: DataFrame, host: str) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
            F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")]


def _judged(docs: DataFrame, host: str, limit: int = LINE_LIMIT, share: int | None = None, least_left: int = LEAST_PERCENT_LEFT) -> DataFrame:
    """The verdicts with ``host``, ``content`` and ``gone``, the hashes of the row's lines that are to be removed."""
    tables = stash(line_tables(docs.select(*_source(docs, host))).withColumn("row", F.monotonically_increasing_id()), "lines")
    common = stash(common_lines(tables, limit, share), "common_lines")
    removed = (tables.select("row", "doc_id", "host", F.explode("lines").alias("l"))
               .select("row", "doc_id", "host", "l.line", "l.words").join(common, ["host", "line"])
               .filter("doc_id > first_id").groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("gone")))
    out = tables.drop("lines").join(removed, "row", "left").drop("row")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < MIN_WORDS) | (100 * left < least_left * F.col("n_words"))
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & ~((F.col("n_removed_words") > 0) & depleted))


def quality_verdicts(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, share: int | None = None,
                     least_left: int = LEAST_PERCENT_LEFT) -> DataFrame:
    """``(doc_id, text, <host>)`` -> one row per row: base counts, ``base_failed``, ``n_removed_words``, ``kept``.

    A NULL text has no words and fails; a NULL host counts as the host ''.  Repeated rows each get the
    same verdict.  Only the three columns are read."""
    return _judged(docs, host, limit, share, least_left).drop("host", "content", "gone")


def _without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose hash is in ``gone``; all other lines as they are."""
    def key(line: Column) -> Column:
        return F.xxhash64(F.translate(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), _UPPER, _UPPER.lower()))

    return F.when(F.size(gone) > 0, F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(gone, key(x))), "\n")).otherwise(text)


def _joined(docs: DataFrame, host: str, verdicts: DataFrame, how: str) -> DataFrame:
    """Each row of ``docs`` (struct ``doc``, ``text``) with its verdict; rows of equal id, host and text have the same one."""
    ident, text, place = _source(docs, host)
    left = docs.select(ident, text, place, F.xxhash64(F.coalesce(text, F.lit(""))).alias("content"), F.struct(*docs.columns).alias("doc")).alias("d")
    right = verdicts.dropDuplicates(["doc_id", "host", "content"]).alias("v")
    same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.host") == F.col("v.host")) & (F.col("d.content") == F.col("v.content"))
    names = [c for c in verdicts.columns if c not in ("doc_id", "host", "content")]
    return left.join(right, same, how).select("d.doc_id", "d.text", "d.doc", *[F.col(f"v.{c}").alias(c) for c in names])


def cleaned_texts(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, share: int | None = None,
                  least_left: int = LEAST_PERCENT_LEFT) -> DataFrame:
    """The verdicts of :func:`quality_verdicts` with ``clean_text``, the text of a kept document without the lines
    that are common in its host, and ``clean_chars``; both are NULL for a rejected document."""
    verdicts = _judged(docs, host, limit, share, least_left)
    out = _joined(docs.select("doc_id", "text", host), host, verdicts, "inner")
    out = out.withColumn("clean_text", F.when(F.col("kept"), _without_lines(F.col("text"), F.col("gone"))))
    return out.withColumn("clean_chars", F.length("clean_text").cast("long")).drop("text", "doc", "gone")


def good_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, without the lines common in their host; a changed document's ``n_chars`` is counted anew.

    An id is out if any of its rows is, rows without an id pass unjudged."""
    rows = stash(_judged(docs, host), "verdicts")
    bad = rows.filter(~F.col("kept")).select("doc_id").distinct().withColumn("out", F.lit(True))
    # rows that stay as they are need no verdict
    changes = rows.select("doc_id", "host", "content", "gone").join(bad, "doc_id", "left").filter("out or size(gone) > 0")
    kept = _joined(docs, host, changes, "left").filter("out is null")
    changed = F.size("gone") > 0
    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    for k, c in enumerate(docs.columns):
        if c == "text":
            columns[k] = F.when(changed, _without_lines(F.col("text"), F.col("gone"))).otherwise(F.col("doc")[c]).alias(c)
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns[k] = F.when(changed, F.length(_without_lines(F.col("text"), F.col("gone"))).cast(kind)).otherwise(F.col("doc")[c]).alias(c)
    return kept.select(*columns)
