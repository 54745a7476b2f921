"""Licence texts: an exact set-similarity join of text blocks with templates.

A template is found in a *block* (a window of words) that holds ``percent`` of its distinct words.  For
templates of up to c words, c a power of two, blocks are the windows of 2c words that start at every c-th
word, so each verbatim copy lies whole in one block and long texts become many small blocks.

1. A task turns each text into the places of words that any template holds; other words cannot add to
   an overlap.  Their occurrences over all documents give the global order, rarest first.
2. Prefix filter: a template of t words, o of them wanted, and a block of b words that share o words share
   one of the template's first t - o + 1 words and of the block's first b - o + 1.  Blocks without a
   template's prefix word are not written; the others are joined with the templates' prefixes on the word.
3. Length filter: b >= o.  Positional filter: the shared prefix words, and the shorter of what follows the
   last of them on either side, must reach o.
4. What is left is verified on the whole sets.

The tables joined with the blocks hold a row per word of a template's prefix: their size is that of the
templates given, not of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered, row_key, stash

PERCENT = 90
LEAST_CLASS = 8

# Phrases whose places are counted, and templates, each with its label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: on UTF-8 bytes with A-Z lower-cased: runs of ASCII digits, ASCII letters and all characters beyond ASCII
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8").lower())


def needed(n_words: int, percent: int = PERCENT) -> int:
    """The fewest shared words with 100 * shared >= percent * words."""
    return -(-percent * n_words // 100)


def block_class(n_words: int) -> int:
    size = LEAST_CLASS
    while size < n_words:
        size *= 2
    return size


def _marked(docs: DataFrame, text: str, vocabulary: list[bytes], phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """``(doc_id, row_key, n_words, n_base, first_word, last_word, base, at, word)``: ``at`` and ``word``
    are the places and numbers of the vocabulary's words as packed 32-bit integers."""
    number = {w: i for i, w in enumerate(vocabulary)}
    wanted = [([number[w] for w in words_of(p)], label) for p, label in phrases]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", 4 << 20):
            found = [words_of(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            codes = np.concatenate([np.fromiter(map(number.get, f, repeat(-1)), np.int32, len(f)) for f in found])
            doc = np.repeat(np.arange(len(found)), sizes)
            n_base, first, last = np.zeros(len(found), np.int64), np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), -1, np.int64)
            labels: list[set[str]] = [set() for _ in found]
            for phrase, label in wanted:
                n = len(codes) - len(phrase) + 1
                if n <= 0:
                    continue
                hit = doc[:n] == doc[len(phrase) - 1:]
                for k, w in enumerate(phrase):
                    hit &= codes[k:k + n] == w
                places = np.flatnonzero(hit)
                of = doc[places]
                np.add.at(n_base, of, 1)
                np.minimum.at(first, of, places - starts[of])
                np.maximum.at(last, of, places - starts[of])
                for i in set(of.tolist()):
                    labels[i].add(label)
            known = np.flatnonzero(codes >= 0)
            at, word = (known - starts[doc[known]]).astype(np.int32), codes[known]
            cut = np.searchsorted(known, starts)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                 pa.array([at[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([word[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                ["doc_id", "row_key", "n_words", "n_base", "first_word", "last_word", "base", "at", "word"])

    return docs.select("doc_id", row_key(text).alias("row_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(
        mark, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key string, n_words long, n_base long, first_word long, last_word long, "
              "base array<string>, at binary, word binary")


def _occurrences(marked: DataFrame, size: int) -> list[int]:
    """Occurrences of each vocabulary word over all documents: a row per word and batch of rows, then per word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("word").to_pylist()), np.int32), minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(n)], ["word", "n"])

    held = marked.select("word").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in held}
    return [found.get(i, 0) for i in range(size)]


def license_blocks(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT,
                   phrases: Sequence[tuple[str, str]] = PHRASES) -> tuple[DataFrame, DataFrame]:
    """The marked documents (one row per row) and ``(row_key, template, label, start, containment)``:
    every block, by its first word, that holds ``percent`` of a template's distinct words.

    ``templates`` are ``(label, text)``; one without words is found nowhere."""
    held = [(i, label, words_of(t)) for i, (label, t) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in held for w in ws} | {w for p, _ in phrases for w in words_of(p)})
    marked = stash(_marked(docs, text, vocabulary, phrases), "license_words")
    counts = _occurrences(marked, len(vocabulary))
    order = sorted(range(len(vocabulary)), key=lambda i: (counts[i], vocabulary[i]))
    rank = np.empty(len(vocabulary), np.int32)
    rank[order] = np.arange(len(vocabulary))
    number = {w: int(rank[i]) for i, w in enumerate(vocabulary)}
    sets = [(i, label, block_class(len(ws)), sorted({number[w] for w in ws})) for i, label, ws in held if ws]
    classes = sorted({c for _, _, c, _ in sets})
    held_by, least, prefix = {}, {}, {}
    for c in classes:
        held_by[c], prefix[c] = np.zeros(len(vocabulary), bool), np.zeros(len(vocabulary), bool)
        of = [s for _, _, k, s in sets if k == c]
        least[c] = min(needed(len(s), percent) for s in of)
        for s in of:
            held_by[c][s] = True
            prefix[c][s[:len(s) - needed(len(s), percent) + 1]] = True

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, codes = batch.column("at").to_pylist(), batch.column("word").to_pylist()
            rows = np.repeat(np.arange(batch.num_rows), [len(s) // 4 for s in spots])
            at, ranks = np.frombuffer(b"".join(spots), np.int32).astype(np.int64), rank[np.frombuffer(b"".join(codes), np.int32)]
            for c in classes:
                use = held_by[c][ranks]
                row, block, r = rows[use], at[use] // c, ranks[use].astype(np.int64)
                back = block > 0
                row, block, r = np.concatenate([row, row[back]]), np.concatenate([block, block[back] - 1]), np.concatenate([r, r[back]])
                if not len(row):
                    continue
                width = int(block.max()) + 1
                keys = np.unique((row * width + block) * len(vocabulary) + r)
                group, r = keys // len(vocabulary), keys % len(vocabulary)
                starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                sizes = np.diff(np.append(starts, len(group)))
                keep = (np.add.reduceat(prefix[c][r].astype(np.int64), starts) > 0) & (sizes >= least[c])
                if not keep.any():
                    continue
                chosen = np.repeat(keep, sizes)
                kept = group[starts[keep]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(pa.array(kept // width)), pa.array(np.full(len(kept), c), pa.int32()), pa.array(kept % width * c),
                     pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[keep]))), pa.int32()), pa.array(r[chosen], pa.int32()))],
                    ["row_key", "size", "start", "ranks"])

    spark = docs.sparkSession
    blocks = marked.select("row_key", "at", "word").mapInArrow(cut, "row_key string, size int, start long, ranks array<int>")
    rows = [(i, label, c, len(s), needed(len(s), percent), s) for i, label, c, s in sets]
    about = spark.createDataFrame(rows, "template int, label string, size int, t int, o int, words array<int>")
    heads = about.select("*", F.posexplode("words").alias("i", "rank")).filter("i <= t - o")
    shared = (blocks.select("*", F.size("ranks").alias("b"), F.posexplode("ranks").alias("j", "rank"))
              .join(F.broadcast(heads), ["size", "rank"]).filter("b >= o and j <= b - o"))
    pairs = shared.groupBy("row_key", "template", "start").agg(
        F.count(F.lit(1)).alias("common"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("ranks").alias("ranks"), F.first("words").alias("words"),
        F.first("t").alias("t"), F.first("b").alias("b"), F.first("o").alias("o"), F.first("label").alias("label"))
    found = (pairs.filter("common + least(t - 1 - i, b - 1 - j) >= o")
             .withColumn("overlap", F.size(F.array_intersect("ranks", "words"))).filter("overlap >= o")
             .select("row_key", "template", "label", "start", (F.col("overlap").cast("double") / F.col("t")).alias("containment")))
    return marked, found


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``score`` is the greatest containment of a template found, 1 where a base phrase stands and 0 where
    nothing is found.  A NULL text counts as empty; rows that repeat an id and a text give equal
    results; an empty table gives no rows; other columns, also clashing ones, are ignored."""
    marked, found = license_blocks(docs)
    by_row = found.groupBy("row_key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    return marked.drop("at", "word").join(by_row, "row_key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.slice("base", 1, 0))))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
