import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shiftscope.llm import collocations as col
from shiftscope.llm import filter_audit as audit
from shiftscope.llm import licenses as lic
from tests.llm.conftest import prose, words


# collocations -------------------------------------------------------------------------------

def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_collocations(rows, least, top, inside):
    """rows (lang, text)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for n in range(1, 5):
                counts[lang].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = set()
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(100 * b >= inside * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            cuts = [((2000000 * a) // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def mined(df, **options):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r[c] for c in cols) for r in col.collocations(df, **options).collect()}


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(3)
    vocabulary = [prose(rng, 1) for _ in range(40)] + ["ÉA", "x\x1cy", "na\x85ïve", "a\x00b", "😀"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", "!?", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text + rng.choice(["", " In Spite Of it all", " la la la la la la"])))
    rows += [("en", None), ("en", ""), (None, None), ("en", "in spite of it all " * 3000)] + [("hot", "one hot line of text")] * 300
    return rows, spark.createDataFrame([(i, t, lang, 1, "k") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, f long, phrase string").repartition(4)


@pytest.mark.parametrize("least,top,inside", [(30, 2000, 80), (3, 25, 80), (200, 5, 50)])
def test_collocations_match_brute_force(speech, least, top, inside):
    rows, df = speech
    want = brute_collocations(rows, least, top, inside)
    assert want
    assert mined(df, least=least, top=top, inside_percent=inside) == want


def test_collocations_with_many_partitions_and_small_filter(speech, monkeypatch):
    rows, df = speech
    monkeypatch.setattr(col, "PART_BYTES", 4096)
    monkeypatch.setattr(col, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(col, "BATCH_BYTES", 2048)
    assert mined(df, least=5) == brute_collocations(rows, 5, 2000, 80)


def test_collocations_of_nothing(spark, empty):
    assert col.collocations(empty).count() == 0
    assert mined(spark.createDataFrame([(1, None, "en"), (2, " \t.", None)], "doc_id long, text string, lang string")) == set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=20), max_size=12), st.integers(2, 12))
def test_merged_summaries_lose_no_frequent_item(pieces, least):
    true = Counter()
    arrays = []
    for piece in pieces:
        c = Counter()
        for item, n in piece:
            c[item] += n
        true.update(c)
        arrays.append((np.array(sorted(c), np.uint32), np.array([c[k] for k in sorted(c)], np.uint32)))
    capacity = sum(true.values()) // least + 1
    items, counts, lost = col.merged_summary(iter(arrays), capacity)
    assert len(items) <= capacity and lost < least
    held = dict(zip(items.tolist(), counts.tolist()))
    for item, n in true.items():
        assert held.get(item, 0) <= n <= held.get(item, 0) + lost


# licences -----------------------------------------------------------------------------------

def brute_licenses(text, templates=lic.TEMPLATES, percent=lic.PERCENT):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places, labels, best = [], set(), 0.0
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    own = set(labels)
    for label, t in templates:
        tw = re.findall(r"[0-9a-z]+", lower(t))
        size = 8
        while size < len(tw):
            size *= 2
        for k in range(0, len(ws), size):
            share = len(set(ws[k:k + 2 * size]) & set(tw)) / len(set(tw))
            if 100 * len(set(ws[k:k + 2 * size]) & set(tw)) >= percent * len(set(tw)):
                own.add(label)
                best = max(best, share)
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(own)),
            1.0 if places else best)


LICENSE_COLS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@pytest.fixture(scope="module")
def licensed(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        text = prose(rng, rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            label, t = rng.choice(lic.TEMPLATES)
            ws = t.split()
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(["the", "other", "License"])
            text += rng.choice([" ", "\n", " — "]) + rng.choice([" ", "\n", " * "]).join(ws) + " " + prose(rng, rng.randint(0, 20))
        text += rng.choice(["", " CC-BY cc by", " All rights reserved. ALL RIGHTS   RESERVED", " general public\nlicense"])
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "cc"), (203, "by cc"), (204, "é cc by É"), (205, "cc by " * 20000), (206, prose(rng, 20000) + "\nReleased under the MIT License."),
             (207, "Kcc by"), (None, "cc by"), (0, rows[0][1])]
    return rows, spark.createDataFrame([(i, t, "a", 1, [1]) for i, t in rows], "doc_id long, text string, labels string, start int, ranks array<int>").repartition(3)


def test_licenses_match_brute_force(licensed):
    rows, df = licensed
    got = sorted((tuple(r[c] for c in ["doc_id", *LICENSE_COLS]) for r in lic.license_digest(df).collect()), key=repr)
    assert got == sorted(((i, *brute_licenses(t)) for i, t in rows), key=repr)
    assert sum("mit" in g[6] for g in got) > 5


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_license_join_is_exact_at_other_thresholds(licensed, percent):
    rows, df = licensed
    templates = [*lic.TEMPLATES, ("empty", " - "), ("one", "software"), ("twice", "of of of the the")]
    _, found = lic.license_blocks(df, templates=templates, percent=percent)
    got = {(r["row_key"].split(":")[0], r["template"], r["start"], round(r["containment"], 9)) for r in found.collect()}
    want = set()
    for i, text in rows:
        ws = [w.decode() for w in lic.words_of(text)]
        for n, (_, t) in enumerate(templates):
            tw = [w.decode() for w in lic.words_of(t)]
            size = lic.block_class(len(tw))
            for k in range(0, len(ws), size):
                both = len(set(ws[k:k + 2 * size]) & set(tw))
                if tw and 100 * both >= percent * len(set(tw)):
                    want.add(("null" if i is None else str(i), n, k, round(both / len(set(tw)), 9)))
    assert got == want


def test_clean_prose_has_no_license(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, prose(rng, 300)) for i in range(20)], "doc_id long, text string")
    assert lic.license_digest(df).filter("labels <> '' or score > 0").count() == 0


def test_licenses_of_odd_rows(odd, empty):
    assert lic.license_digest(empty).count() == 0
    got = [(r["doc_id"], r["n_words"], r["labels"]) for r in lic.license_digest(odd).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0, ""), (None, 5, ""), (5, 2, ""), (5, 2, ""), (6, 0, "")], key=repr)


# filter audit -------------------------------------------------------------------------------

def brute_audit(rows, labels):
    """rows (doc_id, lang, text), labels (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = []
    for i, lang, text in rows:
        text = text or ""
        ws = words(text)
        f = {"A"} if len(ws) < 200 else set()
        f |= {"B"} if 100 * len(set(ws)) < 50 * len(ws) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        f |= {"D"} if re.search("[#$%&*|]", text) else set()
        if i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows):
            f.add("E")
        fails.append((lang or "", i, f))
    out = {}
    for part in {p for p, _, _ in fails}:
        here = [(i, f) for p, i, f in fails if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                removed = [i for i, f in here if x in f and not f & before]
                shapley[x] += len(removed)
                out[part, order, step] = [sum(not f & (before | {x}) for _, f in here), len(removed), sum(x in f and bool(f & before) for _, f in here),
                                          sum(f == {x} for _, f in here), sum(i in good for i in removed), sum(i in toxic for i in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


AUDIT_COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, 250), prose(rng, 30), "A B C " * 90, "x # y", "same " * 210, "Ünïcode É # A", ""] + [prose(rng, rng.randint(150, 260)) for _ in range(20)]
    rows = [(i, rng.choice(["en", "de", None, ""]), rng.choice(texts + [None])) for i in range(160)]
    rows += [(None, "en", texts[0]), (None, "en", texts[0]), (3, rows[3][1], rows[3][2])] + [(1000 + i, "hot", texts[1]) for i in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1100, 2)] + [(2, 1, 1), (2, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, lang, t, 7, "m") for i, lang, t in rows], "doc_id long, lang string, text string, mask int, part string").repartition(3)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = [tuple(r[c] for c in AUDIT_COLS) for r in audit.interactions(docs, marks).collect()]
    want = brute_audit(rows, labels)
    assert len(got) == 600 * 4 == len(set(got))
    assert set(got) == want


def test_audit_of_nothing(empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(empty, none).count() == 0
