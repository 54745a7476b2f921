import hashlib
import random
from collections import Counter

import numpy as np

from shiftscope.llm import near_dedup as nd
from shiftscope.llm import suffix_dedup as sd
from shiftscope.llm.components import components

from .conftest import prose, words


def brute_components(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(frame, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(frame).collect()}
    assert got == brute_components(rows)


def test_components_of_documents(docs, rows):
    check(docs, rows)


def test_group_whose_members_link_through_others(spark):
    """Edited copies near the threshold: many link with some member but not with the smallest id."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_odd_and_empty(odd, empty):
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(odd).collect()} == {(5, 1, 5, True), (6, 0, 6, True)}
    assert nd.near_duplicates(empty).count() == 0
    assert Counter(r.doc_id for r in nd.unique_documents(odd).collect()) == {None: 2, 5: 1, 6: 1}


def test_sequential_test_bounds():
    least = nd.least_matches(128, 16, 75, 1e-6)
    assert least == sorted(least) and all(0 < m < 16 * (k + 1) for k, m in enumerate(least))
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (4000, 128), dtype=np.uint32)
    b = a.copy()
    miss = rng.random(b.shape) > 0.8
    b[miss] ^= 1
    assert nd.plausible(a, b).all()
    b[rng.random(b.shape) > 0.2] ^= 2
    assert not nd.plausible(a, b).any()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    both, left, right = (np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64)) for _ in range(3))
    sig = nd.signatures([np.union1d(both, left[:100]), np.union1d(both, right[:100])], 4096)
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.03


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 201), (202, 201)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


def brute_removed(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first.setdefault(raw[k:k + length], i) < i:
                cover[k:k + length] = b"\1" * length
        n_spans = sum(cover[k] and (k == 0 or not cover[k - 1]) for k in range(len(raw)))
        out[i] = (len(raw), sum(cover), n_spans, hashlib.sha256(bytes(x for x, c in zip(raw, cover) if not c)).hexdigest())
    return out


def test_repeated_strings(docs, rows, odd, empty):
    assert {r.doc_id: tuple(r)[1:] for r in sd.without_repeats(docs).collect()} == brute_removed(rows)
    assert sd.without_repeats(odd).count() == 5 and sd.without_repeats(empty).count() == 0


def test_repeats_of_few_letters(spark):
    """Periodic and binary texts, NULs included: many overlapping repeats."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        unit = "".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 30)))
        rows.append((i, (unit * rng.randint(1, 20) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 90))))[:rng.randint(30, 400)]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in sd.without_repeats(frame).collect()} == brute_removed(rows)


def test_maximal_repeats_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 40)))
        n = len(text)
        want = {}
        for size in range(3, n + 1):
            places = {}
            for k in range(n - size + 1):
                places.setdefault(text[k:k + size], []).append(k)
            for s, at in places.items():
                if len(at) > 1 and len({text[k - 1] if k else -1 for k in at}) > 1 and len({text[k + size] if k + size < n else -1 - k for k in at}) > 1:
                    want[s] = set(at)
        at = np.arange(n)
        left = np.array([text[k - 1] if k else 256 for k in range(n)])
        got = {}
        for size, members, low in sd.maximal_repeats(np.frombuffer(text + bytes(64), np.uint8), at, np.full(n, n), left, at, 3, 48):
            got[text[members[0]:members[0] + size]] = set(members.tolist())
            assert low == min(members)
        assert got == want
