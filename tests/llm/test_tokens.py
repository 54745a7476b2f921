import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shiftscope.llm import packing, repair_tokens
from shiftscope.llm.token_ids import Encoder, encoder, vocabulary_path

END = (2).to_bytes(4, "little")


@pytest.fixture(scope="module")
def enc():
    return encoder(vocabulary_path())


def test_chunks_equal_whole_texts(enc, rows):
    for _, t in rows:
        assert enc.encode(t) == enc.library(t or "")
    letters = "abzé ÉÀÿßÖ×÷ǿİßΣς.,;:!?'\"<|>_-12  \n\r\t \x85　\x0b\x0c\x1c\x1fª​中文😀&#sS's't"
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", "", " <|endoftext|> a", "<|startoftext|>"])
        assert enc.encode(text) == enc.library(text), repr(text)


def test_full_caches_change_nothing(rows, monkeypatch):
    import shiftscope.llm.token_ids as t
    monkeypatch.setattr(t, "MAX_CHUNKS", 3)
    monkeypatch.setattr(t, "MAX_WORDS", 3)
    small = Encoder(vocabulary_path())
    for _, text in rows[:60]:
        assert small.encode(text) == small.library(text or "")
    assert len(small.chunks) <= 3 and len(small.words) <= 3


def expected(enc, rows):
    return {i: enc.library(t or "") + END for i, t in rows}


def test_pieces_and_sequences(docs, rows, enc, odd, empty):
    want = expected(enc, rows)
    got = packing.packed_documents(docs, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 and r.doc_tokens == len(want[r.doc_id]) // 4
    assert {i: b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start)) for i, ps in by_doc.items()} == want
    for ps in by_sequence.values():
        ends = [0]
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == ends[-1]
            ends.append(p.offset + p.length)
        assert ends[-1] <= packing.CAPACITY
    assert packing.packed_documents(odd).count() == 5 and packing.packed_documents(empty).count() == 0


def test_differencing_is_near_equal_and_never_over():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        k = rng.randint(1, 12)
        sums, sets = packing.difference(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and [sum(sizes[i] for i in s) for s in sets] == sums.tolist()
        packs = packing.packed(sizes, 128)
        assert max(sum(sizes[i] for i in s) for s in packs) <= 128 and sorted(i for s in packs for i in s) == list(range(len(sizes)))
    # the textbook case: {8, 7, 6, 5, 4} into two gives 16 and 14
    assert sorted(packing.difference([8, 7, 6, 5, 4], 2)[0].tolist()) == [14, 16]
    assert len(packing.packed([60, 60, 60, 60], 100)) == 4
    many = [rng.randint(1, 512) for _ in range(1500)]
    assert len(packing.packed(many, 4096)) * 4096 < 1.02 * sum(many)
    with pytest.raises(ValueError):
        packing.packed([5000], 4096)


def most_pairs(symbols):
    """The greatest number of places at which one pair of symbols can be replaced."""
    last, counts = {}, {}
    for k, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
        if last.get(pair) != k - 1:
            counts[pair], last[pair] = counts.get(pair, 0) + 1, k
    return max(counts.values(), default=0)


def test_rules_are_made_until_no_pair_is_frequent():
    """Also where frequent pairs overlap (a phrase repeated in many places) and share places of the lookup table."""
    rng = random.Random(5)
    phrase = [rng.randrange(50) for _ in range(40)]
    ids = []
    for _ in range(60):
        ids += phrase[rng.randrange(20):] + [rng.randrange(1000) for _ in range(rng.randrange(5))] + [7] * rng.randrange(40)
    ids = np.array(ids * 3, np.uint32)
    symbols, rules, base = repair_tokens.compress(ids, 5)
    assert most_pairs(symbols) < 5 and (repair_tokens.expand(symbols, rules, base) == ids).all()
    # every expansion length is that of its two symbols, whatever the order of the rules
    sizes = [1] * base
    for left, right in rules.tolist():
        sizes.append(sizes[left] + sizes[right])
    assert repair_tokens.expansions(rules, base)[0].tolist() == sizes[base:]


def test_grammar_round_trips():
    rng = random.Random(3)
    for k in range(400):
        ids = np.array([rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(60))], np.uint32)
        symbols, rules, base = repair_tokens.compress(ids, 2, rng.choice([1, 4, 100]))
        assert (repair_tokens.expand(symbols, rules, base) == ids).all()
        assert most_pairs(symbols) < 2
    ids = np.array([rng.choice([1, 2, 3, 3, 3]) for _ in range(5000)], np.uint32)
    symbols, rules, base = repair_tokens.compress(ids, 4)
    assert most_pairs(symbols) < 4
    assert len(symbols) < len(ids) / 2
    block = {"symbols": symbols.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "base": base,
             "expansions": repair_tokens.expansions(rules, base)[0].astype("<u4").tobytes()}
    for _ in range(200):
        start, length = rng.randrange(5000), rng.randrange(60)
        assert (repair_tokens.token_range(block, start, length) == ids[start:start + length]).all()


def test_files_read_back(spark, docs, rows, enc, odd, empty, tmp_path):
    want = expected(enc, rows)
    repair_tokens.write_token_files(docs, f"file://{tmp_path}/a", block=3000)
    assert spark.read.parquet(f"file://{tmp_path}/a").count() > 3
    got = {r.doc_id: r for r in repair_tokens.read_token_files(spark, f"file://{tmp_path}/a").collect()}
    start = 0
    for i in sorted(want):
        n = len(want[i]) // 4
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, n, zlib.crc32(want[i]))
        start += n
    repair_tokens.write_token_files(odd, f"file://{tmp_path}/b")
    back = repair_tokens.read_token_files(spark, f"file://{tmp_path}/b").collect()
    assert len(back) == 5 and sorted(r.start for r in back)[0] == 0 and sum(r.doc_id is None for r in back) == 2
    repair_tokens.write_token_files(empty, f"file://{tmp_path}/c")
    assert repair_tokens.read_token_files(spark, f"file://{tmp_path}/c").count() == 0


@pytest.mark.parametrize("least", [2, 3, 16])
def test_frequent_pairs_are_counted_without_overlaps(least):
    from collections import Counter
    from itertools import groupby

    from shiftscope.llm.repair_tokens import _frequent_pairs
    rng = random.Random(least)
    for n in (2, 5, 40, 3000):
        ids = [x for _ in range(n) for x in [rng.randrange(6)] * rng.choice([1, 1, 1, 2, 3, 5, 40])][:n]
        want = Counter(p for p in zip(ids, ids[1:]) if p[0] != p[1])
        for value, run in groupby(ids):
            want[value, value] += len(list(run)) // 2
        symbols = np.array(ids, np.uint32)
        codes = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        pairs, counts = _frequent_pairs(symbols, codes, least)
        got = {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(c) for p, c in zip(pairs, counts)}
        assert got == {p: c for p, c in want.items() if c >= least} and list(pairs) == sorted(pairs)


def test_a_word_is_kept_once_for_all_its_chunks():
    enc = Encoder(vocabulary_path())
    text = "verywell Verywell, verywell. VERYWELL"
    ids = enc.encode(text)
    assert ids == enc.library(text)
    assert enc.chunks["verywell"] and not enc.words
