import random
import re
from collections import Counter
from itertools import combinations

import pytest

from shiftscope.llm import decontam

from .conftest import documents, prose


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(rows, items, window=13, least=10):
    out = set()
    for i, t in rows:
        w = split(t)
        for k, q in items:
            q = split(q)
            size = min(window, len(q))
            if len(q) < 6:
                continue
            for shift in range(-len(q) + 1, len(w)):
                equal = [0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(q)]
                if any(window * sum(equal[a:a + size]) >= least * size for a in range(len(q) - size + 1)):
                    out.add((i, k))
                    break
    return out


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randint(13, 40))) for k in range(12)] + [(20, "too short"), (21, None), (None, "no id " * 9)]
    rows = []
    for i in range(80):
        text = prose(rng, rng.randint(0, 60))
        if i % 4 == 0:
            w = split(items[i % 12][1])
            for at in rng.sample(range(len(w)), min(len(w) // 13 * rng.randint(0, 3), len(w))):
                w[at] = "other"
            if i % 8 == 0:
                w = w[:rng.randint(6, len(w))]
            text = f"{text} {', '.join(w)} {prose(rng, 5)}"
        rows.append((i, text))
    return rows + [(90, None), (91, ""), (92, "x")], items


def test_masks_hit_every_window_with_three_substitutions():
    for bad in map(set, combinations(range(13), 3)):
        assert any(not any(o + x in bad for x in mask) for mask in decontam.MASKS for o in range(13 - max(mask)))


def test_leaks(spark, leaky, odd):
    rows, items = leaky
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs, bench).collect()
    want = brute(rows, [x for x in items if x[0] is not None])
    assert len(want) > 10 and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in decontam.clean_documents(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.clean_documents(odd, bench).count() == 5
    assert decontam.leaks(docs.filter("false"), bench).count() == 0 and decontam.leaks(docs, bench.filter("false")).count() == 0


def test_large_benchmark_is_joined_without_broadcast(spark, leaky, monkeypatch):
    rows, items = leaky
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(rows, [x for x in items if x[0] is not None])


def test_pipeline(spark, tmp_path):
    """The stages one by one against brute force, each on what its predecessor kept."""
    import corpus_pipeline as P

    from .test_dedup import brute_components
    from .test_quality_and_web import base
    from .test_spans import base_secrets
    rng = random.Random(8)
    items = [(k, prose(rng, 20)) for k in range(5)]
    rows = documents(seed=5, n=80) + [(500 + k, f"{prose(rng, 30)} {items[k][1]}") for k in range(5)]
    frame = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf_dir = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == frame.columns
        out.write.parquet(f"{sf_dir}/stage{k}")
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.read.parquet(f"{sf_dir}/stage{k}")
        seen[k] = (before, docs)
    after = lambda k: {r.doc_id: r.text for r in seen[k][1].collect()}
    failed = {i for i, t in rows if base(t)[0] < 10 or 100 * base(t)[4] > 20 * base(t)[0]}
    assert set(after(0)) == {i for i, _ in rows} - failed
    assert set(after(1)) == {i for i, (_, c) in brute_components(list(seen[1][0].items())).items() if i == c}
    leaked = {i for i, _ in brute(list(seen[2][0].items()), items)}
    assert leaked and set(after(2)) == set(seen[2][0]) - leaked
    masked = after(3)
    assert set(masked) == set(seen[3][0])
    for i, t in seen[3][0].items():
        assert (masked[i] != t) == bool(base_secrets(t)) and not base_secrets(masked[i])
    assert Counter(r.doc_id for r in seen[4][1].collect()).keys() == set(masked)
    assert P.run(spark, sf_dir).count() == seen[4][1].count()
