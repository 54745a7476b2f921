import random
import re

import pytest


WORDS = "the of and a in that it was for on are with as his they at be this from have or by one had not but what all were when".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


def documents(seed=7, n=120):
    """Rows (doc_id, text): prose, exact and near copies, shared passages, secrets, personal data, junk, edge cases."""
    rng = random.Random(seed)
    passage = prose(rng, 30)
    rows = []
    for i in range(n):
        kind = i % 10
        text = prose(rng, rng.randint(5, 120))
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "x").split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = f"{text[:rng.randrange(40)]}{passage}{prose(rng, 4)}"
        elif kind == 4:
            text += f"\ntoken = \"{rng.getrandbits(160):040x}\" mail me: a.b{i}@mail.example.com or +1 (974) 555-3436"
        elif kind == 5:
            text += "\ncard 4111 1111 1111 1111, ip 10.0.0.255 and 10.0.0.256; iban GB82 WEST 1234 5698 7654 32\nsame line\nsame line"
        elif kind == 6:
            text = "Ünïcode ÉÀ été 中文 😀 " + text + " 😀 x@y.zz"
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one two"), (n + 4, "one two"), (n + 5, "x" * 60), (n + 6, "y" + "x" * 70),
             (n + 7, "again " * 400), (n + 8, prose(rng, 9000)), (n + 9, rows[0][1])]
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with names that the operators use inside."""
    data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 1, "k", [1]) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, part int, key string, positions array<int>") \
        .withColumnsRenamed({"part": "host", "positions": "spans"}).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column and repeated rows."""
    return spark.createDataFrame([(None, None, None, None, None), (None, "no id here at all", None, None, None), (5, "same row", "en", "s", 8),
                                  (5, "same row", "en", "s", 8), (6, None, "en", None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
