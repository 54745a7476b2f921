import hashlib
import re

import pytest

from shiftscope.llm import pii, secrets


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def base_pii(t):
    n = lambda m: sum(c.isdigit() for c in m)
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n(m) <= 19 and luhn(m)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n(m) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m.group(0))]


def base_secrets(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(1)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def sha(spans):
    return hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()


TRICKY = [
    "a@b.c.d_x@e.ff a@b @x.y a..b@c-.d a@b.c@d.e", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 1.1.1.0255 0001.2.3.4 9.9.9.9.",
    "4111111111111111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
    "+1 (974) 555-3436+49 30 1234567 +1 2 +123456789012345678 ++1234567890", "é😀 a@b.cc 😀 10.1.2.3 中 +1 974 555 3436.",
    "", None, "4" * 13 + " " + "4" * 20, "0" * 16, "a" * 3000 + "@b.c" + "1" * 3000,
    "token: token=abcdefgh token = abc secret='abcdef' API_KEY:xyzzy1 apikey==abcdef password password: token: abcdef",
    "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 11 + " AKIA" + "C" * 15, "f" * 24 + " " + "f" * 23 + "g" + "0123456789abcdef" * 3 + "F",
]


@pytest.fixture(scope="module")
def tricky(spark):
    return spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")


@pytest.mark.parametrize("which", ["tricky", "docs"])
def test_base_spans_equal_the_plain_patterns(request, which, rows):
    frame = request.getfixturevalue(which)
    text = dict(rows) if which == "docs" else dict(enumerate(TRICKY))
    for r in pii.pii_digest(frame).collect():
        want = base_pii(text[r.doc_id])
        assert r.base_sha256 == sha(want), (text[r.doc_id], r.spans, want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE_KINDS)
        assert {"%s:%d:%d" % s for s in want} <= set(r.spans.split(","))  | {""} or not want
    for r in secrets.secret_digest(frame).collect():
        want = base_secrets(text[r.doc_id])
        assert r.base_sha256 == sha(want), (text[r.doc_id], r.spans, want)
        assert {"%s:%d:%d" % s for s in want} <= set(r.spans.split(",")) | {""} or not want


def test_added_kinds_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789", "part 123-45-6789", "ssn 000-45-6789",
             "call (974) 555-3436 now", "number (974) 555-3436"]
    got = [r.spans for r in pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:10:21", "", "", "local_phone:5:19", ""]


def test_odd_and_empty_tables(odd, empty):
    assert pii.pii_digest(odd).count() == 5 and pii.pii_digest(empty).count() == 0
    assert secrets.secret_digest(odd).count() == 5 and secrets.secret_digest(empty).count() == 0
    assert secrets.without_secrets(odd).count() == 5 and secrets.without_secrets(empty).columns == empty.columns


def test_battery_and_false_discovery(spark):
    import random
    rng = random.Random(3)
    alnum = secrets.ALPHABETS["alnum"]
    random_tokens = ["".join(rng.choice(alnum) for _ in range(40)) for _ in range(200)]
    plain = [f"chapter{k}section{k}paragraph{k}aaaaaaaaaaaaaaaaaaaaaaa" for k in range(200)]
    frame = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(random_tokens + plain)], "doc_id long, text string")
    found = {r.doc_id for r in secrets.secret_digest(frame).collect() if "random" in r.spans}
    assert sum(i < 200 for i in found) >= 185 and not any(i >= 200 for i in found)


KEYS = {"digits": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "lower36": "0123456789abcdefghijklmnopqrstuvwxyz", "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "HEX": "0123456789ABCDEF",
        "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base32 in lower case": "abcdefghijklmnopqrstuvwxyz234567",
        "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}


def test_random_keys_of_every_alphabet_are_found(spark):
    """Keys of one case, without digits, without letters, in groups; what is repeated or a rule is thrown out."""
    import random
    rng = random.Random(11)
    rows = []
    for kind, abc in KEYS.items():
        for n in (20, 32, 40, 64, 96, 160):
            for part in ("", "-", "_", "+", "/"):
                if part and kind == "mixed":
                    continue
                for _ in range(40 if not part else 10):
                    key = "".join(rng.choice(abc) for _ in range(n))
                    rows.append(((kind, n, part), part.join(key[i:i + 5] for i in range(0, n, 5)) if part else key))
    plain = ["-" * 40, "a" + "-" * 30 + "b", "_/+-" * 8, "a-" * 20, *[(w * 20)[:60] for w in ("xyz", "A1", "98-76-", "home/", "data-set-", "LOG_FILE_")]]
    rows += [("plain", t) for t in plain]
    frame = spark.createDataFrame([(i, f"x {t} y") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.secret_digest(frame).collect()}
    share, n_rows = {}, {}
    for i, (kind, _) in enumerate(rows):
        for k in ((kind,) if kind == "plain" else (kind[0], kind[:2], "parted" + kind[2])):
            share[k], n_rows[k] = share.get(k, 0) + (spans[i] != ""), n_rows.get(k, 0) + 1
    assert share.pop("plain") == 0
    low = {k: (v, n_rows[k]) for k, v in share.items() if v < 0.85 * n_rows[k]}
    assert not low, low


def test_masked_text(spark):
    text = "é😀 token = \"abcdef123456\" then " + "0123456789abcdef" * 2 + " end"
    frame = spark.createDataFrame([(1, text, len(text), "x"), (2, "clean", 5, "y")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in secrets.without_secrets(frame).collect()}
    assert got[1].text == "é😀 [SECRET]\" then [SECRET] end" and got[1].n_chars == len(got[1].text) and got[2].text == "clean"
