"""Ordinary tokens are no secrets, whole pages keep their text, texts of many matches."""

import hashlib
import math
import random
import re

import pytest

from shiftscope.llm import pii, secrets
from shiftscope.llm.html_content import main_text

WORDS = ("help engine archive world contact report page review house garden window people thought government company number problem school "
         "country question national system program service children family history important information language library machine question "
         "analytics metrics config default settings update delete create account profile assets script index product catalog shopping").split()
LONG = ["Geschwindigkeitsbegrenzung", "Rechtsschutzversicherung", "Krankenversicherungskarte", "anticonstitutionnellement", "extraordinairement-incomprehensible",
        "internacionalizacion-constitucional", "electroencefalografista", "the-quick-brown-fox-jumps", "some_long_function_name_here", "src/analytics/kpi_engine",
        "/usr/local/lib/python/site", "2024-01-15/2024-02-20", "getHTTPResponseCodeFromServer", "SELECT_COUNT_FROM_TABLE_WHERE"]


def test_ordinary_tokens_are_left_alone(spark):
    rng = random.Random(4)
    plain = LONG + [rng.choice("-_/").join(rng.choice(WORDS) for _ in range(rng.randint(4, 6))) for _ in range(1500)]
    plain += ["".join(w.capitalize() for w in rng.choices(WORDS, k=5)) for _ in range(150)] + ["/".join(w + rng.choice(["", "1", "2024"]) for w in rng.choices(WORDS, k=5)) for _ in range(150)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) for n in (20, 32, 40) for _ in range(60)]
    rows = plain + keys
    frame = spark.createDataFrame([(i, f"see {t} now") for i, t in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id for r in secrets.secret_digest(frame).collect() if r.spans}
    assert sum(i < len(plain) for i in found) <= len(plain) // 100
    assert sum(i >= len(plain) for i in found) >= 0.85 * len(keys)
    # what is ordinary stays in the text as it is
    kept = {r.doc_id: r.text for r in secrets.without_secrets(frame.filter(f"doc_id < {len(LONG)}")).collect()}
    assert [kept[i] for i in range(len(LONG))] == [f"see {t} now" for t in LONG]


def test_scores_of_the_battery(spark):
    tokens = ["q7Zk2LmX9vB4nR8tY1wC", "deadbeefcafebabe0123456789", "abcdefghijklmnopqrstuvwxyz", "the-quick-brown-fox-jumps", "00112233445566778899"]
    rows = {r["value"]: r for r in secrets.with_battery(spark.createDataFrame([(t,) for t in tokens], "value string"), "value").collect()}
    for t, kind in zip(tokens, ("alnum", "hex", "letters", "letters", "digits")):
        r, abc = rows[t], secrets.ALPHABETS[kind]
        assert r["encoding"] == kind
        ix = [abc.index(c) for c in (t.replace("-", "").lower() if kind in ("hex", "letters") else t)]
        n, k = len(ix), len(abc)
        chi, df, mid = k / n * sum(ix.count(c) ** 2 for c in set(ix)) - n, k - 1, (k - 1) / 2
        assert r["z_chi"] == pytest.approx(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
        turns = sum((a > mid) != (b > mid) for a, b in zip(ix, ix[1:]))
        assert r["z_runs"] == pytest.approx(abs(turns - (n - 1) / 2) / (math.sqrt(n - 1) / 2))
        serial = sum((a - mid) * (b - mid) for a, b in zip(ix, ix[1:]))
        assert r["z_serial"] == pytest.approx(abs(serial) / (math.sqrt(n - 1) * (k * k - 1) / 12))
    common = set(secrets.COMMON_PAIRS.split())
    core = "thequickbrownfoxjumps"
    usual, pairs = sum(a + b in common or a == b for a, b in zip(core, core[1:])), len(core) - 1
    assert rows["the-quick-brown-fox-jumps"]["z_text"] == pytest.approx((secrets.ORDINARY * pairs - usual - 0.5) / math.sqrt(pairs * secrets.ORDINARY * (1 - secrets.ORDINARY)))


def test_cuts_are_those_of_benjamini_hochberg(spark):
    rng = random.Random(2)
    bins = [("a", rng.choice([0, 0, 0, 3, 20])) for _ in range(300)] + [("b", rng.choice([0, 1, 2])) for _ in range(200)] + [("c", rng.randint(0, 80)) for _ in range(100)]
    got = {r["family"]: r["cut"] for r in secrets.reporting_bins(spark.createDataFrame(bins, "family string, bin int")).collect()}
    want = {}
    for family in "abc":
        own = [b for f, b in bins if f == family]
        cuts = [c for c in sorted(set(own)) if c > 0 and secrets.upper_tail(c * secrets.BIN_WIDTH) <= secrets.RATE * sum(b >= c for b in own) / len(own)]
        if cuts:
            want[family] = min(cuts)
    assert got == want and "a" in got


def test_many_matches_in_one_text(spark):
    text = "é a.b@c.de 10.0.0.1 token=abcdefxy 4111 1111 1111 1111 x\n" * 3000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.pii_digest(frame).first()
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
    spans += [("card", m.start(), m.end()) for m in re.finditer(r"4111 1111 1111 1111", text)]
    assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()
    masked = secrets.without_secrets(frame).first().text
    assert masked == text.replace("token=abcdefxy", "[SECRET]")


L = "This is a long paragraph of the article with a good many words in it, so that its ratio is high. " * 3
P = " ".join(L.split())
BODY = f"<h1>Title</h1><p>{L}</p><p>Short.</p><ul><li>One</li><li>Two</li></ul><p>{L}</p>"
WANT = f"Title {P} Short. One Two {P}"


@pytest.mark.parametrize("page,want", [
    (f'<body><nav>menu</nav><div class="post has-sidebar">{BODY}</div><footer>f</footer></body>', WANT),
    (f'<body><div class="content ad-free">{BODY}</div></body>', WANT),
    (f'<body><div id="page" class="no-sidebar"><article>{BODY}</article></div></body>', WANT),
    (f'<body><article>{BODY}</article><article class="comment"><p>{L}</p></article></body>', WANT),
    (f'<body><article>{BODY}</article><div><article><p>A teaser of another story.</p></article></div></body>', WANT),
    (f'<body><article>{BODY}</article><section class="comments"><article><p>{L * 4}</p></article></section></body>', WANT),
    (f'<body><h1>Title</h1><ul><li>a b</li><li>c</li><li>d</li><li>e</li><li>f</li></ul><p>s1</p><p>s2</p><p>s3</p><p>{L}</p><p>{L}</p></body>', f"Title a b c d e f s1 s2 s3 {P} {P}"),
    (f'<body><article>{BODY}</article><!-- hidden > more <p>x</p></body>', WANT),
    (f'<body><script>var a="<!--";</script><article>{BODY}</article></body>', WANT),
    (f'<body><form id="aspnetForm"><div class="sidebar">ads here</div><div class="main">{BODY}</div></form></body>', WANT),
    (f'<body><div class="menu"><a href=x>A</a> <a href=y>B</a></div><div><ul><li><a href=1>One link</a></li><li><a href=2>Two link</a></li></ul></div>'
     f'<div>{BODY}</div><div class="cookie-notice">We use cookies {L}</div></body>', WANT),
    (f'<body><div class="sidebar">{L * 3}</div></body>', " ".join((L * 3).split())),
    ("<div>" * 20_000 + L, P)])
def test_pages_keep_their_article_and_nothing_else(page, want):
    assert main_text(page) == want
