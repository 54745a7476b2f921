import random
import re
from collections import Counter, defaultdict

from shiftscope.llm import html_content, line_quality, warc
from shiftscope.llm.queries import response_records

from .conftest import prose, words


def base(t):
    w, seen, dup = words(t), set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)


def test_base_counts(docs, rows, odd, empty):
    text = dict(rows)
    got = line_quality.quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert line_quality.quality_verdicts(odd).count() == 5 and line_quality.quality_verdicts(empty).count() == 0
    assert line_quality.good_documents(docs).columns == docs.columns
    assert sorted((r.doc_id or -1) for r in line_quality.good_documents(odd).collect()) == [-1, -1]


def test_lines_common_to_a_host(spark):
    """The menu stands in every document of host a; documents of little else are rejected, the first and host b stay."""
    import random
    rng = random.Random(9)
    menu = "Home | About us | Products and prices | Contact | Terms of use | Imprint | Help | Search | Log in"
    rows = [(i, f"{menu}\n{prose(rng, 60)}", "a") for i in range(30)]
    rows += [(100 + i, f"{prose(rng, 3)}\n{menu.upper()}", "a") for i in range(5)]
    rows += [(200 + i, f"{menu}\n{prose(rng, 3)}", "b") for i in range(5)]
    copy = "\n".join(prose(rng, 12) for _ in range(8))
    rows += [(300 + i, copy, "a") for i in range(40)]
    got = {r.doc_id: r for r in line_quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=100).collect()}
    n = len(words(menu))
    assert all(got[i].kept and got[i].n_removed_words == (n if i else 0) for i in range(30))
    assert all(not got[100 + i].kept and not got[100 + i].base_failed for i in range(5))
    # brute force of the counts: distinct sketches per host and line
    held = defaultdict(set)
    for i, t, h in rows:
        lines = [x[0] for x in line_quality.base_counts(t)[1]]
        for x in lines:
            held[h, x].add(min(lines))
    for i, t, h in rows:
        gone = 0
        for x, k in line_quality.base_counts(t)[1]:
            holders = [j for j, u, g in rows if g == h and x in dict(line_quality.base_counts(u)[1])]
            hosts = len({min(dict(line_quality.base_counts(u)[1])) for _, u, g in rows if g == h})
            if len(held[h, x]) > 10 and len(held[h, x]) * 100 > hosts and i > min(holders):
                gone += k
        assert got[i].n_removed_words == gone
    assert all(got[200 + i].kept and got[300 + i].kept for i in range(5))


def test_common_lines_count_whole_texts(spark):
    """Documents of a few shared lines, one of them the smallest hash of all: each different text counts, copies once."""
    rng = random.Random(4)
    shared = [prose(rng, 12) for _ in range(9)]
    rows = [(i, "\n".join(rng.sample(shared, 6)) + f"\n{prose(rng, 20)}", "a") for i in range(25)]
    rows += [(100 + i, "\n".join(shared[k] for k in range(9) if k != i % 9), "a") for i in range(18)]
    rows += [(200 + i, shared[0] + "\n" + "\n".join(prose(rng, 15) for _ in range(3)), "b") for i in range(10)] + [(250 + i, shared[0], "b") for i in range(20)]
    held, first = defaultdict(set), {}
    for i, t, h in rows:
        for line in t.split("\n"):
            held[h, line].add(t)
            first.setdefault((h, line), i)
    common = {k for k, texts in held.items() if len(texts) > 10}
    assert len(common) == 10
    got = {r.doc_id: r for r in line_quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, t, h in rows:
        gone = sum(len(words(x)) for x in t.split("\n") if (h, x) in common and i > first[h, x])
        assert got[i].n_removed_words == gone and got[i].kept == (gone == 0 or len(words(t)) - gone >= max(10, 0.2 * len(words(t)))), i


def test_common_lines_are_cut_out_of_the_texts(spark, tmp_path):
    """Kept texts lose the lines common in their source, whatever their case and spacing; all else stays as it is."""
    from shiftscope.llm.queries import QUERIES
    rng = random.Random(6)
    menu, notice = "Home | ÀBOUT us | Products and prices", "\tAll rights   reserved by the owner\x0b of this site\r"
    rows = [(i, f"{menu}\n{prose(rng, 30)}\r\n\n  {prose(rng, 20)}\n{notice}", "a") for i in range(20)]
    rows += [(100 + i, f"{prose(rng, 20)}\n{menu.replace('Home', 'HOME ')}\n{prose(rng, 20)}\n", "a") for i in range(5)]
    rows += [(200 + i, f"{menu}\n{prose(rng, 30)}", "b") for i in range(5)] + [(5, rows[5][1], "a"), (None, rows[3][1], "a"), (300, f"two words\n{menu}", "a")]
    flat = lambda x: " ".join(words(x)).translate({k: k + 32 for k in range(65, 91)})
    common = {flat(menu), flat(notice)}
    want = {(i, t, h, "\n".join(x for x in t.split("\n") if not (h == "a" and i and flat(x) in common))) for i, t, h in rows if i != 300}
    assert sum(t != u for _, t, _, u in want) == 24
    docs = spark.createDataFrame([(i, t, "en", h, len(t), "z") for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars int, host string")
    got = line_quality.good_documents(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in rows if i != 300)
    assert {(r.doc_id, r.source, r.text, r.n_chars, r.host) for r in found} == {(i, h, u, len(u), "z") for i, _, h, u in want}
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    made = QUERIES["op8_cross_document_lines"](spark, f"file://{tmp_path}").collect()
    assert len(made) == len(rows) and all((r.clean_text is None) == (not r.kept) == (r.doc_id == 300) for r in made)
    assert {(r.doc_id, r.clean_text, r.clean_chars) for r in made if r.kept} == {(i, u, len(u)) for i, _, _, u in want}


def test_limit_does_not_rise_with_the_source(spark):
    """A line in 11 documents counts as common in a source of 12,000 documents as in one of 11."""
    frame = spark.range(12_011).selectExpr(
        "id as doc_id", "if(id < 12000, 'hot', 'small') as source",
        "concat(if(id < 11 or id >= 12000, 'a line that eleven documents of the source hold\\n', ''), 'w', id, ' one two three four five six seven eight nine ten eleven twelve') as text")
    got = line_quality.quality_verdicts(frame).filter("n_removed_words > 0").collect()
    assert {(r.doc_id, r.n_removed_words) for r in got} == {(i, 9) for i in [*range(1, 11), *range(12_001, 12_011)]}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies.</div>%s<div id="comments"><p>%s</p></div><aside>Side</aside><form>Name <input></form>
<footer>&copy; 2020</footer></body></html>"""
LONG = "A long paragraph of running text &amp; more, which says <b>something</b> at some\n length &eacute;."
PLAIN = "A long paragraph of running text & more, which says something at some length é."


def test_main_text():
    article = f"<article><h1>Head</h1><p>{LONG}<p>Short.<div class=\"ad\">Buy!</div><ul><li>One</li><li>Two</li></ul><p>{LONG}</p></article>"
    assert html_content.main_text(PAGE % (article, LONG)) == f"Head {PLAIN} Short. One Two {PLAIN}"
    plain = f"<div class=\"content\"><h2>Head of the page</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    assert html_content.main_text(PAGE % (plain, LONG)) == f"Head of the page {PLAIN} {PLAIN} {PLAIN}"
    for page in (None, "", "<html></html>", "<nav>menu</nav>", "<script>x", "<!-- only"):
        assert html_content.main_text(page) == ""
    assert html_content.main_text("just text") == "just text"
    # unclosed elements and a page cut in the middle
    assert html_content.main_text(f"<body><article><p><b>{LONG}<p>{LONG}<foot") .startswith(f"{PLAIN} {PLAIN}")
    assert len(html_content.main_text("<p>" + "word " * 200_000 + "</p>")) == 999_999


def test_main_text_of_tables(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, None), (2, "v", "", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_content.extracted(frame).collect())
    assert got == [(0, "", 0), (1, PLAIN, len(PLAIN)), (1, PLAIN, len(PLAIN)), (2, "", 0)]
    assert html_content.extracted(frame.filter("false")).count() == 0


def test_derived_records(spark):
    page = PAGE % (f"<article><p>{LONG}</p></article>", "x")
    rows = [(1, "http://a/?q=1&r", page, "r"), (1, "http://a/?q=1&r", page, "r"), (2, None, None, None), (3, "http://é/", "é" * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    source = {r.page_id: bytes(r.record) for r in response_records(pages).collect()}
    got = warc.derived_records(response_records(pages)).collect()
    assert Counter((r.page_id, r.record_type) for r in got) == {(p, t): 1 + (p == 1) for p in (1, 2, 3) for t in ("metadata", "conversion")}
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        _, fields = warc.headers(head)
        block = rest[:r.block_length]
        assert rest == block + b"\r\n\r\n" and int(warc.field(fields, "Content-Length")) == len(block)
        assert warc.digest_holds(r.block_digest, block) == "ok" and warc.field(fields, "WARC-Block-Digest") == r.block_digest
        _, origin = warc.headers(source[r.page_id].partition(b"\r\n\r\n")[0])
        assert r.refers_to == warc.field(origin, "WARC-Record-ID") == warc.field(fields, "WARC-Refers-To")
        assert warc.field(fields, "WARC-Target-URI") == warc.field(origin, "WARC-Target-URI") and warc.field(fields, "WARC-Date")
        if r.record_type == "metadata":
            text = block.decode()
            assert "http-status: HTTP/1.1 200 OK" in text and "source-payload-digest-check: ok" in text
            other = next(x for x in got if x.page_id == r.page_id and x.record_type == "conversion")
            assert f"conversion-record: {other.record_id}" in text and warc.field(fields, "WARC-Concurrent-To") == other.record_id
        elif r.page_id == 1:
            assert PLAIN in block.decode().split("\n") and "var a" not in block.decode()
        elif r.page_id == 3:
            assert block.decode() == "é" * 50_000
    assert warc.derive(None) == [] and warc.derive(b"no record") == [] and warc.derive(source[1].replace(b"Type: response", b"Type: request")) == []
    damaged = warc.derive(source[1].replace(b"long paragraph", b"LONG paragraph"))
    assert b"source-payload-digest-check: differs" in damaged[0][-1]
    assert warc.derived_records(response_records(pages.filter("false"))).count() == 0


def test_plain_text_equals_a_parser():
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out = []

        def handle_data(self, data):
            self.out.append(data)
    for body in (f"<p>{LONG}</p>", "a<br>b", "x <i title='>'>y</i> z &lt;not a tag&gt;", "<div>1<div>2</div>3</div>"):
        p = Text()
        p.feed(body)
        p.close()
        assert re.sub(r"\s", "", warc.plain_text(body)) == re.sub(r"\s", "", "".join(p.out))


def test_source_headers_and_encoded_bodies():
    import gzip
    import hashlib
    import zlib

    import zstandard
    page = "<html><head><title>T</title></head><body><p>Grüße one</p><p>two</p></body></html>".encode()
    chunked = lambda data: b"".join(b"%x;a=b\r\n%s\r\n" % (len(data[i:i + 7]), data[i:i + 7]) for i in range(0, len(data), 7)) + b"0\r\nTrailer: x\r\n\r\n"
    raw_deflate = zlib.compressobj(wbits=-15)
    cases = [("", page, []), ("Transfer-Encoding: chunked\r\n", chunked(page), []), ("Content-Encoding: gzip\r\n", gzip.compress(page[:9]) + gzip.compress(page[9:]), []),
             ("Content-Encoding: GZIP\r\nTransfer-Encoding: chunked\r\n", chunked(gzip.compress(page)), []), ("Content-Encoding: deflate\r\n", zlib.compress(page), []),
             ("Content-Encoding: deflate\r\n", raw_deflate.compress(page) + raw_deflate.flush(), []), ("Content-Encoding: zstd\r\n", zstandard.compress(page), []),
             ("Content-Encoding: gzip, identity\r\n", gzip.compress(page), []),
             ("Content-Encoding: br\r\n", page, ["br"]), ("Transfer-Encoding: chunked\r\n", page, ["chunked"]), ("Content-Encoding: gzip\r\n", gzip.compress(page)[:-9], ["gzip"])]
    for extra, body, failed in cases:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{extra}\r\n".encode() + body
        entity = body if failed or "chunked" not in extra else warc.unchunked(body)
        raw = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Profile: own\r\nX-Own: some value\r\nWARC-Concurrent-To: <urn:uuid:2>\r\n"
               f"WARC-Payload-Digest: sha256:{hashlib.sha256(entity).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
        meta, text = (x[-1].split(b"\r\n\r\n", 1)[1].decode() for x in warc.derive(raw))
        lines = meta.split("\r\n")
        for line in ("source-header: WARC-Profile: own", "source-header: X-Own: some value", "source-header: WARC-Concurrent-To: <urn:uuid:2>", "source-payload-digest-check: ok"):
            assert line in lines
        assert [x.split(": ")[1] for x in lines if x.startswith("encoding-not-undone")] == failed
        if not failed:
            assert text.strip() == "T\nGrüße one\ntwo" and "title: T" in lines
