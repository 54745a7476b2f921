"""DuckDB SQL giving the same rows as the queries that SQL can express.

The others are held against brute force in tests/llm: op1, op6 and op8 rest on look-around patterns,
tests or hashes that DuckDB lacks, op3, op5, op7 and op9 on a tokenizer, file formats or a parser, and
op4 as SQL over all 50-byte strings takes minutes on the smallest tables."""

from __future__ import annotations

from .collocations import BREAKS, INSIDE_PERCENT, LEAST, TOP
from .decontam import LEAST_EQUAL, MASKS, WINDOW
from .filter_audit import CAPITAL_PERCENT, DISTINCT_PERCENT, LEAST_WORDS, LETTERS, SYMBOLS
from .licenses import PHRASES, TEMPLATES, block_class, needed, words_of
from .near_dedup import PERCENT, WORDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))) AS s
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

def _seeds(table: str, ident: str) -> str:
    parts = []
    for k, mask in enumerate(MASKS):
        key = " || ' ' || ".join(f"ws[i + {x + 1}]" for x in mask)
        parts.append(f"SELECT {ident}, unnest(list_transform(range(0, greatest(len(ws) - {max(mask)}, 0)), "
                     f"lambda i: {{'key': '{k} ' || {key}, 'at': i}})) AS s FROM {table}")
    return " UNION ALL ".join(parts)


LEAKS = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS ({_seeds('d', 'doc_id')}),
bs AS ({_seeds('b', 'item_id')}),
hits AS (
  SELECT DISTINCT doc_id, item_id, ds.s['at'] - bs.s['at'] AS shift, bs.s['at'] AS touch
  FROM ds JOIN bs ON ds.s['key'] = bs.s['key']),
e AS (
  SELECT h.*, len(b.ws) AS n, least(len(b.ws), {WINDOW}) AS width, list_transform(range(0, len(b.ws)),
    lambda j: CASE WHEN shift + j >= 0 AND coalesce(d.ws[shift + j + 1] = b.ws[j + 1], false) THEN 1 ELSE 0 END) AS eq
  FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)),
best AS (
  SELECT doc_id, item_id, shift, n, max(list_max(list_transform(range(greatest(touch - {WINDOW - 1}, 0), least(touch, n - width) + 1),
    lambda i: list_sum(eq[i + 1:i + width])))) AS n_equal
  FROM e GROUP BY 1, 2, 3, 4)
SELECT doc_id, item_id, CAST(max(n_equal) AS INTEGER) AS n_equal, count(*) AS n_places
FROM best WHERE n_equal * {WINDOW} >= {LEAST_EQUAL} * least(n, {WINDOW}) GROUP BY 1, 2"""

def _list(words: list[bytes]) -> str:
    return "[" + ", ".join("'" + w.decode() + "'" for w in words) + "]"


_TEMPLATE_ROWS = ", ".join(
    f"('{label}', {_list(sorted(set(words_of(t))))}, {block_class(len(words_of(t)))}, {needed(len(set(words_of(t))))})" for label, t in TEMPLATES)
_PHRASE_ROWS = ", ".join(f"('{label}', {_list(words_of(p))})" for p, label in PHRASES)

LICENSES = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
phrases(label, p) AS (VALUES {_PHRASE_ROWS}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, greatest(len(ws) - len(p) + 1, 0)), lambda i: ws[i + 1:i + len(p)] = p)) AS place FROM w, phrases),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY 1),
templates(label, ts, size, o) AS (VALUES {_TEMPLATE_ROWS}),
sizes AS (SELECT DISTINCT size FROM templates),
blocks AS (
  SELECT doc_id, size, list_distinct(ws[k + 1:k + 2 * size]) AS bs
  FROM (SELECT doc_id, ws, size, unnest(range(0, len(ws), size)) AS k FROM w, sizes)),
found AS (
  SELECT doc_id, label, len(list_intersect(bs, ts)) / len(ts) AS c
  FROM blocks JOIN templates USING (size) WHERE len(list_intersect(bs, ts)) >= o),
own AS (SELECT doc_id, max(c) AS best, list(DISTINCT label) AS ls FROM found GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(own.ls, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)"""

FILTERS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (
  SELECT w.part, coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = w.doc_id) = 1, false) AS good,
    coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = w.doc_id) = 1, false) AS toxic,
    (CASE WHEN len(ws) < {LEAST_WORDS} THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[{SYMBOLS}]') THEN 'D' ELSE '' END)
    || (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END) AS fails
  FROM w),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(string_split('{LETTERS}', '')) AS x) WHERE NOT contains(o, x)),
steps AS (
  SELECT part, o AS filter_order, step, o[step] AS x, cells.*
  FROM (SELECT o FROM orders WHERE length(o) = {len(LETTERS)}), range(1, {len(LETTERS)} + 1) s(step), cells),
told AS (
  SELECT *, length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS earlier, contains(fails, x) AS hit FROM steps),
sums AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, x,
    coalesce(sum(n) FILTER (NOT earlier AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT earlier AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (earlier AND hit), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT earlier AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT earlier AND hit), 0) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM sums"""

_BREAK_CLASS = "[" + "".join(f"\\x{ord(c):02X}" for c in BREAKS) + "]"

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_BREAK_CLASS}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
          FROM w, range(1, 5) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, CAST(k AS INTEGER) AS k, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
c AS (SELECT * FROM f WHERE k >= 2),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS outer_c WHERE outer_c.lang = c.lang AND outer_c.k > c.k AND 100 * outer_c.f >= {INSIDE_PERCENT} * c.f
      AND contains(' ' || outer_c.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS y
  FROM (SELECT *, CAST(unnest(range(1, k)) AS INTEGER) AS cut FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000::HUGEINT * a) // (l.f + r.f), cut) AS nth
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""

ORACLE: dict[str, str] = {
    "op2_minhash_near_dedup": NEAR,
    "op10_spaced_seed_leaks": LEAKS,
    "op11_license_scan": LICENSES,
    "op12_filter_interactions": FILTERS,
    "op13_phrase_collocations": COLLOCATIONS,
}
