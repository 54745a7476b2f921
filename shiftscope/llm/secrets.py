"""Secrets: known shapes by pattern, and random tokens by a battery of randomness tests.
Columns and SQL functions only.

For every token of 20 or more characters an encoding is inferred: the narrowest of digits, hex,
letters, base32 and letters with digits in one case, letters, letters with digits and base64 in both.
``-``, ``_``, ``+`` and ``/`` in a token of one case part its groups and are taken out (what is left
of a random token is random); with both cases they are symbols of base64.  A token more than a third
of which they are is a rule or a table and not tested, nor is one that holds a date.

A token is reported as kind ``random`` if both hold:

* The battery does not reject that it is uniform in its encoding (at ``ALPHA``, over three tests):
  chi-squared of the alphabet's symbols; runs between the alphabet's halves; serial correlation.
* It is not ordinary.  Most neighbouring letters of words, names, paths and identifiers are pairs
  common in European languages, and letters and digits seldom alternate; random symbols pair at will.
  The hypothesis "at least ``ORDINARY`` of the pairs are common" is tested, and rejected by
  Benjamini-Hochberg over all tokens of the corpus, separately by encoding and length class (the test's power
  grows with length): of the tokens reported at most a share ``rate`` is ordinary.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_key, stash
from .spans import SPAN, by_start, count_kind, find_spans, joined, meeting, redacted

# Kinds in their order and patterns.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "letters52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: lower bounds of the length classes
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128, 256)
# Pairs of letters common in English, French, German or Spanish words.
COMMON_PAIRS = ("ab ac ad ag ai al am an ap ar as at au av ba be bi bl bo br bu ca ce ch ci ck cl co cr ct cu da de di do ea ec ed ee ei el em en "
                "ep er es et eu ev ex fa fe fi fo fr ga ge gh gi go gr gu ha he hi ho ht ia ic id ie if ig il im in io ir is it iv ke ki la ld le "
                "li ll lo lt lu ly ma me mi mm mo mp mu na nc nd ne ng ni nn no ns nt nu oc od of og ol om on oo op or os ot ou ov ow pa pe ph pi "
                "pl po pp pr qu ra rc rd re ri rk rm rn ro rs rt ru ry sa sc se sh si so sp ss st su ta te th ti to tr ts tt tu ty ub uc ue ul um "
                "un up ur us ut va ve vi wa we wh wi wo ye")
#: the share of common pairs that ordinary tokens reach
ORDINARY = 0.75
RATE, ALPHA = 0.05, 0.001
#: z-scores against ordinary tokens are compared in steps of a quarter, from 0 to 20
BINS, BIN_WIDTH = 80, 0.25


def _encoding(core: Column) -> Column:
    """The narrowest alphabet holding the token, whose separators are out if it is of one case."""
    fits = {"digits": "[0-9]+", "hex": "[0-9a-f]+|[0-9A-F]+", "letters": "[a-z]+|[A-Z]+", "base32": "[A-Z2-7]+|[a-z2-7]+",
            "alnum36": "[0-9a-z]+|[0-9A-Z]+", "letters52": "[A-Za-z]+", "alnum": "[0-9A-Za-z]+", "base64": "[0-9A-Za-z+/]+"}
    return F.coalesce(*[F.when(core.rlike(f"^(?:{fits[k]})$"), k) for k in ALPHABETS])


def _ordinary_pairs(core: Column, encoding: Column) -> tuple[Column, Column]:
    """How many neighbouring symbols are told as common or not, and how many of them are common.

    Equal letters count as common; a capital after a small letter, and two digits beside letters,
    say nothing.  In numbers, digits that repeat or step by one are the common ones."""
    starts: dict[str, str] = {}
    for pair in COMMON_PAIRS.split():
        starts[pair[0]] = starts.get(pair[0], "") + pair[1]
    common = "|".join(f"{x}[{y}]" for x, y in starts.items())
    steps = "|".join(f"{d}[{''.join(str(e) for e in (d - 1, d, d + 1) if 0 <= e <= 9)}]" for d in range(10))
    letters = F.regexp_count(core, F.lit("(?=[A-Za-z][A-Za-z])(?![a-z][A-Z])"))
    mixed = F.regexp_count(core, F.lit("(?=[A-Za-z][0-9]|[0-9][A-Za-z])"))
    usual = F.regexp_count(core, F.lit(rf"(?=(?i:{common}|([a-z])\1))(?![a-z][A-Z])"))
    number = encoding == "digits"
    return (F.when(number, F.length(core) - 1).otherwise(letters + mixed).cast("double"),
            F.when(number, F.regexp_count(core, F.lit(f"(?={steps})"))).otherwise(usual).cast("double"))


def with_battery(tokens: DataFrame, value: str) -> DataFrame:
    """Add ``encoding`` (NULL: not tested), the battery's ``z_chi``, ``z_runs``, ``z_serial`` and ``uniform``,
    and ``z_text``, the evidence against an ordinary token, for the token in column ``value``."""
    whole = F.regexp_replace(F.col(value), "=+$", "")
    both = F.col(value).rlike("[A-Z]") & F.col(value).rlike("[a-z]")
    date = F.col(value).rlike("(?:19|20)[0-9]{2}[-_/](?:0?[1-9]|1[0-2])[-_/]")
    core = F.when(both, F.translate(whole, "-_", "+/")).otherwise(F.translate(whole, "-_+/", ""))
    kept = tokens.columns
    t = tokens.select("*", core.alias("__core"), whole.alias("__whole"))
    t = t.select("*", F.when((3 * F.length("__core") >= 2 * F.length("__whole")) & ~date, _encoding(F.col("__core"))).alias("encoding"))
    n_pairs, n_common = _ordinary_pairs(F.col("__core"), F.col("encoding"))
    folded = (F.when(F.col("encoding").isin("hex", "letters", "alnum36"), F.lower("__core"))
              .when(F.col("encoding") == "base32", F.upper("__core")).otherwise(F.col("__core")))
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])[F.col("encoding")]
    t = t.select(*kept, "encoding", n_pairs.alias("__pairs"), n_common.alias("__common"), folded.alias("__core"), alphabet.alias("__abc"))
    t = t.select(*kept, "encoding", "__pairs", "__common", F.length("__abc").cast("double").alias("__k"), F.when(F.col("encoding").isNotNull(), F.transform(
        F.split("__core", ""), lambda c: (F.instr(F.col("__abc"), c) - 1).cast("double"))).alias("__ix"))
    ix, n = F.col("__ix"), F.size("__ix").cast("double")
    # symbols are centred on the alphabet's middle: mean 0 and variance (k^2 - 1) / 12 if random
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    squares = total(F.transform(F.array_distinct(ix), lambda c: F.pow(F.size(F.filter(ix, lambda x: x == c)).cast("double"), F.lit(2.0))))
    mid = (F.col("__k") - 1) / 2
    pairs = F.zip_with(F.slice(ix, 1, F.greatest(F.size(ix) - 1, F.lit(0))), F.slice(ix, 2, F.greatest(F.size(ix) - 1, F.lit(0))),
                       lambda x, y: F.struct((x - mid).alias("x"), (y - mid).alias("y")))
    sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("turns"), F.lit(0.0).alias("serial")), lambda a, p: F.struct(
        (a["turns"] + F.when((p["x"] > 0) != (p["y"] > 0), 1.0).otherwise(0.0)).alias("turns"), (a["serial"] + p["x"] * p["y"]).alias("serial")))
    t = t.select(*kept, "encoding", "__pairs", "__common", "__k", n.alias("__n"), (F.col("__k") / n * squares - n).alias("__chi"), sums.alias("__sums"))
    df = "(__k - 1)"
    tested = F.col("encoding").isNotNull()
    t = t.select(
        *kept, "encoding",
        # Wilson-Hilferty: the cube root of chi-squared over its freedom is nearly normal
        F.expr(f"(pow(greatest(__chi, 0D) / {df}, 1D / 3) - (1 - 2 / (9D * {df}))) / sqrt(2 / (9D * {df}))").alias("z_chi"),
        F.expr("abs(__sums.turns - (__n - 1) / 2) / (sqrt(__n - 1) / 2)").alias("z_runs"),
        F.expr("abs(__sums.serial) / (sqrt(__n - 1) * (__k * __k - 1) / 12)").alias("z_serial"),
        F.when(tested & (F.col("__pairs") > 0), (ORDINARY * F.col("__pairs") - F.col("__common") - 0.5)
               / F.sqrt(F.col("__pairs") * ORDINARY * (1 - ORDINARY))).when(tested, F.lit(0.0)).alias("z_text"))
    one, two = NormalDist().inv_cdf(1 - ALPHA / 3), NormalDist().inv_cdf(1 - ALPHA / 6)
    return t.withColumn("uniform", F.coalesce((F.col("z_chi") <= one) & (F.col("z_runs") <= two) & (F.col("z_serial") <= two), F.lit(False)))


def _family(length: Column, encoding: Column) -> Column:
    klass = F.lit(LENGTHS[0])
    for n in LENGTHS[1:]:
        klass = F.when(length >= n, n).otherwise(klass)
    return F.concat_ws(":", encoding, klass)


def upper_tail(z: float) -> float:
    """P(Z >= z) of a standard normal variable."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def reporting_bins(tests: DataFrame, rate: float = RATE) -> DataFrame:
    """``(family, bin)`` of tokens -> ``(family, cut)``: bins from ``cut`` on are not ordinary.

    Benjamini-Hochberg on a histogram: the cut is the least bin whose p-value e, that of its lower edge, is
    no greater than rate * (tokens from it on) / (tokens).  The histogram has at most
    families x bins rows, whatever the corpus."""
    counts = tests.groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("family").orderBy(F.desc("bin"))
    edge = F.get(F.array(*[F.lit(upper_tail(i * BIN_WIDTH)) for i in range(BINS + 1)]), F.col("bin"))
    return (counts.withColumn("beyond", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("family")))
            .filter((F.col("bin") > 0) & (edge <= F.lit(rate) * F.col("beyond") / F.col("m"))).groupBy("family").agg(F.min("bin").alias("cut")))


def secret_spans(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``(doc_id, text, ...)`` -> ``(doc_id, row_key, spans)``, one row per row, spans in order of
    start, then kind.

    A NULL text counts as empty.  Base kinds stay whatever the battery says; a token that overlaps
    one is not tested.  Two passes: the tokens of all documents set the cuts, then the cuts decide.
    Repeated rows give repeated results (``row_key`` is made of the id and the text).  Very long texts, and
    texts of very many matches, take time in proportion to their length; tokens have any length."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assign = F.filter(find_spans(body, "assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    access = F.when(F.contains(body, F.lit("AKIA")), find_spans(body, "access", ACCESS)).otherwise(F.array().cast(f"array<{SPAN}>"))
    found = docs.select("doc_id", row_key(text).alias("row_key"), F.concat(assign, access, find_spans(body, "hex", HEX)).alias("base"),
                        find_spans(body, "random", TOKEN).alias("tokens"))
    found = stash(found.withColumn("tokens", meeting(F.filter("tokens", lambda s: s["value"].rlike("[0-9A-Za-z]")), F.col("base"), keep=False)), "secret_spans")
    each = found.filter(F.size("tokens") > 0).select("row_key", F.explode("tokens").alias("t"))
    each = with_battery(each.withColumn("value", F.col("t.value")), "value").filter("encoding is not null")
    each = stash(each.select("row_key", "t", "uniform", _family(F.length("value"), F.col("encoding")).alias("family"),
                             F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(F.col("z_text") / BIN_WIDTH))).cast("int").alias("bin")), "battery")
    # at most one row per encoding and length class
    cuts = {r["family"]: r["cut"] for r in reporting_bins(each, rate).collect()}
    cut = F.coalesce(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])[F.col("family")], F.lit(BINS + 1)) if cuts else F.lit(BINS + 1)
    random = each.filter((F.col("bin") >= cut) & F.col("uniform")).groupBy("row_key").agg(F.collect_set("t").alias("more"))
    return found.join(random, "row_key", "left").select("doc_id", "row_key", by_start(
        F.concat("base", F.coalesce("more", F.slice("base", 1, 0))), KINDS).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return secret_spans(docs).select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def without_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every secret in their text replaced by ``mask``; clean documents are unchanged.

    A changed document's ``n_chars`` is counted anew.  No row is removed or repeated."""
    spans = secret_spans(docs).filter(F.size("spans") > 0).dropDuplicates(["row_key"]).select(
        F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans"))
    hit = docs.withColumn("__row_key", row_key("text")).join(spans, "__row_key", "left")
    clean = F.col("__spans").isNull()
    out = hit.withColumn("text", F.when(clean, F.col("text")).otherwise(redacted(F.col("text"), F.col("__spans"), mask)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
