"""Personal data: regular expressions propose spans, checksums confirm them, context words
near a span adjust its score.  Columns and SQL functions only.

Base kinds (email, ip, card, phone) are reported whenever their own rule holds; the method adds
kinds of its own (iban, ssn, local_phone) whose score, after the words around them, is high enough.

The patterns are written so that a scan stays linear on long runs: a match can only begin
where its first run begins, and runs are taken whole (possessive quantifiers).  They find the
same matches as the plain forms given beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, count_kind, find_spans, joined, meeting

# The kinds in their order, the patterns, and what a span scores on its own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: the chain of digits is taken whole or not at all
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
OWN_SCORE = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "local_phone": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
    "local_phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b",
}
AGAINST = r"(?i)\b(?:version|example|sample|invoice|isbn|order)\b"
NEAR = 40
BONUS, MALUS, LEAST = 0.3, 0.3, 0.5


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def mod97(value: Column) -> Column:
    """ISO 7064 MOD 97-10 over the rearranged number, one character at a time."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    digits = F.transform(F.split(moved, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    rest = F.aggregate(digits, F.lit(0), lambda acc, d: F.when(d < 0, acc).when(d < 10, (acc * 10 + d) % 97).otherwise((acc * 100 + d) % 97))
    return rest == 1


def _holds(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        # a part of more than three digits is over 255 unless it has leading zeros
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")
    return F.lit(True)


def _score(span: Column, kind: str) -> Column:
    around = F.concat(span["before"], F.lit(" "), span["after"])
    return F.round(F.lit(OWN_SCORE[kind]) + F.when(around.rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
                   - F.when(around.rlike(AGAINST), MALUS).otherwise(0.0), 2)


def with_pii_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: ``array<struct<kind, start, end, value, score>>``, by kind as listed, then start.

    A NULL text counts as empty and gives an empty array; all other columns and rows, repeated
    ones included, stay as they are.  Context words count within ``NEAR`` characters on either side, up to the
    next match of the kind.  Additional kinds that overlap a base span are left out.  Very long texts and texts
    of very many matches take time in proportion to their length."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # a cheap test for the character that every match needs, before the full pattern
    needs = {"email": F.contains(body, F.lit("@")), "phone": F.contains(body, F.lit("+"))}
    none = F.array().cast(f"array<{SPAN}>")
    found = docs
    names = {k: f"__{out}_{k}" for k in KINDS}
    found = found.withColumns({
        names[k]: F.filter(F.when(needs[k], find_spans(body, k, PATTERNS[k], NEAR)).otherwise(none) if k in needs
                           else find_spans(body, k, PATTERNS[k], NEAR), lambda s: _holds(k, s["value"])) for k in KINDS})
    parts = []
    for k in KINDS:
        scored = F.transform(F.col(names[k]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                                 s["value"].alias("value"), _score(s, k).alias("score")))
        parts.append(scored if k in BASE_KINDS else F.filter(scored, lambda s: s["score"] >= LEAST))
    base = f"__{out}_base"
    found = found.withColumns({names[k]: p for k, p in zip(KINDS, parts)}).withColumn(base, F.concat(*[F.col(names[k]) for k in BASE_KINDS]))
    own = [meeting(F.col(names[k]), F.col(base), keep=False) for k in KINDS if k not in BASE_KINDS]
    return found.withColumn(out, F.concat(F.col(base), *own)).drop(base, *names.values())


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans, scores."""
    spans = F.col("__spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return with_pii_spans(docs.select("doc_id", "text"), "text", "__spans").select(
        "doc_id", *[count_kind(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))
