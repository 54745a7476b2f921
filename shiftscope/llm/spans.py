"""Spans of regular-expression matches as Spark columns, in code points, end exclusive.

The work stays near linear in a text's matches: running positions are added up in runs of ``RUN`` matches
and over the runs, so no array is copied once per match; texts are cut by blocks of ``BLOCK`` code
points, since a substring is otherwise counted from the start of the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"
RUN = 128
BLOCK = 4096


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def runs(items: Column, size: int = RUN) -> Column:
    """The array cut into arrays of up to ``size`` items."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")),
                                                 lambda k: F.slice(items, k * size + 1, F.lit(size)))).otherwise(F.slice(F.array(items), 1, 0))


def _placed(pairs: Column, kind: str) -> Column:
    """Spans of ``pairs``: structs of a match, the gap before it and the texts around it."""
    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["value"].alias("value"),
                        pair["before"].alias("before"), pair["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def within(run: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        return F.aggregate(run, start, add, lambda acc: acc["spans"])

    def place(cut: Column) -> Column:
        width = F.transform(cut, lambda run: F.aggregate(run, F.lit(0), lambda a, p: a + p["gap"] + F.length(p["value"])))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(width, first, lambda a, w: F.struct((a["at"] + w).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
                             lambda a: a["starts"])
        return F.flatten(F.zip_with(cut, starts, within))

    return bound(runs(pairs), place)


def find_spans(text: Column, kind: str, regex: str, near: int = 0) -> Column:
    """``array<struct<kind, start, end, value, before, after>>`` of the leftmost non-overlapping matches.

    The pieces between the matches and the matches themselves give the positions: a match starts after
    all pieces and matches before it.  ``before`` and ``after`` are the up to ``near`` characters on either
    side, as far as the neighbouring match.  ``regex`` must not match the empty string."""
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def pairs(pieces: Column) -> Column:
        # there is one piece more than there are matches
        later = F.slice(pieces, 2, F.size(pieces))
        return F.zip_with(F.zip_with(matches, pieces, lambda m, g: F.struct(m.alias("value"), g.alias("left"))), later, lambda x, g: F.struct(
            x["value"].alias("value"), F.length(x["left"]).alias("gap"), F.right(x["left"], F.lit(near)).alias("before"), F.left(g, F.lit(near)).alias("after")))

    spans = bound(F.split(text, regex, -1), lambda pieces: bound(F.filter(pairs(pieces), lambda p: p["value"].isNotNull()), lambda p: _placed(p, kind)))
    return spans


def meeting(spans: Column, others: Column, keep: bool) -> Column:
    """The ``spans`` that overlap one of ``others`` (``keep``) or none: whole runs of ``others`` are passed by."""
    def chosen(parts: Column) -> Column:
        def hit(s: Column) -> Column:
            return F.exists(parts, lambda r: (r["lo"] < s["end"]) & (s["start"] < r["hi"]) & F.exists(
                r["run"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.filter(spans, lambda s: hit(s) if keep else ~hit(s))

    bounds = F.transform(runs(others), lambda run: F.struct(
        run.alias("run"), F.array_min(F.transform(run, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(run, lambda b: b["end"])).alias("hi")))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), F.slice(spans, 1, 0) if keep else spans).otherwise(bound(bounds, chosen))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans in order of start, then of kind as listed in ``kinds``, then of end."""
    order = F.array(*[F.lit(k) for k in kinds])
    names = ("kind", "start", "end", "value", "before", "after")
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("first"), F.array_position(order, s["kind"]).alias("rank"),
                                                  s["end"].alias("last"), *[s[n].alias(n) for n in names]))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(*[s[n].alias(n) for n in names]))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span replaced by ``mask``; ``spans`` in order of start, overlaps allowed."""
    # the stretches of text between spans that do not overlap: (from, to) in code points
    def step(acc: Column, s: Column) -> Column:
        cut = F.when(s["start"] >= acc["at"], F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["cuts"], cut).alias("cuts"))

    def stretches(cut: Column) -> Column:
        # where each run of spans begins: the furthest end of the runs before it
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        furthest = F.transform(cut, lambda run: F.array_max(F.transform(run, lambda s: s["end"])))
        starts = F.aggregate(furthest, first, lambda a, e: F.struct(F.greatest(a["at"], e).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))
        none = F.array().cast("array<struct<a:int,b:int>>")
        return bound(starts, lambda st: F.struct(st["at"].alias("last"), F.flatten(F.zip_with(cut, st["starts"], lambda run, at: F.aggregate(
            run, F.struct(at.alias("at"), none.alias("cuts")), step, lambda acc: acc["cuts"]))).alias("cuts")))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        one = F.substring(F.get(blocks, i), a - i * BLOCK + 1, b - a)
        many = F.concat(F.substring(F.get(blocks, i), a - i * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
                        F.substring(F.get(blocks, j), F.lit(1), b - j * BLOCK))
        return F.when(b <= a, F.lit("")).when(i == j, one).otherwise(many)

    def cut_out(blocks: Column) -> Column:
        return bound(bound(runs(spans), stretches), lambda found: F.concat(
            F.array_join(F.transform(found["cuts"], lambda c: F.concat(piece(blocks, c["a"], c["b"]), F.lit(mask))), ""),
            piece(blocks, found["last"], F.greatest(F.length(text), found["last"]))))

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut_out))
