"""Span algebra on array columns.

A span is ``struct<st, en, txt, g>``: character offsets, the matched text and
the captured groups.  All spans of a text live in one array column, so finding,
relating and picking them is a narrow projection with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode noncharacters: reserved for internal use, never valid in exchanged text.
SPAN, GROUP, BODY, END = "﷐", "﷑", "﷒", "﷓"

#: Spans are found in blocks, for an array is copied whenever a span is added to it.
BLOCK = 128

SPAN_TYPE = "struct<st:int,en:int,txt:string,g:array<string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def match_spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """All non-overlapping matches of ``pattern`` in ``text`` with offsets."""
    if groups > 9:
        raise ValueError("at most nine groups")
    parts = "".join(f"${i}{GROUP}" for i in range(1, groups + 1))
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{SPAN}{parts}{BODY}$0{END}"))
    pieces = F.split(marked, SPAN)
    start = F.expr(
        f"named_struct('pos', 0, 'found', cast(array() as array<{SPAN_TYPE}>))"
    )

    def step(acc: Column, piece: Column) -> Column:
        head = F.substring_index(piece, BODY, 1)
        hit = F.substring_index(F.substring_index(piece, END, 1), BODY, -1)
        gap = F.substring_index(piece, END, -1)
        end = acc["pos"] + F.length(hit)
        caught = F.slice(F.split(head, GROUP), 1, groups) if groups else F.expr(
            "cast(array() as array<string>)"
        )
        span = F.struct(
            acc["pos"].alias("st"), end.alias("en"), hit.alias("txt"), caught.alias("g")
        )
        return F.struct(
            (end + F.length(gap)).alias("pos"),
            F.array_append(acc["found"], span).alias("found"),
        )

    def with_offset(acc: Column, piece: Column) -> Column:
        # the first piece is the text before any match
        return F.when(
            F.contains(piece, F.lit(END)), step(acc, piece)
        ).otherwise(
            F.struct((acc["pos"] + F.length(piece)).alias("pos"), acc["found"].alias("found"))
        )

    def block(acc: Column, k: Column) -> Column:
        fresh = F.struct(acc["pos"].alias("pos"), F.slice(acc["none"], 1, 0).alias("found"))
        grown = F.aggregate(F.slice(acc["pieces"], k * BLOCK + 1, F.lit(BLOCK)), fresh, with_offset)
        return let(
            grown,
            lambda g: F.struct(
                g["pos"].alias("pos"), acc["pieces"].alias("pieces"), acc["none"].alias("none"), F.array_append(acc["blocks"], g["found"]).alias("blocks")
            ),
        )

    def blocks(pieces: Column) -> Column:
        first = F.struct(
            F.lit(0).alias("pos"),
            pieces.alias("pieces"),
            F.expr(f"cast(array() as array<{SPAN_TYPE}>)").alias("none"),
            F.expr(f"cast(array() as array<array<{SPAN_TYPE}>>)").alias("blocks"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), first, block, lambda acc: F.flatten(acc["blocks"]))

    return let(
        pieces,
        lambda p: F.when(F.size(p) <= BLOCK, F.aggregate(p, start, with_offset, lambda acc: acc["found"])).when(p.isNotNull(), blocks(p)),
    )


def first(spans: Column) -> Column:
    return F.get(spans, F.lit(0))


def last(spans: Column) -> Column:
    return F.get(spans, F.size(spans) - 1)


def group(span: Column, n: int) -> Column:
    """Captured group ``n`` of a span; null when it took no part in the match."""
    return F.nullif(F.get(span["g"], F.lit(n - 1)), F.lit(""))


def gap(a: Column, b: Column) -> Column:
    """Characters between two spans, 0 when they touch or overlap."""
    return F.greatest(F.lit(0), b["st"] - a["en"], a["st"] - b["en"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["st"] < b["en"]) & (b["st"] < a["en"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["st"] <= inner["st"]) & (inner["en"] <= outer["en"])


def drop_overlaps(spans: Column) -> Column:
    """Keep spans greedily by start then length, dropping what overlaps a kept one.

    Sorted by start, the kept spans never overlap one another, so comparing with
    the furthest kept end is enough.
    """
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["st"] != b["st"], a["st"] - b["st"]).otherwise(b["en"] - a["en"]),
    )
    start = F.struct(F.lit(-1).alias("end"), F.slice(spans, 1, 0).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(
            s["st"] >= acc["end"],
            F.struct(s["en"].alias("end"), F.array_append(acc["kept"], s).alias("kept")),
        ).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def before_match(text: Column, pattern: str) -> Column:
    """Text in front of the first match (all of it when there is none)."""
    return F.regexp_replace(text, f"(?s)(?:{pattern}).*", "")


def cut_match(text: Column, pattern: str, filler: str) -> Column:
    """Text with its first match replaced by ``filler``."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", f"$1{filler}")
