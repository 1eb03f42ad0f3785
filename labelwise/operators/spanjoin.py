"""Span relations as joins on span tables (``doc_id, st, en, ...``), for spans of any length.

Spans are indexed by levels: level ``l`` is for spans of up to ``2 ** l`` characters and has buckets of that width,
so a span's home is one bucket of its own level, or two neighbours.  Of a pair, the shorter span looks up the longer
one: at each level that its document has on the other side, from its own upward, it visits the one or two buckets it
lies in.  Spans of one length thus meet at one level, a long span costs its document one more level to visit, and
no span is ever spread over its characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.functions import spans as S
from labelwise.session import spread, written

#: Spans of up to 2 ** LEAST characters share the lowest level.
LEAST = 5
TOP = 31
#: Up to so many levels of both sides together, all documents visit them all; beyond it each visits only its own.
SHARED_LEVELS = 4


def span_table(df: DataFrame, key: str, text: str, pattern: str, kind: str, groups: int = 0, also: Sequence[str] = ()) -> DataFrame:
    """All matches of a pattern as rows, with the columns ``also`` of their text."""
    found = S.match_spans(F.col(text), pattern, groups)
    return spread(df).select(F.col(key).alias("doc_id"), *also, F.inline(found)).select(
        "doc_id", *also, F.lit(kind).alias("kind"), "st", "en", "txt", F.col("g").alias("groups")
    )


def span_tables(df: DataFrame, key: str, text: str, patterns: dict[str, str], also: Sequence[str] = ()) -> DataFrame:
    """All matches of several patterns by kind, from one reading of the texts."""
    def found(kind: str, pattern: str) -> Column:
        row = lambda s: F.struct(F.lit(kind).alias("kind"), s["st"].alias("st"), s["en"].alias("en"), s["txt"].alias("txt"))
        return F.transform(S.match_spans(F.col(text), pattern), row)

    every = F.concat(*[found(*p) for p in patterns.items()])
    return spread(df).select(F.col(key).alias("doc_id"), *also, F.inline(every))


# --- the index --------------------------------------------------------------


def _level(start: Column, end: Column) -> Column:
    """The least level whose buckets are as wide as the span."""
    bits = F.length(F.bin(F.greatest(end - start - 1, F.lit(0)).cast("long")))
    return F.greatest(F.lit(LEAST), bits)


def _mask(spans: DataFrame, name: str) -> DataFrame:
    """The levels that each document has, one bit each."""
    return spans.groupBy(F.col("doc_id").alias(f"{name}_doc")).agg(F.bit_or(F.expr("shiftleft(1L, _level)")).alias(name))


def _levels(spans: DataFrame) -> int:
    """The levels that any document has."""
    return spans.agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, _level)")), F.lit(0).cast("long"))).first()[0]


def _places(levels: str, side: int) -> Column:
    """The buckets that a span lies in at each of ``levels``, none below its own: at most two a level.

    A place is one number: bucket, level (5 bits) and whose home it is (1 bit).
    """
    return F.expr(
        f"flatten(transform({levels}, l -> transform(sequence(shiftright(_lo, l), shiftright(_hi, l)), b -> shiftleft(b, 6) + l * 2 + {side})))"
    )


def _level_list(mask: int) -> str:
    found = [str(l) for l in range(LEAST, TOP + 1) if mask >> l & 1]
    return f"array({', '.join(found)})" if found else "cast(array() as array<int>)"


def _indexed(left: DataFrame, right: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """Both sides as index rows keyed by document, level, bucket and whose home the bucket is.

    Right spans are widened by the reach, so that a pair is near if its intervals touch.
    """
    a = left.withColumns({"_lo": F.col("st").cast("long"), "_hi": F.col("en").cast("long")})
    b = right.select("doc_id", *[F.col(c).alias(f"r_{c}") for c in ("kind", "st", "en", "txt") if c in right.columns])
    b = b.withColumns({"_lo": F.col("r_st").cast("long") - reach, "_hi": F.col("r_en").cast("long") + reach})
    a, b = (d.withColumn("_level", _level(F.col("_lo"), F.col("_hi"))) for d in (a, b))
    of_a, of_b = _levels(a), _levels(b)
    if of_a.bit_count() + of_b.bit_count() <= SHARED_LEVELS:
        a, b = a.withColumn("_theirs", F.lit(of_b).cast("long")), b.withColumn("_theirs", F.lit(of_a).cast("long"))
        all_a, all_b = _level_list(of_a), _level_list(of_b)
    else:
        # a document's levels are one small row; documents without spans on the other side end here
        a = a.join(_mask(b, "_theirs"), a["doc_id"] == F.col("_theirs_doc")).drop("_theirs_doc")
        b = b.join(_mask(a.select("doc_id", "_level"), "_theirs"), b["doc_id"] == F.col("_theirs_doc"))
        all_a = all_b = f"sequence({LEAST}, {TOP})"

    has = "(shiftright(_theirs, l) & 1L) = 1L"
    home = "array(_level)"
    # left looks up right's homes from its own level upward, right looks up left's above its own
    a_rows = F.concat(
        _places(f"filter({all_b}, l -> l >= _level AND {has})", 1),
        _places(f"CASE WHEN exists({all_b}, l -> l < _level AND {has}) THEN {home} ELSE slice({home}, 1, 0) END", 0),
    )
    b_rows = F.concat(
        _places(f"CASE WHEN exists({all_a}, l -> l <= _level AND {has}) THEN {home} ELSE slice({home}, 1, 0) END", 1),
        _places(f"filter({all_a}, l -> l > _level AND {has})", 0),
    )
    a = a.withColumn("_at", F.explode(a_rows)).drop("_theirs", "_level", "_hi")
    b = b.select("doc_id", *[c for c in b.columns if c.startswith("r_")], F.col("_lo").alias("_rlo"), F.explode(b_rows).alias("_at"))
    if dict(left.dtypes)["doc_id"] in ("bigint", "int"):
        return a, b
    # rows are sorted by a number first, whatever the type of the document
    return tuple(d.withColumn("_hash", F.xxhash64("doc_id", "_at")) for d in (a, b))


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Pairs whose gap is at most ``reach``, each once; right columns carry the prefix ``r_``.

    Levels and index rows both read the spans, which often come out of texts, so both sides come written.
    """
    a, b = _indexed(left, right, reach)
    # of the buckets that both lie in, the one with the later start counts
    once = F.expr("shiftright(greatest(_lo, _rlo), cast(shiftright(_at, 1) & 31 as int)) = shiftright(_at, 6)")
    on = [c for c in ("_hash", "doc_id", "_at") if c in a.columns]
    return a.join(b, on).where(once & (_distance() <= reach)).drop("_hash", "_at", "_lo", "_rlo")


def _distance() -> Column:
    return F.greatest(F.lit(0), F.col("r_st") - F.col("en"), F.col("st") - F.col("r_en"))


# --- relations --------------------------------------------------------------


def _keys(id_col: str | Sequence[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def _places_of(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What of ``spans`` goes into a join: their places and keys."""
    return spans.select(*dict.fromkeys(["doc_id", "st", "en", *keys]))


def nearest_span(left: DataFrame, labels: DataFrame, reach: int, id_col: str | Sequence[str]) -> DataFrame:
    """Each left span's nearest label within reach, first label on a tie; ``id_col`` tells the left spans apart."""
    left, keys = written(left), _keys(id_col)
    labels = written(labels.select("doc_id", "kind", "st", "en"))
    best = _near(_places_of(left, keys), labels, reach).groupBy(*keys).agg(
        F.min_by(
            F.struct(F.col("r_kind").alias("kind"), F.col("r_st").alias("st"), F.col("r_en").alias("en")),
            F.struct(_distance(), F.col("r_st")),
        ).alias("label"),
        F.min(_distance()).alias("gap"),
    )
    return left.join(best, keys, "left")


def _hit(left: DataFrame, right: DataFrame, reach: int, relation: Column) -> DataFrame:
    """Left spans that have a right one within reach in the given relation, each once."""
    pairs = _near(written(left), written(right), reach).where(relation)
    # all columns as keys fold in a hash table, the others as first values would be sorted
    return pairs.select(*left.columns).distinct()


def within_reach(left: DataFrame, right: DataFrame, reach: int, id_col: str | Sequence[str]) -> DataFrame:
    """Left spans that have some right span within reach."""
    return _hit(left, right, reach, F.lit(True))


def following_span(
    anchors: DataFrame, runs: DataFrame, reach: int, id_col: str | Sequence[str], extra: int | None = None, pattern: str | None = None
) -> DataFrame:
    """First run that starts 0..reach characters after each anchor's end.

    With ``extra``, only the text from the anchor's end up to ``reach + extra`` counts: a run is cut at both
    ends of that window, and what is left must still match ``pattern``, whose match becomes the run.
    """
    window = reach if extra is None else reach + extra
    anchors, keys = written(anchors), _keys(id_col)
    after = _places_of(anchors, keys).withColumns({"_st": F.col("st"), "st": F.col("en"), "en": F.col("en") + window})
    pairs = _near(after, written(runs), 0).withColumns({"en": F.col("st"), "st": F.col("_st")}).drop("_st")
    if extra is not None:
        begin = F.greatest("r_st", "en")
        clipped = F.substring(F.col("r_txt"), begin - F.col("r_st") + 1, F.least("r_en", F.col("en") + window) - begin)
        pairs = pairs.withColumn("_clip", clipped)
        pairs = pairs.withColumn("r_txt", F.regexp_extract("_clip", pattern, 0)).where("r_txt <> ''")
        pairs = pairs.withColumn("r_st", (begin + F.length(S.before_match(F.col("_clip"), pattern))).cast("int"))
        pairs = pairs.withColumn("r_en", F.col("r_st") + F.length("r_txt")).drop("_clip")
    pairs = pairs.where(F.col("r_st").between(F.col("en"), F.col("en") + reach))
    place = F.shiftleft(F.col("r_st").cast("long"), 32) + F.col("r_en")
    text = [F.min_by("r_txt", place).alias("r_txt")] if "r_txt" in pairs.columns else []
    first = pairs.groupBy(*keys).agg(F.min(place).alias("place"), *text)
    run = F.struct(
        F.shiftright("place", 32).cast("int").alias("r_st"), F.expr("place & 4294967295").cast("int").alias("r_en"), *[c for c in ("r_txt",) if text]
    )
    return anchors.join(first.select(*keys, run.alias("run")), keys)


def contained_spans(inner: DataFrame, outer: DataFrame, id_col: str | Sequence[str]) -> DataFrame:
    """Inner spans that lie inside some outer span of their document."""
    return _hit(inner, outer, 0, (F.col("r_st") <= F.col("st")) & (F.col("en") <= F.col("r_en")))


def overlapping_spans(left: DataFrame, right: DataFrame, id_col: str | Sequence[str]) -> DataFrame:
    """Left spans that share a character with some right span."""
    return _hit(left, right, 0, (F.col("st") < F.col("r_en")) & (F.col("r_st") < F.col("en")))
