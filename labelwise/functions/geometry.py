"""Box and polygon arithmetic.

Pixel boxes are structs ``x1, y1, x2, y2``; normalized boxes ``cx, cy, w, h``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import text as X
from labelwise.functions.spans import let


def clamp(value: Column, low, high) -> Column:
    """Bounded value; callers pass non-null input, as greatest/least skip nulls."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clamp_penalty(value: Column, fallback: Column) -> Column:
    """Whole rupees in 0..ceiling; junk falls back."""
    number = F.trim(value.cast("string")).try_cast("double")
    whole = F.when(number.isNotNull() & ~F.isnan(number), clamp(number, -1e15, 1e15).cast("long"))
    bounded = F.when(whole.isNotNull(), clamp(whole, 0, K.PENALTY_CEILING))
    return F.coalesce(bounded, fallback.cast("long")).cast("int")


def clip_box(b: Column, width: Column, height: Column) -> Column:
    return F.struct(
        clamp(b["x1"], 0, width).alias("x1"),
        clamp(b["y1"], 0, height).alias("y1"),
        clamp(b["x2"], 0, width).alias("x2"),
        clamp(b["y2"], 0, height).alias("y2"),
    )


def has_area(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def pad_box(b: Column, width: Column, height: Column, margin: float = 0.04) -> Column:
    """Grow a box by a share of its sides plus two pixels, inside the image."""
    px = F.bround((b["x2"] - b["x1"]) * margin, 0).cast("int") + 2
    py = F.bround((b["y2"] - b["y1"]) * margin, 0).cast("int") + 2
    return F.struct(
        F.greatest(F.lit(0), b["x1"] - px).alias("x1"),
        F.greatest(F.lit(0), b["y1"] - py).alias("y1"),
        F.least(width, b["x2"] + px).alias("x2"),
        F.least(height, b["y2"] + py).alias("y2"),
    )


def quad_to_box(points: Column) -> Column:
    """Hull of ``array<array<double>>`` corner points."""
    def side(i: int, pick) -> Column:
        return pick(F.transform(points, lambda p: F.get(p, F.lit(i)))).cast("int")

    return F.struct(
        side(0, F.array_min).alias("x1"),
        side(1, F.array_min).alias("y1"),
        side(0, F.array_max).alias("x2"),
        side(1, F.array_max).alias("y2"),
    )


def row_kind(vals: Column) -> Column:
    n = F.size(vals)
    return (
        F.when(n == 4, "bbox").when((n >= 6) & (n % 2 == 0), "polygon").otherwise("unknown")
    )


def _from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(
        ((x1 + x2) / 2).alias("cx"),
        ((y1 + y2) / 2).alias("cy"),
        (x2 - x1).alias("w"),
        (y2 - y1).alias("h"),
    )


def polygon_to_box(vals: Column) -> Column:
    """Clamped hull of flat x, y, x, y, ... coordinates."""
    def axis(odd: int) -> Column:
        return F.transform(
            F.filter(vals, lambda v, i: i % 2 == odd), lambda v: clamp(v, 0.0, 1.0)
        )

    return let(
        F.struct(axis(0).alias("x"), axis(1).alias("y")),
        lambda p: _from_corners(
            F.array_min(p["x"]), F.array_min(p["y"]), F.array_max(p["x"]), F.array_max(p["y"])
        ),
    )


def _box_row(vals: Column) -> Column:
    cx, cy, w, h = (F.get(vals, F.lit(i)) for i in range(4))
    return _from_corners(
        clamp(cx - w / 2, 0.0, 1.0),
        clamp(cy - h / 2, 0.0, 1.0),
        clamp(cx + w / 2, 0.0, 1.0),
        clamp(cy + h / 2, 0.0, 1.0),
    )


def row_to_box(vals: Column) -> Column:
    """The box the annotator meant, by the row's own encoding; null if unknown."""
    kind = row_kind(vals)
    return F.when(kind == "bbox", _box_row(vals)).when(kind == "polygon", polygon_to_box(vals))


def loader_box(vals: Column, segment_file: Column) -> Column:
    """The box a loader takes: in a segment file every even row reads as a polygon."""
    n = F.size(vals)
    as_polygon = F.when((n >= 2) & (n % 2 == 0), polygon_to_box(vals))
    return F.when(segment_file, as_polygon).when(n == 4, _box_row(vals))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two normalized boxes, 0 when the union is empty."""
    def span(box: Column, c: str, s: str) -> tuple[Column, Column]:
        return box[c] - box[s] / 2, box[c] + box[s] / 2

    (ax1, ax2), (ay1, ay2) = span(a, "cx", "w"), span(a, "cy", "h")
    (bx1, bx2), (by1, by2) = span(b, "cx", "w"), span(b, "cy", "h")
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(
        zero, F.least(ay2, by2) - F.greatest(ay1, by1)
    )
    area_a = F.greatest(zero, ax2 - ax1) * F.greatest(zero, ay2 - ay1)
    area_b = F.greatest(zero, bx2 - bx1) * F.greatest(zero, by2 - by1)
    return let(
        F.struct(inter.alias("i"), (area_a + area_b - inter).alias("u")),
        lambda p: F.when(p["u"] > 0, p["i"] / p["u"]).otherwise(0.0),
    )


def min_side(b: Column) -> Column:
    return F.least(b["w"], b["h"])


def six_digits(x: Column) -> Column:
    """A value in 0..1 with six decimals, rounded from its exact binary value.

    Centres of six-digit corners sit on rounding ties all the time, and the
    shortest decimal form of a double hides on which side of the tie it lies.
    Scaled by a power of two the double is a whole number, so the tie is decided
    in exact decimals.
    """
    def at(bits: int) -> Column:
        unit = F.lit(str(2**bits)).cast("decimal(24,0)")
        half = F.lit(str(2 ** (bits - 1))).cast("decimal(24,0)")
        whole = (x * float(2**bits)).cast("long").cast("decimal(19,0)")
        millionths = whole * F.lit("1000000").cast("decimal(7,0)")
        q = F.call_function("div", millionths, unit)
        rest = millionths - q.cast("decimal(7,0)") * unit
        up = (rest > half) | ((rest == half) & (q % 2 == 1))
        return q + F.when(up, 1).otherwise(0)

    n = F.when(x >= 2.0**-8, at(60)).when(x >= 2.0**-16, at(68)).otherwise(at(76))
    return F.format_string("%d.%06d", F.floor(n / 1000000).cast("int"), (n % 1000000).cast("int"))


def format_row(class_id: Column, b: Column) -> Column:
    return F.concat_ws(
        " ", class_id.cast("string"), *[six_digits(b[c]) for c in ("cx", "cy", "w", "h")]
    )


def crop_box(b: Column, width: Column, height: Column, margin: float = 0.04) -> Column:
    """Pixel crop of a normalized box with a margin; truncates like integer casts."""
    px, py = b["w"] * margin, b["h"] * margin
    return F.struct(
        F.greatest(F.lit(0), ((b["cx"] - b["w"] / 2 - px) * width).cast("int")).alias("x1"),
        F.greatest(F.lit(0), ((b["cy"] - b["h"] / 2 - py) * height).cast("int")).alias("y1"),
        F.least(width, ((b["cx"] + b["w"] / 2 + px) * width).cast("int")).alias("x2"),
        F.least(height, ((b["cy"] + b["h"] / 2 + py) * height).cast("int")).alias("y2"),
    )


def readable_crop(b: Column) -> Column:
    return (b["x2"] - b["x1"] >= 8) & (b["y2"] - b["y1"] >= 6)


def crop_key(split: Column, stem: Column, cls: Column, b: Column) -> Column:
    return F.format_string("%s/%s#%s@%d,%d", split, stem, cls, b["x1"], b["y1"])


def character_error_rate(prediction: Column, truth: Column) -> Column:
    """Edit distance over reference length; null for an empty reference."""
    ref = X.cer_normalize(truth)
    return F.when(
        F.length(ref) > 0,
        F.levenshtein(X.cer_normalize(F.coalesce(prediction, F.lit(""))), ref) / F.length(ref),
    )
