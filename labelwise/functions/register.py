"""SQL-callable temporary functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

# the bit-parallel recurrence of text.lcs_length: 62 bits of the first string a word, one addition with carry a word
# for each character of the second
LCS = """aggregate(array(filter(split(a, ''), c -> c <> '')), 0, (z, xs) -> size(xs) - aggregate(
  aggregate(filter(split(b, ''), c -> c <> ''),
    transform(sequence(0, int((size(xs) - 1) div 62)), w -> shiftleft(1L, size(slice(xs, w * 62 + 1, 62))) - 1L),
    (v, y) -> if(array_contains(xs, y), aggregate(sequence(0, size(v) - 1), struct(0L as carry, slice(v, 1, 0) as words),
      (acc, w) -> aggregate(array(aggregate(slice(xs, w * 62 + 1, 62), struct(0L as m, 0 as i),
          (q, x) -> struct(q.m + if(x = y, shiftleft(1L, q.i), 0L) as m, q.i + 1 as i), q -> q.m & v[w])), acc,
        (s, hit) -> struct(shiftright(v[w] + hit + s.carry, 62) as carry, array_append(s.words,
          ((v[w] + hit + s.carry) & (shiftleft(1L, size(slice(xs, w * 62 + 1, 62))) - 1L)) | (v[w] - hit)) as words)),
      acc -> acc.words), v)),
  0, (n, v) -> n + bit_count(v)))"""

FUNCTIONS = {
    "lw_fingerprint(t STRING) RETURNS STRING": "regexp_replace(lower(t), '[^a-z0-9]+', '')",
    "lw_letters(t STRING) RETURNS STRING": "regexp_replace(lower(t), '[^a-z]', '')",
    "lw_indel_ratio(a STRING, b STRING) RETURNS DOUBLE": (
        "case when length(a) + length(b) = 0 then 1.0D "
        "when length(a) = 0 or length(b) = 0 then 0.0D else "
        f"2.0D * {LCS} / (length(a) + length(b)) end"
    ),
    "lw_number(t STRING) RETURNS DOUBLE": (
        r"try_cast(replace(replace(regexp_replace(trim(t), '^(\\d{1,4}) (\\d{2})$', '$1.$2'), "
        "' ', ''), ',', '.') as double)"
    ),
    "lw_iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, "
    "bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE": (
        "coalesce(try_divide("
        "greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)), "
        "(ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - "
        "greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))"
        "), 0D)"
    ),
    "lw_match_starts(t STRING, p STRING) RETURNS ARRAY<INT>": (
        "transform(sequence(1, size(regexp_extract_all(t, p, 0))), i -> "
        "aggregate(slice(split(t, p, -1), 1, i), 0, (n, g) -> n + length(g)) + "
        "aggregate(slice(regexp_extract_all(t, p, 0), 1, i - 1), 0, (n, g) -> n + length(g)))"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Publish the functions for SQL; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
