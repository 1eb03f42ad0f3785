"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

Codebooks improve over rounds, and adaptive bounds in the manner of Drake and Hamerly spare most exact distances.
Written with every vector, for each of its parts: the entry it has, the ``b`` next closest entries in order of a
lower bound on their distance, and one outer bound for all other entries.  When the entries have moved, each bound
shrinks by its entry's drift, the outer one by the largest drift, and bounds are made to ascend from the outer one
inward.  One exact distance, to the part's own entry, then tells how many places of the list are still in doubt:
none (the code stays), some (those are verified by exact whole-number distances), or all (the part is searched anew).
``b`` adapts: it shrinks to what the last round needed, not below an eighth of the entries.

Bounds are whole sixteenths, rounded down, and drifts are rounded up, so no rounding can hide a closer or an equally
close entry; ties go to the lower number by exact comparison.

The codebooks are the model: parts times entries times width, all parameters but the width, and checked.  Vectors,
codes and bounds stay in written tables; a round shuffles the tasks' partial sums only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common, vectors

#: Bounds are kept in this fraction of a unit, in 16 bits; what exceeds them is held as the largest.
UNIT = 16
TOP = 65_535
#: No squared distance from here on can be below a bound, so it is compared as this.
FAR = np.int64(1) << 40
CELLS = 1 << 21
#: Share of the parts decided by their lists for which the next list must be long enough.
SETTLED = 0.99


@dataclass
class Bounds:
    """Of one part position, a row for each vector: code, next entries with their lower bounds, outer bound."""

    code: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray


def _scaled(squares: np.ndarray) -> np.ndarray:
    """A lower bound in units on the root of ``squares``."""
    return np.minimum(vectors.floor_root(np.minimum(squares, FAR) * UNIT**2), TOP)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper bound in units on how far each entry moved, from codebooks (parts, entries, width)."""
    moved = np.minimum(((new - old) ** 2).sum(2), FAR)
    return np.minimum(vectors.ceil_root(moved * UNIT**2), TOP)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    away = points[:, None, :] - entries
    return np.einsum("ijk,ijk->ij", away, away)


def search(points: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Codes of ``points`` by exact distances to all entries, with fresh lists; and the squared distances."""
    squares = _squares(points, book[None])
    order = np.argsort(squares, axis=1, kind="stable")
    ranked = np.take_along_axis(squares, order, 1)
    outer = _scaled(ranked[:, b + 1]) if len(book) > b + 1 else np.full(len(points), TOP)
    return Bounds(order[:, 0], order[:, 1 : b + 1], _scaled(ranked[:, 1 : b + 1]), outer), ranked[:, 0]


def update(points: np.ndarray, book: np.ndarray, drift: np.ndarray, was: Bounds) -> tuple[Bounds, np.ndarray, np.ndarray, int]:
    """Codes after the entries moved: new bounds, squared distances, places of the list in doubt (b + 1: searched
    anew), and how many exact distances it took."""
    n, b = was.near.shape
    others = b < len(book) - 1
    low = np.maximum(was.low - drift[was.near], 0)
    outer = np.maximum(was.outer - drift.max(initial=0), 0) if others else was.outer
    own = _squares(points, book[was.code][:, None, :])[:, 0]
    bounds = np.concatenate([low, outer[:, None]], 1) if others else low
    ascending = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]
    doubt = (ascending**2 <= (np.minimum(own, FAR) * UNIT**2)[:, None]).sum(1)
    now = Bounds(was.code.copy(), was.near.copy(), low, outer)
    best = own.copy()
    looked = n
    some = np.flatnonzero((doubt > 0) & (doubt <= b))
    if len(some):
        near, place = was.near[some], np.arange(b)[None, :]
        checked = place < doubt[some][:, None]
        looked += int(checked.sum())
        squares = np.where(checked, _squares(points[some], book[near]), np.int64(1) << 62)
        least = np.minimum(squares.min(1), own[some])
        none = len(book)
        first = np.where(squares == least[:, None], near, none).min(1)
        code = np.minimum(first, np.where(own[some] == least, was.code[some], none))
        tight = np.where(checked, _scaled(squares), low[some])
        # the entry that was left takes the place of the one that won
        swapped = (near == code[:, None]) & checked
        near = np.where(swapped, was.code[some][:, None], near)
        tight = np.where(swapped, _scaled(own[some])[:, None], tight)
        order = np.argsort(tight, axis=1, kind="stable")
        now.code[some], best[some] = code, least
        now.near[some], now.low[some] = np.take_along_axis(near, order, 1), np.take_along_axis(tight, order, 1)
    anew = np.flatnonzero(doubt > b)
    if len(anew):
        looked += len(anew) * len(book)
        fresh, best[anew] = search(points[anew], book, b)
        now.code[anew], now.near[anew], now.low[anew], now.outer[anew] = fresh.code, fresh.near, fresh.low, fresh.outer
    return now, best, doubt, looked


def shortened(was: Bounds, b: int) -> Bounds:
    """The first ``b`` entries of each list; the outer bound then covers the rest as well."""
    if b >= was.near.shape[1]:
        return was
    return Bounds(was.code, was.near[:, :b], was.low[:, :b], np.minimum(was.outer, was.low[:, b:].min(1)))


STATE = "code binary, near binary, low binary, doubt binary, looked long"


def _assigning(books: np.ndarray, drift: np.ndarray | None, had: int, b: int):
    """State of every vector against ``books``: searched in full without ``drift``, else from the written lists of
    ``had`` entries, used at length ``b``."""
    parts, entries, width = books.shape
    size = max(1, CELLS // max(1, entries * width))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, len(batch), size):
                yield assigned(batch.slice(at, size))

    def assigned(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = vectors.matrix(batch.column("vector"), parts * width).reshape(-1, parts, width).astype(np.int64)
        n = len(points)
        if drift is not None:
            code = vectors.matrix(batch.column("code"), parts, "u1").astype(np.int64)
            near = vectors.matrix(batch.column("near"), parts * had, "u1").reshape(n, parts, had).astype(np.int64)
            low = vectors.matrix(batch.column("low"), parts * (had + 1), "<u2").reshape(n, parts, had + 1).astype(np.int64)
        codes, nears, lows = np.zeros((n, parts), "u1"), np.zeros((n, parts, b), "u1"), np.zeros((n, parts, b + 1), "<u2")
        doubts, errors, looked = np.full((n, parts), 255, "u1"), np.zeros(n, np.int64), 0
        for p in range(parts):
            if drift is None:
                now, squares = search(points[:, p], books[p], b)
                looked += n * entries
            else:
                was = shortened(Bounds(code[:, p], near[:, p], low[:, p, :had], low[:, p, had]), b)
                now, squares, doubt, more = update(points[:, p], books[p], drift[p], was)
                doubts[:, p] = np.minimum(doubt, 255)
                looked += more
            codes[:, p], nears[:, p], lows[:, p, :b], lows[:, p, b] = now.code, now.near, now.low, now.outer
            errors += squares
        kept = [batch.column(c) for c in ("vec_id", "label", "vector")]
        spread = np.full(n, looked // max(1, n), np.int64)
        spread[: looked % max(1, n)] += 1
        return pa.RecordBatch.from_arrays(
            [
                *kept,
                vectors.bytes_column(codes),
                vectors.bytes_column(nears.reshape(n, -1)),
                vectors.bytes_column(lows.reshape(n, -1)),
                vectors.bytes_column(doubts),
                pa.array(spread),
                pa.array(errors),
            ],
            names=["vec_id", "label", "vector", "code", "near", "low", "doubt", "looked", "error"],
        )

    return batches


def _summing(parts: int, entries: int, width: int):
    """A task's sums: at most a row for each entry and position, and one for each depth of doubt."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        depths = np.zeros(256, np.int64)
        for batch in rows:
            points = vectors.matrix(batch.column("vector"), parts * width).reshape(-1, parts, width).astype(np.int64)
            code = vectors.matrix(batch.column("code"), parts, "u1").astype(np.int64)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], points[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
            depths += np.bincount(vectors.matrix(batch.column("doubt"), parts, "u1").ravel(), minlength=256)
        part, entry = np.nonzero(counts)
        seen = np.flatnonzero(depths)
        many = len(part)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.repeat(part, width), np.full(len(seen), -1)]), pa.int32()),
                pa.array(np.concatenate([np.repeat(entry, width), seen]), pa.int32()),
                pa.array(np.concatenate([np.tile(np.arange(width), many), np.zeros(len(seen), int)]), pa.int32()),
                pa.array(np.concatenate([np.repeat(counts[part, entry], width), depths[seen]]), pa.int64()),
                pa.array(np.concatenate([sums[part, entry].ravel(), np.zeros(len(seen), int)]), pa.int64()),
            ],
            names=["part", "entry", "at", "n", "total"],
        )

    return batches


def adapted(b: int, least: int, depths: dict[int, int]) -> int:
    """List length for the next round: the least one that would have settled ``SETTLED`` of the parts that lists of
    ``b`` settled in this one, and never below ``least``."""
    settled = sum(n for d, n in depths.items() if d <= b)
    if not settled:
        return b
    reach = 0
    for d in range(b + 1):
        reach += depths.get(d, 0)
        if reach >= SETTLED * settled:
            return min(b, max(least, d))
    return b


def improve(table: DataFrame, books: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray, list[int]]:
    """``rounds`` of assigning all parts and moving entries to the floor of their parts' mean, then assigning again:
    the last codes with their errors and the exact distances that they took, the final codebooks, and the list length
    of each assignment."""
    parts, entries, width = books.shape
    b, least = min(entries - 1, max(1, entries // 4)), min(entries - 1, max(1, entries // 8))
    kind = table.schema
    schema = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, vector binary, {STATE}, error long"
    state, drift, had, lengths = table, None, 0, []
    for _ in range(rounds):
        lengths.append(b)
        state = common.keep_table(state.mapInArrow(_assigning(books, drift, had, b), schema), "vector_codes")
        had = b
        sums = (
            state.select("vector", "code", "doubt")
            .mapInArrow(_summing(parts, entries, width), "part int, entry int, at int, n long, total long")
            .groupBy("part", "entry", "at")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        )
        moved, depths = books.copy(), {}
        for r in sums.collect():  # one row per position of an entry and per depth
            if r["part"] < 0:
                depths[r["entry"]] = r["n"]
            else:
                moved[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        if drift is not None:
            b = adapted(b, least, depths)
        drift, books = drifts(books, moved), moved
    lengths.append(b)
    last = state.mapInArrow(_assigning(books, drift, had, b), schema).select("vec_id", "label", "code", "looked", "error")
    return common.keep_table(last, "vector_codes"), books, lengths


def codes(
    rows: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Dropped are rows whose vector is null or holds a null or a value that is not finite; components become
    ``floor(scale * x)``, and one that would make a distance exceed a long raises an error.  Codebooks start from the
    ``entries`` smallest ids, null ids last, equal ids by their numbers.  ``code`` has two hex digits per part,
    ``error`` is the squared distance to the coded entries, ``label_error`` its sum over rows of the same label, null
    labels together.  The first of those ids whose vector divides into ``parts`` sets the length; vectors of any
    other length cannot be coded and have a null code and error.  With fewer vectors than ``entries`` the codebooks
    are that much smaller; an empty table gives no rows.  Other columns play no part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    named = common.narrow(rows, vec_id=id_col, vector=vector_col, label=label_col).where(vectors.usable(F.col("vector")))
    fits = named.where(f"size(vector) > 0 AND size(vector) % {parts} = 0")
    id_kind, label_kind = (named.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    first = fits.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    empty = f"vec_id {id_kind}, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        uncoded = named.select("vec_id", *[F.lit(None).alias(c) for c in ("code", "error", "label_error", "codebooks_sha256")])
        return common.empty_like(rows.sparkSession, empty).unionByName(uncoded)
    dims = first[0]["n"]
    if parts * entries * (dims // parts) * 24 > vectors.MODEL_BYTES:
        raise ValueError(f"codebooks of {entries} entries of {dims} numbers do not fit into a task's model")
    table = vectors.whole(fits.where(F.size("vector") == dims), scale, dims, "code_vectors")
    start = table.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.array([np.frombuffer(bytes(r["vector"]), "<i4") for r in start], np.int64)
    books = np.ascontiguousarray(books.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    state, books, _ = improve(table, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error").unionByName(
        named.where(F.size("vector") != dims).select("vec_id", "label", F.lit(None).alias("code"), F.lit(None).cast("long").alias("error"))
    )
    labels = common.keep_table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(common.sized(labels, 24), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
