"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with up to ``budget`` edits.  Cut into ``budget + 1`` pieces, at least one
piece is then there unchanged; an automaton finds all pieces in one pass over a text, and Myers' bit-parallel
distance decides each place where one was hit.  Short items that may have no edit count as whole words only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common

#: Edits allowed per character of an item, and the characters below which an item without edits must be whole words.
ERROR_RATE = 0.05
SHORT = 32
#: Characters of items that one automaton holds; a larger benchmark is searched block by block.
BLOCK_CHARS = 4 << 20
TEXTS = 256
NOT_WORD = re.compile(r"[\W_]+")
#: Characters of scripts that set no spaces between words: Thai, Lao, Burmese, Khmer, kana, Chinese.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    """Lower case, every run of characters that are neither letters nor digits as one space, none at the ends."""
    return NOT_WORD.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of even length with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one item; its length is not limited."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << k
        self.full = (1 << self.size) - 1
        self.last = 1 << (self.size - 1)

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to any stretch of ``text``, and where the first such stretch ends."""
        plus, minus, score = self.full, 0, self.size
        best, at = score, 0
        for k, c in enumerate(text):
            eq = self.masks.get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (self.full & ~(across | plus))
            down = plus & across
            if up & self.last:
                score += 1
            elif down & self.last:
                score -= 1
            up, down = up << 1, down << 1  # a match may start anywhere, so nothing enters at the top
            plus = (down | ~(eq | minus | up)) & self.full
            minus = up & (eq | minus) & self.full
            if score < best:
                best, at = score, k + 1
        return best, at


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word of the normal ``text`` goes on beyond ``start`` or ``end``; unspaced scripts may be cut anywhere."""
    return all(
        " " in (sides := text[max(0, at - 1) : at + 1]) or len(sides) < 2 or UNSPACED.search(sides) for at in (start, end)
    )


def find(text: str, automaton: ahocorasick.Automaton, items: Sequence[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """``(item, distance, end)`` of the best occurrence of each item within its budget in a normal text."""
    areas: dict[int, list[list[int]]] = {}
    exact: dict[int, int] = {}
    for end, places in automaton.iter(text):
        for k, offset, size in places:
            _, item, errors = items[k]
            if not errors and size < SHORT:
                if k not in exact and whole_words(text, end + 1 - size, end + 1):
                    exact[k] = end + 1
                continue
            start = end + 1 - size - offset
            lo, hi = start - errors, start + len(item) + errors
            held = areas.setdefault(k, [])
            if held and lo <= held[-1][1] and hi >= held[-1][0]:  # hits come by their ends, so areas grow almost in order
                held[-1] = [min(lo, held[-1][0]), max(hi, held[-1][1])]
            else:
                held.append([lo, hi])
    found = [(k, 0, end) for k, end in exact.items()]
    for k, held in areas.items():
        _, item, errors = items[k]
        pattern = None
        best = (errors + 1, 0)
        for lo, hi in held:
            window = text[max(0, lo) : hi]
            at = window.find(item)
            if at >= 0:
                score, end = 0, at + len(item)
            else:
                pattern = pattern or Pattern(item)
                score, end = pattern.best(window)
            best = min(best, (score, max(0, lo) + end))
        if best[0] <= errors:
            found.append((k, *best))
    return found


def _searching(items: Sequence[tuple[int, str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build() -> ahocorasick.Automaton:
        by_piece: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, item, errors) in enumerate(items):
            for offset, piece in pieces(item, errors):
                by_piece.setdefault(piece, []).append((k, offset, len(piece)))
        automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            automaton.add_word(piece, places)
        automaton.make_automaton()
        return automaton

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        automaton = build()
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, TEXTS):
                for row, text in enumerate(batch.column(1)[at : at + TEXTS].to_pylist(), at):
                    out += [(row, items[k][0], distance, items[k][2], end) for k, distance, end in find(normal(text), automaton, items)]
            rows, *columns = zip(*out) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names=["doc_id", "item_id", "distance", "budget", "end"]
            )

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float) -> Iterator[list[tuple[int, str, int]]]:
    """The benchmark's items in normal form with their budgets, in blocks of bounded size.

    Rows come to the driver one partition at a time and leave with their block.
    """
    rows = common.narrow(benchmark, item=item_col, text=text_col).where("item IS NOT NULL AND text IS NOT NULL")
    block, held = [], 0
    for row in rows.toLocalIterator():
        item = normal(row["text"])
        if item:
            block.append((int(row["item"]), item, budget(len(item), rate)))
            held += len(item)
            if held >= BLOCK_CHARS:
                yield block
                block, held = [], 0
    if block:
        yield block


def _emptying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        empty = [not normal(t) for t in batch.column(1).to_pylist()]
        yield batch.filter(pa.array([e or i is None for e, i in zip(empty, batch.column(0).to_pylist())], pa.bool_()))


def left_out(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, text)``: the items that are not searched, those empty in normal form or with a null id."""
    rows = common.narrow(benchmark, item_id=item_col, text=text_col).select("item_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_emptying, rows.schema)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
) -> DataFrame:
    """``(doc_id, item_id, distance, budget, end)``: every item found in every document, at its best place.

    Both sides are compared in normal form (``normal``), whole; ``end`` is a place in that form.  An item may
    have ``rate`` edits for each of its characters; if that is less than one edit, an item of fewer than ``SHORT``
    characters must be there as whole words.  Items in ``left_out`` are not searched.  Documents with a null id are searched and reported under null; a null
    or empty text holds nothing.  Repeated items and rows are each reported.  No items: no rows.
    """
    rows = common.narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id long, distance int, budget int, end int"
    found = None
    for block in item_blocks(benchmark, item_col, item_text_col, rate):
        part = rows.mapInArrow(_searching(block), schema)
        found = part if found is None else found.unionAll(part)
    return common.empty_like(docs.sparkSession, schema) if found is None else found


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows with a null id stay."""
    found = matches(docs, benchmark, id_col, text_col, **options)
    held = common.keep_table(found.where("doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated")
    return common.without(docs, id_col, held)
