"""Byte contexts as arrays: counting windows of bytes, trees of the commonest contexts, and sums of costs along texts.

A window is ``depth`` bytes of context, read backwards, and then the byte that follows them, packed into one
integer, so that contexts sort as a tree does; before a text's start the context is padded with zero bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common

#: Bytes of text that are worked on at a time, and windows that a task holds before it sends them on.
BLOCK = 128 << 10
HELD = 2_000_000


def blocks(texts: Sequence[bytes]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Groups of ``(index, earlier, part)`` of about ``BLOCK`` bytes; a longer text comes in parts that know
    the bytes before them."""
    group, held = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), BLOCK):
            part = text[at : at + BLOCK]
            group.append((k, text[max(0, at - 8) : at], part))
            held += len(part)
            if held >= BLOCK:
                yield group
                group, held = [], 0
    if group:
        yield group


def laid_out(group: list[tuple[int, bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one array, each after ``depth`` bytes of context, and the places of their own bytes."""
    pieces = []
    for _, earlier, part in group:
        pieces += [earlier[-depth:].rjust(depth, b"\0") if depth else b"", part]
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    starts = np.cumsum(sizes + depth) - sizes
    own = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat, own


def window_keys(group: list[tuple[int, bytes, bytes]], depth: int) -> np.ndarray:
    """The window at each byte of the parts."""
    flat, own = laid_out(group, depth)
    key = np.zeros(len(own), np.int64)
    for back in (*range(1, depth + 1), 0):
        key = (key << 8) | flat[own - back]
    return key


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class WindowCounts:
    """Counts of the windows of a task's texts; ``take`` hands them over and starts afresh."""

    def __init__(self, depth: int) -> None:
        self.depth, self.keys, self.counts = depth, [], []

    def add(self, texts: Sequence[bytes]) -> None:
        for group in blocks(texts):
            found, n = np.unique(window_keys(group, self.depth), return_counts=True)
            self.keys.append(found)
            self.counts.append(n)
        if sum(map(len, self.keys)) > 2 * HELD:
            keys, counts = merged(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts = [keys], [counts]

    def full(self) -> bool:
        return sum(map(len, self.keys)) > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = merged(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts = [], []
        return out


def context_rows(windows: DataFrame, depth: int, *extra: str) -> DataFrame:
    """From ``windows (key, n, *extra)`` the written table ``(depth, context, byte, *extra, n)`` of contexts of 0 to ``depth`` bytes."""
    cut = windows.select(
        F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "key", F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("byte"), *extra, "n"
    )
    context = F.expr(f"shiftright(key, 8 * ({depth} - depth + 1))").alias("context")
    return common.keep_table(cut.groupBy("depth", context, "byte", *extra).agg(F.sum("n").alias("n")), "contexts")


def common_contexts(rows: DataFrame, depth: int, limit: int, least: int = 1) -> list[pd.DataFrame]:
    """Per depth the rows of the commonest contexts, at most ``limit`` of all depths together, seen ``least`` times or more.

    This bounds the tree, and what comes to the driver, whatever the corpus.  A context's shorter forms are
    at least as common, so the kept ones form a tree; the bound on the count is a step of an eighth of a
    doubling, so ties fall together.
    """
    totals = common.keep_table(rows.groupBy("depth", "context").agg(F.sum("n").alias("total")), "context_totals")
    step = F.floor(F.log2("total") * 8)
    kept, bound = 0, math.inf
    for row in sorted(totals.groupBy(step.alias("step")).count().collect(), reverse=True):
        kept += row["count"]
        if kept > limit:
            break
        bound = row["step"]
    wanted = totals.where((step >= bound) & (F.col("total") >= least)).select("depth", "context")
    found = rows.join(wanted, ["depth", "context"]).toArrow().to_pandas()
    return [part.drop(columns="depth") for part in (found[found["depth"] == d] for d in range(depth + 1))]


@dataclass
class ContextTree:
    """Kept contexts as nodes, shortest first; node 0 is the empty context.

    ``codes`` maps bytes to a small alphabet (0: any byte never seen), ``step[node * size + code]`` is the
    child one byte further back, or -1.
    """

    depth: int
    codes: np.ndarray
    step: np.ndarray
    size: int
    parent: np.ndarray
    bounds: list[int]

    def end_nodes(self, flat: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each own byte, the node of the longest kept context before it."""
        coded = self.codes[flat]
        node = np.zeros(len(own), np.int32)
        alive = np.arange(len(own))
        here = node
        for back in range(1, self.depth + 1):
            found = self.step[here * self.size + coded[own[alive] - back]]
            good = found >= 0
            if not good.all():
                alive, found = alive[good], found[good]
            here = found
            node[alive] = here
        return node


def build_tree(contexts: Sequence[np.ndarray], bytes_seen: np.ndarray) -> ContextTree:
    """``contexts[d]``: sorted kept contexts of ``d`` bytes; the node of ``contexts[d][i]`` is ``bounds[d] + i``,
    and the children of a node are neighbours."""
    codes = np.zeros(256, np.int32)
    codes[bytes_seen] = np.arange(1, len(bytes_seen) + 1)
    if codes[0] == 0:  # the pad before a text's start
        codes[0] = len(bytes_seen) + 1
    size = int(codes.max()) + 1
    bounds = np.cumsum([0, *map(len, contexts)]).tolist()
    step = np.full(bounds[-1] * size, -1, np.int32)
    parent = np.zeros(bounds[-1], np.int32)
    for d in range(1, len(contexts)):
        nodes = np.arange(bounds[d], bounds[d + 1])
        up = bounds[d - 1] + np.searchsorted(contexts[d - 1], contexts[d] >> 8)
        step[up * size + codes[contexts[d] & 255]] = nodes
        parent[nodes] = up
    return ContextTree(len(contexts) - 1, codes, step, size, parent, bounds)


def text_costs(tree: ContextTree, table: np.ndarray, texts: Sequence[bytes]) -> np.ndarray:
    """Sums over each text's bytes of ``table[node * size + code]``, one row a text; the table may have several columns."""
    out = np.zeros((len(texts), *table.shape[1:]))
    for group in blocks(texts):
        flat, own = laid_out(group, tree.depth)
        if not len(own):
            continue
        cost = table[tree.end_nodes(flat, own) * tree.size + tree.codes[flat[own]]]
        sizes = np.array([len(p) for _, _, p in group])
        some = np.flatnonzero(sizes)
        sums = np.add.reduceat(cost, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=float)
        np.add.at(out, np.array([k for k, _, _ in group])[some], sums)
    return out
