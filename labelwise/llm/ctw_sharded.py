"""Context-tree weighting with every context: the tree stays a sharded table, whatever its size.

A window (``bytetree``) is a context of full depth and its byte, and windows sort as the tree does.  Texts are dealt into
chunks; a chunk asks once for each distinct window it holds.  All asks for one branch of the tree meet in one part, where
the branch is weighted from the leaves up and each window is given its cost once; costs then go back to the chunks.
The levels above the branches are at most 65,793 contexts of up to two bytes, which the driver weighs.

A cell is a context and a bit prefix of the next byte, ``context << 8 | prefix``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.llm import bytetree, common, ctw_model

#: Depth of the branches' roots.
BRANCH = 3
#: Bytes of text of a chunk and of a part, about; parts that windows are dealt to; bytes of text whose asks meet at a time.
CHUNK_BYTES = 2 << 20
MOST_PARTS = 512
MEETING_BYTES = 1 << 30
ASKS = "chunk long, part int, sub int, keys binary, n binary"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits by significance of their bytes, without the bytes that are 0 in all of them."""
    bits = values.view(np.uint64)
    width = (int(bits.max(initial=0)).bit_length() + 7) // 8 or 1
    return bytes([width]) + bits.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.int64).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.int64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def first_of(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


@dataclass
class Shape:
    """Depth of the tree and of its branches' roots, and the numbers of chunks, parts and subdivisions of a part's asks."""

    depth: int
    chunks: int
    parts: int
    subs: int

    @classmethod
    def of(cls, depth: int, size: int) -> Shape:
        parts = min(MOST_PARTS, max(16, size // CHUNK_BYTES))
        return cls(depth, size // CHUNK_BYTES + 1, parts, size // MEETING_BYTES + 1)

    @property
    def branch(self) -> int:
        return min(BRANCH, self.depth)

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        root = keys >> (8 * (self.depth - self.branch + 1))
        return (root * 40503 >> 4) % self.parts


@dataclass
class Level:
    """Cells of one depth in order, their weights, and their estimates that the next bit is one."""

    cells: np.ndarray
    weight: np.ndarray
    one: np.ndarray


def _cells(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of sorted windows with their zeros and ones."""
    cells, bits = [], []
    for j in range(8):
        group = keys >> (8 - j)
        first = first_of(group)
        total = np.add.reduceat(n, first)
        ones = np.add.reduceat(n * (keys >> (7 - j) & 1), first)
        group = group[first]
        cells.append((group >> j) << 8 | 1 << j | group & ((1 << j) - 1))
        bits.append(np.stack([total - ones, ones], axis=1))
    cells = np.concatenate(cells)
    order = np.argsort(cells)
    return cells[order], np.concatenate(bits)[order].astype(float)


def _up(cells: np.ndarray) -> np.ndarray:
    return (cells >> 16) << 8 | cells & 255


def _weighed(cells: np.ndarray, bits: np.ndarray, split: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """A level and the log probabilities of its cells; ``split``: those of their children together, None for leaves."""
    block = ctw_model.log_block(bits)
    if split is None:
        return Level(cells, np.ones(len(cells)), ctw_model.estimate(bits)), block
    weight = 1 / (1 + np.exp(np.clip(split - block, -60, 60)))
    return Level(cells, weight, ctw_model.estimate(bits)), np.logaddexp(block, split) - np.log(2)


def branches(keys: np.ndarray, n: np.ndarray, shape: Shape) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels of a part's branches, roots first, from its sorted windows; bits and log probabilities of the roots' cells."""
    levels, log_p = [], np.zeros(0)
    for d in range(shape.depth, shape.branch - 1, -1):
        context = keys >> (8 * (shape.depth - d + 1))
        cells, bits = _cells(*bytetree.merged(context << 8 | keys & 255, n))
        split = None
        if levels:
            split = np.bincount(np.searchsorted(cells, _up(levels[0].cells)), log_p, len(cells))
        level, log_p = _weighed(cells, bits, split)
        levels.insert(0, level)
    return levels, bits, log_p


def window_costs(keys: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """Bits that each of the sorted windows costs.  A cell that was never seen halves what is left of its bit."""
    cost = np.zeros(len(keys))
    for j in range(8):
        group = keys >> (8 - j)
        first = first_of(group)
        group = group[first]
        context, prefix = group >> j, 1 << j | group & ((1 << j) - 1)
        one, left = np.zeros(len(group)), np.ones(len(group))
        alive = np.arange(len(group))
        for d, level in enumerate(levels):
            if not len(level.cells):
                break
            cell = (context[alive] >> (8 * (depth - d))) << 8 | prefix[alive]
            at = np.minimum(np.searchsorted(level.cells, cell), len(level.cells) - 1)
            good = level.cells[at] == cell
            alive, at = alive[good], at[good]
            share = left[alive] * level.weight[at]
            one[alive] += share * level.one[at]
            left[alive] -= share
        one = np.clip(one + left / 2, 1e-9, 1 - 1e-9)
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
        cost -= np.where(keys >> (7 - j) & 1, np.log2(one)[number], np.log2(1 - one)[number])
    return cost


def windows_of(texts: list[bytes], depth: int) -> np.ndarray:
    """The window at each byte of the texts."""
    out, at = np.empty(sum(map(len, texts)), np.int64), 0
    for group in bytetree.blocks(texts):
        keys = bytetree.window_keys(group, depth)
        out[at : at + len(keys)] = keys
        at += len(keys)
    return out


def asks(texts: list[bytes], taught: np.ndarray, number: int, shape: Shape) -> Iterator[tuple]:
    """Rows of ``ASKS`` of a chunk: its windows by part, and how often training texts hold them."""
    keys = windows_of(texts, shape.depth)
    if not len(keys):
        return
    keys <<= 1
    keys |= np.repeat(taught, [len(t) for t in texts])
    keys.sort()
    known = (keys & 1).astype(np.int32)
    keys >>= 1
    first = first_of(keys)
    n = np.add.reduceat(known, first, dtype=np.int64)
    keys = keys[first]
    part = shape.part_of(keys)
    by_part = np.argsort(part, kind="stable")
    starts = first_of(part[by_part])
    for at, to in zip(starts, [*starts[1:], len(keys)]):
        mine = by_part[at:to]
        yield number, int(part[mine[0]]), number % shape.subs, packed_keys(keys[mine]), packed(n[mine])


def text_costs(texts: list[bytes], answers: pa.Table, shape: Shape) -> np.ndarray:
    """Bits that each text of a chunk costs, from the answers to its asks."""
    keys = windows_of(texts, shape.depth)
    if not len(keys):
        return np.zeros(len(texts))
    order = np.argsort(keys)
    keys = keys[order]
    first = first_of(keys)
    got = sorted(zip(answers.column("part").to_pylist(), answers.column("costs").to_pylist()))
    cost = np.zeros(len(first), np.float32)
    cost[np.argsort(shape.part_of(keys[first]), kind="stable")] = np.concatenate([np.frombuffer(c, np.float32) for _, c in got])
    placed = np.zeros(len(order))
    placed[order] = np.repeat(cost, np.diff(np.r_[first, len(order)]))
    return np.add.reduceat(placed, np.cumsum([0, *map(len, texts[:-1])]))


def _merging(group: pa.Table) -> pa.Table:
    """The asks of a part as one row."""
    keys = np.concatenate([unpacked_keys(b.as_py()) for b in group.column("keys")])
    n = np.concatenate([unpacked(b.as_py()) for b in group.column("n")])
    keys, n = bytetree.merged(keys, n)
    part = pa.array([group.column("part")[0].as_py()], pa.int32())
    return pa.table({"part": part, "keys": pa.array([packed_keys(keys)], pa.binary()), "n": pa.array([packed(n)], pa.binary())})


def _known(keys: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a part, and those that training texts hold with their numbers."""
    keys, n = unpacked_keys(keys), unpacked(n)
    return keys, keys[n > 0], n[n > 0]


def _rooting(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells above the branches' roots, with their bits and the log probabilities below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, keys, n = _known(data, n)
                if not len(keys):
                    continue
                levels, bits, log_p = branches(keys, n, shape)
                columns = (_up(levels[0].cells), bits[:, 0], bits[:, 1], log_p)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "zeros", "ones", "log_p"])

    return run


def top_levels(windows: DataFrame, shape: Shape) -> list[Level]:
    """The levels above the branches, a bounded number of contexts."""
    levels: list[Level] = []
    if not shape.branch:
        return levels
    roots = windows.select("keys", "n").mapInArrow(_rooting(shape), "cell long, zeros double, ones double, log_p double")
    rows = roots.groupBy("cell").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_p").alias("split"))
    top = common.keep_table(rows, "top_cells").toArrow().to_pandas().sort_values("cell")
    cells, bits, split = top["cell"].to_numpy(np.int64), top[["zeros", "ones"]].to_numpy(float), top["split"].to_numpy(float)
    for _ in range(shape.branch):
        level, log_p = _weighed(cells, bits, split)
        levels.insert(0, level)
        cells, number = np.unique(_up(cells), return_inverse=True)
        bits = np.stack([np.bincount(number, b, len(cells)) for b in bits.T], axis=1)
        split = np.bincount(number, log_p, len(cells))
    return levels


def _costing(shape: Shape, top) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys, known, n = _known(data, n)
                levels = top.value + (branches(known, n, shape)[0] if len(known) else [])
                costs = window_costs(keys, levels, shape.depth).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([data], pa.binary()), pa.array([costs.tobytes()], pa.binary())],
                    names=["part", "keys", "costs"],
                )

    return run


def _answering(asked: pa.Table, costs: pa.Table) -> pa.Table:
    keys = unpacked_keys(costs.column("keys")[0].as_py()) if asked.num_rows else np.zeros(0, np.int64)
    values = np.frombuffer(costs.column("costs")[0].as_py(), np.float32) if asked.num_rows else None
    out = [values[np.searchsorted(keys, unpacked_keys(b))].tobytes() for b in (x.as_py() for x in asked.column("keys"))]
    return asked.select(["chunk", "part"]).append_column("costs", pa.array(out, pa.binary()))


def answers(asked: DataFrame, shape: Shape) -> DataFrame:
    """``(chunk, part, costs)`` for the written asks: the costs of their windows, in their order."""
    merged = asked.groupBy("part", "sub").applyInArrow(_merging, "part int, keys binary, n binary")
    if shape.subs > 1:
        merged = merged.groupBy("part").applyInArrow(_merging, "part int, keys binary, n binary")
    windows = common.keep_table(merged, "windows", compression="zstd")
    top = asked.sparkSession.sparkContext.broadcast(top_levels(windows, shape))
    costs = common.keep_table(
        windows.select("part", "keys", "n").mapInArrow(_costing(shape, top), "part int, keys binary, costs binary"), "costs", compression="zstd"
    )
    dealt = costs.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(shape.subs - 1))))
    met = asked.groupBy("part", "sub").cogroup(dealt.groupBy("part", "sub"))
    return met.applyInArrow(_answering, "chunk long, part int, costs binary")


def chunk(shape: Shape, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(shape.chunks)).alias("chunk")
