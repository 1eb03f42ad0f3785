"""Context-tree weighting over binary-decomposed bytes, frozen into one cost per context and byte."""

from __future__ import annotations

import math

import numpy as np

from labelwise.llm.bytetree import ContextTree

#: Nodes worked on at a time while the table is made.
SLICE = 1024
_SMALL = 1 << 16


def _log_factorials() -> np.ndarray:
    """log Gamma(n + 1/2) for small n."""
    return np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])


_HALVES = _log_factorials()


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2): from a table, beyond it by Stirling's series."""
    x = np.maximum(n, _SMALL) + 0.5
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return np.where(n < _SMALL, _HALVES[np.minimum(n, _SMALL - 1).astype(np.int64)], far)


def _lgamma_whole(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1) by Stirling's series with shift."""
    x = n + 8.0
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    for k in range(1, 8):
        far = far - np.log(n + k)
    return far


def bit_counts(counts: np.ndarray) -> np.ndarray:
    """``(nodes, 256)`` byte counts to ``(nodes, 256, 2)`` bit counts by bit-prefix 1..255 (0 unused)."""
    out = np.zeros((len(counts), 256, 2))
    sums = counts.astype(float)
    for bit in range(7, -1, -1):
        pairs = sums.reshape(len(counts), 1 << bit, 2)
        out[:, 1 << bit : 2 << bit] = pairs
        sums = pairs.sum(axis=2)
    return out


def log_block(bits: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a block with these counts of zeros and ones."""
    a, b = bits[..., 0], bits[..., 1]
    return _lgamma_half(a) + _lgamma_half(b) - math.log(math.pi) - _lgamma_whole(a + b)


def estimate(bits: np.ndarray) -> np.ndarray:
    """Probability that the next bit is one."""
    return (bits[..., 1] + 0.5) / (bits.sum(axis=-1) + 1.0)


def _byte_costs(ones: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """-log2 of the bytes' probabilities from the bits' probabilities by prefix."""
    log1, log0 = np.log2(ones), np.log2(1 - ones)
    cost = np.zeros((len(ones), len(columns)))
    for bit in range(8):
        prefix = (columns | 256) >> (8 - bit)
        one = (columns >> (7 - bit)) & 1
        cost -= np.where(one, log1[:, prefix], log0[:, prefix])
    return cost


class Counts:
    """Byte counts of nodes, held as sorted ``node * 256 + byte`` with their numbers."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], numbers[order]

    def __call__(self, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(self.keys, (lo * 256, hi * 256))
        out = np.zeros((hi - lo) * 256)
        out[self.keys[a:b] - lo * 256] = self.numbers[a:b]
        return out.reshape(-1, 256)


def _sum_children(children: np.ndarray, up: np.ndarray, parents: int) -> np.ndarray:
    """Rows of ``children`` added up by their ascending parent."""
    out = np.zeros((parents, 256))
    if len(up):
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
        out[up[first]] = np.add.reduceat(children, first, axis=0)
    return out


def cost_table(tree: ContextTree, counts: Counts) -> np.ndarray:
    """``table[node * size + code]``: bits that the byte costs after the node's context, all depths mixed.

    Children that were not kept stand together as one more child, the rest, whose counts are the node's
    less the kept children's; a text position whose longest kept context is an inner node is in that
    node's rest.  Weights are those after all training data: a node's own estimate against the product of
    its children's.
    """
    total, bounds = len(tree.parent), tree.bounds
    weights = np.ones((total, 256), np.float32)
    below = np.zeros((0, 256))
    for d in range(tree.depth, -1, -1):
        lo, hi = bounds[d], bounds[d + 1]
        mixed = np.zeros((hi - lo, 256))
        down = bounds[d + 1]
        up = tree.parent[down : down + len(below)] - lo
        for at in range(lo, hi, SLICE):
            to = min(hi, at + SLICE)
            own = counts(at, to)
            block = log_block(bit_counts(own))
            a, b = np.searchsorted(up, (at - lo, to - lo))
            if b > a:
                kids = up[a:b] - (at - lo)
                split = _sum_children(below[a:b], kids, to - at)
                used = _sum_children(counts(down + a, down + b), kids, to - at)
                split += log_block(bit_counts(own - used))
                top = np.maximum(block, split)
                both = top + np.log(0.5 * np.exp(block - top) + 0.5 * np.exp(split - top))
                mine = np.unique(kids)
                weights[at + mine] = (1 / (1 + np.exp(np.clip(split - block, -60, 60))))[mine]
                block[mine] = both[mine]
            mixed[at - lo : to - lo] = block
        below = mixed
    columns = np.zeros(tree.size, np.int64)
    columns[tree.codes[::-1]] = np.arange(255, -1, -1)
    unseen = np.flatnonzero(tree.codes == 0)
    table = np.zeros((total, tree.size), np.float32)
    sums, left = np.zeros((1, 256), np.float32), np.ones((1, 256), np.float32)
    for d in range(tree.depth + 1):
        lo, hi, down = bounds[d], bounds[d + 1], bounds[d + 1]
        next_sums, next_left = np.zeros((hi - lo, 256), np.float32), np.zeros((hi - lo, 256), np.float32)
        deeper = tree.parent[down : bounds[d + 2]] - lo if d < tree.depth else np.zeros(0, np.int32)
        for at in range(lo, hi, SLICE):
            to = min(hi, at + SLICE)
            own = counts(at, to)
            above = tree.parent[at:to] - bounds[d - 1] if d else np.zeros(to - at, int)
            share = left[above] * weights[at:to]
            ours = sums[above] + share * estimate(bit_counts(own))
            rest = left[above] - share
            next_sums[at - lo : to - lo], next_left[at - lo : to - lo] = ours, rest
            a, b = np.searchsorted(deeper, (at - lo, to - lo))
            kids = deeper[a:b] - (at - lo)
            used = _sum_children(counts(down + a, down + b), kids, to - at)
            # a leaf has given all its weight to its own estimate, so nothing is left for a rest
            final = np.clip(ours + rest * estimate(bit_counts(own - used)), 1e-9, 1 - 1e-9)
            costs = _byte_costs(final, columns)
            if len(unseen):
                costs[:, 0] = _byte_costs(final, unseen).mean(axis=1)
            table[at:to] = costs
        sums, left = next_sums, next_left
    return table.reshape(-1)
