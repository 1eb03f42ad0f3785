"""SimHash near duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into three segments of at most 23 bits.  The binary Golay code gives every
23-bit word one codeword within three bits, and two words at most two bits apart always have a word between
them, one bit from each at most, that decodes alike for both.  Of three segments that share four errors
or fewer, some two hold two or fewer between them; so the keys of a fingerprint are, for each two segments,
the codeword indices of the segments themselves and of all single-bit changes in one of the two (about 33
keys), and fingerprints within four bits share a key.  Rows that share a key are compared exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm import common

SEED = 42
WITHIN = 4
#: Bits of the three segments, from the lowest.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Rows of one key that meet in a task; the members of a commoner key meet tile by tile.
TILE = 1024
#: Rows that a task compares at a time, and pairs it holds before it joins them up.
CHUNK = 1 << 16
#: Runs beyond this length are joined up one by one, shorter ones together.
LONG_RUN = 64
#: Shared shingles that are multiplied at a time.
COLUMNS = 2048
PAIRS = 1 << 18
TEXTS = 256
HASHES = 1 << 16
#: Most that a repeated word weighs in a fingerprint of words.
WORD_WEIGHT = 4
#: Classes whose shingles are counted to tell common ones, and how many of the commonest are told; only the order of
#: shingles and the tiles of common ones depend on them, no result does.
COUNTED = 20_000
COMMON_SHINGLES = 100_000
#: Times a shingle must be counted to be a common one.
OFTEN = 4


def fingerprint(text: str | None, size: int) -> int:
    """64-bit SimHash of the shingles of ``size`` words (A-Z lower-cased, repeats included; fewer words: all of them).

    A bit is one if more than half of the shingles' XXH64 have it; no words: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    count = max(1, len(words) - size + 1)
    first, last = starts[:count].tolist(), (ends[len(words) - count :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, HASHES):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + HASHES], last[at : at + HASHES])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprinting(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        for batch in batches:
            texts = batch.column(1)
            prints = []
            for at in range(0, len(texts), TEXTS):
                prints += [fingerprint(t, size) for t in texts[at : at + TEXTS].to_pylist()]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, print)`` for every row."""
    rows = common.narrow(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprinting(size), f"id {dict(rows.dtypes)['id']}, print long")


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Vectorised nearest-codeword decoding to a 12-bit index."""

    def __init__(self) -> None:
        self.high = np.array([_remainder(k << 12) for k in range(1 << 11)], np.int32)
        self.low = np.array([_remainder(k) for k in range(1 << 12)], np.int32)
        self.error = np.zeros(1 << 11, np.int32)
        singles = [1 << a for a in range(23)]
        for a, x in enumerate(singles):
            self.error[_remainder(x)] = x
            for b in range(a):
                self.error[_remainder(x | singles[b])] = x | singles[b]
                for c in range(b):
                    self.error[_remainder(x | singles[b] | singles[c])] = x | singles[b] | singles[c]

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.high[words >> 12] ^ self.low[words & 4095]]) >> 11


_golay: list[Golay] = []


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, key)``: every key of every fingerprint, each once."""
    if not _golay:
        _golay.append(Golay())
    code, around, valid = _golay[0], [], []
    bits = prints.view(np.uint64)
    for start, width in SEGMENTS:
        word = ((bits >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int32)
        near = np.stack([code.index(word), *(code.index(word ^ (1 << b)) for b in range(width))], axis=1)
        rest = np.sort(near[:, 1:], axis=1)
        fresh = rest != near[:, :1]
        fresh[:, 1:] &= rest[:, 1:] != rest[:, :-1]
        around.append(np.concatenate([near[:, :1], rest], axis=1))
        valid.append(np.concatenate([np.ones((len(bits), 1), bool), fresh], axis=1))
    places, keys = [], []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for own, fresh, other, shift in ((around[i], valid[i], around[j], 12), (around[j], valid[j], around[i], 0)):
            use = fresh.copy()
            if shift == 0:
                use[:, 0] = False  # the pair of unchanged segments is there already
            place, column = np.nonzero(use)
            places.append(place)
            keys.append((number << 24) | (own[place, column] << shift) | (other[place, 0] << (12 - shift)))
    return np.concatenate(places), np.concatenate(keys)


def _keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.released()
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 4096):
            some = prints[at : at + 4096]
            place, key = fuzzy_keys(some)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(some[place])], names=["key", "print"])


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(a, b)`` as ``(member, least member reached)``, the least ones left out."""
    members, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(members))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def _spread_from(bits: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long run as ``(member, first member reached)``: each member looks only at those not reached yet,
    so a dense run costs little more than its length."""
    left = np.unique(bits)
    members, firsts = [], []
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= within
            if near.any():
                reached, left = left[near], left[~near]
                queue += list(reached)
                members.append(reached)
                firsts.append(np.full(len(reached), first))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *members]), np.concatenate([none, *firsts])


def _comparing(within: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links among rows sorted by (key, tile), joined up; a run of equal keys is never cut."""

    def links(key: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(key)])
        for at in np.flatnonzero(sizes > LONG_RUN):
            a, b = _spread_from(bits[starts[at] : starts[at] + sizes[at]], within)
            left.append(a)
            right.append(b)
        short = np.repeat(sizes <= LONG_RUN, sizes)
        key, bits = key[short], bits[short]
        here, lag = np.arange(len(key) - 1), 1
        while len(here):
            here = here[: np.searchsorted(here, len(key) - lag)]
            here = here[key[here] == key[here + lag]]
            near = here[np.bitwise_count(bits[here] ^ bits[here + lag]) <= within]
            left.append(bits[near])
            right.append(bits[near + lag])
            lag += 1
            if sum(map(len, left)) > PAIRS or not len(here):
                a, b = joined_up(np.concatenate(left), np.concatenate(right))
                left, right = [a], [b]
        if left:
            left, right = [np.concatenate(left)], [np.concatenate(right)]
        if left and len(left[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(left[0].view(np.int64)), pa.array(right[0].view(np.int64))], names=["a", "b"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        key, bits = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            tile = (batch.column(0).to_numpy().astype(np.int64) << 32) | batch.column(1).to_numpy()
            key = np.concatenate([key, tile])
            bits = np.concatenate([bits, batch.column(2).to_numpy().view(np.uint64)])
            if len(key) > CHUNK:
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield from links(key[:whole], bits[:whole])
                    key, bits = key[whole:], bits[whole:]
        yield from links(key, bits)

    return run


def linked(prints: DataFrame, within: int = WITHIN) -> DataFrame:
    """``(a, b)``: links that join all distinct fingerprints (column ``print``) within ``within`` bits (4 at most).

    A key with up to ``TILE`` members meets in one task; a commoner one is dealt into blocks of members, and
    each two blocks meet in a task of their own.  Tasks send a forest over what they joined, not all pairs.
    """
    keys = common.keep_table(prints.select("print").mapInArrow(_keying, "key int, print long"), "fuzzy_keys")
    crowded = common.keep_table(keys.groupBy("key").count().where(F.col("count") > TILE), "crowded_keys").toDF("crowd", "members")
    blocks = F.coalesce(F.expr(f"(members + {TILE // 2 - 1}) div {TILE // 2}"), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = (
        keys.join(crowded, F.col("key") == F.col("crowd"), "left")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE sequence(0, blocks - 1) END")))
        .withColumn("tile", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        .select("key", "tile", "print")
    )
    together = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return together.mapInArrow(_comparing(within), "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, within: int = WITHIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Texts link when their fingerprints differ in ``within`` bits or fewer; texts without words have
    fingerprint zero and link like any other.  Rows with a null id have a fingerprint and take part, but give
    no component its id; a component of null ids alone has null.  Copies share one fingerprint row, so a
    text repeated in a third of the corpus is compared once.
    """
    rows = common.keep_table(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = common.keep_table(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct_prints")
    roots = common.components(linked(distinct, within), "prints")
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.keep_table(rooted.join(first, "root").select("print", "component_id"), "print_components")
    return rows.join(named, "print").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of the same things."""
    x = (hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_prints(words: Sequence[bytes], seeds: Sequence[int]) -> list[int]:
    """SimHashes of single words, each weighted by its number up to ``WORD_WEIGHT``; no words: zero."""
    if not words:
        return [0] * len(seeds)
    counted = Counter(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in counted), np.uint64, len(counted))
    weights = np.minimum(np.fromiter(counted.values(), np.int64, len(counted)), WORD_WEIGHT)
    order = np.argsort(-weights, kind="stable")
    hashes, weights = hashes[order], weights[order]
    heavier = [int((weights >= k).sum()) for k in range(1, WORD_WEIGHT + 1)]
    out = []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), HASHES):
            part = _mixed(hashes[at : at + HASHES], seed)
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for n in heavier:
                if n > at:
                    ones += np.add.reduce(bits[: n - at], axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > int(weights.sum()), bitorder="little").view("<u8")[0]))
    return out


def _signing(seeds: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                same, prints = [], []
                for text in batch.column(1)[at : at + TEXTS].to_pylist():
                    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                    same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    prints.append(word_prints(words, seeds))
                signed = np.array(prints, np.uint64).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(signed[:, k])) for k in range(len(seeds))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + TEXTS], pa.array(same, pa.binary()), *columns],
                    names=["id", "same", *(f"print{k}" for k in range(len(seeds)))],
                )

    return run


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; fewer words make one shingle, none none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    count = max(1, len(words) - size + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + size])) for k in range(count)], np.uint64).view(np.int64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common_ = int((a[at] == b).sum())
    return common_ / (len(a) + len(b) - common_)


def similarities(sets: Sequence[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each two sets, from products of their incidence over the members that sets share."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[member]
    owner, column = owner[use], number[member[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _shingling(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                sets = [shingle_set(t, size) for t in batch.column(1)[at : at + TEXTS].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + TEXTS], pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
                )

    return run


def _prefixing(
    size: int, least: float, common_keys: np.ndarray, counts: np.ndarray
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first shingles of each text in one order of all shingles, common ones last: two sets of similarity ``least``
    or more have one of them in common.  Members of a shingle expected more than ``TILE`` times are dealt to tiles.
    A key is 40 bits of shingle and tile, ``at`` the size of the set and the place of the shingle in it."""

    def prefix(node: int, text: str | None) -> list[np.ndarray]:
        shingles = shingle_set(text, size)
        at = np.minimum(np.searchsorted(common_keys, shingles), max(len(common_keys) - 1, 0))
        expected = np.where(common_keys[at] == shingles, counts[at], 0) if len(common_keys) else np.zeros(len(shingles), np.int64)
        first = max(0, len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1) if len(shingles) else 0
        order = np.lexsort((shingles, expected))[:first]
        key, place = shingles[order], np.arange(len(order))
        blocks = np.where(expected[order] > TILE, -(-expected[order] // (TILE // 2)), 1)
        again = np.repeat(np.arange(len(order)), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        blocks = blocks[again]
        own = xxhash.xxh64_intdigest(int(node).to_bytes(8, "little", signed=True), SEED) % (1 << 31) % blocks
        tile = np.minimum(own, other) * blocks + np.maximum(own, other)
        keys = np.where(tile > 0, _mixed(key[again].view(np.uint64) + tile.astype(np.uint64), 1), key[again].view(np.uint64))
        return [keys >> np.uint64(24), np.full(len(again), node), len(shingles) << 32 | place[again]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [prefix(n, t) for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                columns = [np.concatenate(c).astype("i8") for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "at"])

    return run


def _prefix_linking(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links among rows sorted by key of sets that may be of similarity ``least``, joined up: their sizes fit,
    and behind the shared shingle enough is left of both for what they must have in common."""

    def fits(size: np.ndarray, place: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        both = least / (1 + least) * (size[i] + size[j]) - 1e-6
        left = np.minimum(size[i] - place[i], size[j] - place[j])
        return (left >= both) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-6)

    def spread(size: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        members, firsts = [], []
        while len(left):
            first, left = left[0], left[1:]
            queue = [first]
            while queue and len(left):
                near = fits(size, place, queue.pop(), left)
                if near.any():
                    reached, left = left[near], left[~near]
                    queue += list(reached)
                    members.append(reached)
                    firsts.append(np.full(len(reached), first))
        return members, firsts

    def links(key: np.ndarray, node: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, size, place = run_starts(key), packed >> 32, packed & 0xFFFFFFFF
        sizes = np.diff(np.r_[starts, len(key)])
        left: list[np.ndarray] = [np.zeros(0, np.int64)]
        right: list[np.ndarray] = [np.zeros(0, np.int64)]
        for at in np.flatnonzero(sizes > LONG_RUN):
            a, b = spread(size, place, np.arange(starts[at], starts[at] + sizes[at]))
            left += [node[x] for x in a]
            right += [node[x] for x in b]
        number = np.repeat(np.where(sizes <= LONG_RUN, np.arange(len(sizes)), -1), sizes)
        here, lag = np.flatnonzero(number >= 0), 1
        while True:
            here = here[: np.searchsorted(here, len(key) - lag)]
            here = here[number[here] == number[here + lag]]
            if not len(here):
                break
            near = here[fits(size, place, here, here + lag)]
            left.append(node[near])
            right.append(node[near + lag])
            lag += 1
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            a, b = joined_up(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run_starts(key: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        held: list[np.ndarray] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(pair) for pair in zip(held, columns)] if held else columns
            if len(held[0]) > CHUNK:
                whole = run_starts(held[0])[-1]
                if whole:
                    yield from links(*[c[:whole] for c in held])
                    held = [c[whole:] for c in held]
        if held and len(held[0]):
            yield from links(*held)

    return run


def prefix_links(texts: DataFrame, classes: DataFrame, size: int, least: float) -> DataFrame:
    """``(a, b)``: links that join all ``(id, text)`` rows whose shingle sets have similarity ``least`` or more.

    An exact join on each text's rarest shingles; pairs below ``least`` may be linked too.  ``classes`` is the written
    table of the ids (column ``node``).
    """
    every = max(1, math.ceil(classes.count() / COUNTED))
    counted = common.sized(classes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("node"), 16)
    sets = texts.join(counted, texts["id"] == counted["node"], "left_semi").mapInArrow(
        _shingling(size), "id long, shingles array<long>"
    )
    often = sets.select(F.explode("shingles").alias("key")).groupBy("key").count().where(F.col("count") >= OFTEN)
    told = often.orderBy(F.desc("count"), "key").limit(COMMON_SHINGLES).toArrow()
    keys, counts = told.column("key").to_numpy(), told.column("count").to_numpy() * every
    order = np.argsort(keys)
    first = texts.mapInArrow(
        _prefixing(size, least, keys[order], counts[order]), "key long, node long, at long"
    )
    together = first.repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(_prefix_linking(least), "a long, b long").distinct()


def _verifying(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of similarity ``least`` or more within runs of equal (coarse, tile), one fewer than what they join."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        near = np.triu(similarities(sets) >= least, 1)
        a, b = np.nonzero(near)
        members, firsts = joined_up(a, b) if len(a) else (a, b)
        return [(nodes[i], nodes[j]) for i, j in zip(members.tolist(), firsts.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        key, nodes, sets = None, [], []

        def flush() -> pa.RecordBatch:
            a, b = zip(*found) if (found := links(nodes, sets)) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            shingles = batch.column(3)
            for row, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if now != key:
                    if len(nodes) > 1:
                        yield flush()
                    key, nodes, sets = now, [], []
                nodes.append(batch.column(2)[row].as_py())
                sets.append(shingles[row].values.to_numpy().copy())
        if len(nodes) > 1:
            yield flush()

    return run


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    least: float = 0.8,
    seeds: Sequence[int] = (1, 2, 3),
) -> DataFrame:
    """``(doc_id, component_id)``: documents joined by links of shingle similarity ``least`` or more.

    Candidates come from fingerprints of single words, which lie closer than those of 5-word shingles, and from
    ``prefix_links``, which leaves out no pair; within a group of candidates the exact similarity of the shingle
    sets decides.  Equal word sequences are one class, texts without words one of them.  Ids are integers;
    rows with a null id are left out.
    """
    rows = common.narrow(docs, id=id_col, text=text_col).where("id IS NOT NULL")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    prints = [f"print{k}" for k in range(len(seeds))]
    signed = common.keep_table(
        rows.mapInArrow(_signing(seeds), "id long, same binary, " + ", ".join(f"{p} long" for p in prints)), "word_prints"
    )
    classes = common.keep_table(
        signed.groupBy("same").agg(F.min("id").alias("node"), *[F.first(p).alias(p) for p in prints]), "classes"
    )
    coarse = None
    for p in prints:
        leads = common.keep_table(classes.groupBy(F.col(p).alias("print")).agg(F.min("node").alias("lead")), "print_leads")
        stars = classes.join(leads, classes[p] == leads["print"]).select(F.col("node").alias("a"), F.col("lead").alias("b"))
        ends = linked(leads).join(leads.toDF("a", "lead_a"), "a").join(leads.toDF("b", "lead_b"), "b").select("lead_a", "lead_b")
        edges = stars.where("a <> b").unionAll(ends)
        coarse = edges if coarse is None else coarse.unionAll(edges)
    nodes = common.sized(classes.select("node"), 16)
    exact = prefix_links(rows.join(nodes, rows["id"] == nodes["node"], "left_semi"), classes, size, least)
    coarse = exact if coarse is None else coarse.unionAll(exact)
    candidates = common.keep_table(common.components(coarse, "candidates"), "candidate_groups")
    sizes = candidates.groupBy("root").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / (TILE // 4)).cast("int")
    dealt = (
        candidates.join(sizes, "root")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("tile", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        .select("root", "tile", "node")
    )
    wanted = common.sized(candidates.select("node"), 16)
    texts = rows.join(wanted, rows["id"] == wanted["node"], "left_semi")
    sets = common.keep_table(texts.mapInArrow(_shingling(size), "id long, shingles array<long>"), "shingle_sets")
    together = dealt.join(sets.dropDuplicates(["id"]), F.col("node") == F.col("id")).select("root", "tile", "node", "shingles")
    checked = together.repartition("root", "tile").sortWithinPartitions("root", "tile")
    roots = common.components(checked.mapInArrow(_verifying(least), "a long, b long"), "similar")
    named = classes.select("same", "node").join(roots.toDF("member", "root"), F.col("node") == F.col("member"), "left")
    named = named.select("same", F.coalesce("root", "node").alias("component_id"))
    return signed.select("id", "same").join(named, "same").select(F.col("id").alias("doc_id"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each of ``similar_groups``: the one with the smallest id; null ids stay.

    Of rows that share the id, the first by all columns stays.
    """
    found = similar_groups(docs, id_col, text_col, **options)
    dropped = common.keep_table(found.where("doc_id <> component_id").select("doc_id").distinct(), "near_duplicates")
    return common.single(common.without(docs, id_col, dropped), id_col)
