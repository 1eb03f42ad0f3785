"""Centroid clustering, vector codes and shards against brute force and odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.llm import centroids, codes, shards, vectors
from labelwise.session import shared_dir

VECTORS = "vec_id long, embedding array<float>, label int, vector string, code string, cluster string, part int"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, other lengths, values that are not finite, repeated ids and rows, and names that clash with the operators'."""
    rng = random.Random(3)
    some = lambda n=8: [rng.gauss(0, 0.3) for _ in range(n)]
    rows = [(k, some(), k % 3) for k in range(150)]
    same = some()
    rows += [(500 + k, same, 7) for k in range(60)] + [(500, same, 7)] * 3
    rows += [(None, some(), None), (None, some(), None), (700, some(), None)]
    rows += [(800, None, 1), (801, [], 1), (802, some(7) + [None], 1), (803, some(7) + [math.nan], 1)]
    rows += [(804, some(7) + [math.inf], 1), (805, some(4), 2), (806, some(12), 9), (807, some(7), 1)]
    return spark.createDataFrame([(*r, "v", "c", "k", 0) for r in rows], VECTORS).repartition(5)


def kept_vectors(df, scale, dims):
    rows = []
    for r in df.collect():
        v = r.embedding
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            rows.append((r.vec_id, r.label, [math.floor(scale * float(np.float32(x))) for x in v]))
    return rows


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


# --- centroids --------------------------------------------------------------


@pytest.mark.parametrize("count, dims, spread", [(8, 64, 50), (60, 3, 50), (1, 5, 9), (40, 2, 3), (7, 1, 2)])
def test_walk_finds_the_nearest_and_the_first_of_equals(count, dims, spread):
    rng = np.random.default_rng(count)
    model, points = rng.integers(-spread, spread, (count, dims)), rng.integers(-spread - 5, spread + 5, (400, dims))
    cluster, distance, met = centroids.walk(points, centroids.Lists.of(model))
    exact = ((points[:, None] - model[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert (1 <= met).all() and (met <= count).all()


def test_walk_stops_before_it_has_met_all():
    rng = np.random.default_rng(1)
    model = rng.integers(-10_000, 10_000, (500, 3))
    _, _, met = centroids.walk(model + rng.integers(-3, 3, model.shape), centroids.Lists.of(model))
    assert met.mean() < 50


def test_walk_goes_on_at_an_equal_sum():
    # the nearest by the lists is number 1; number 0 ties with it exactly and is met one step later
    model = np.array([[3, 4], [5, 0]])
    cluster, distance, met = centroids.walk(np.array([[0, 0]]), centroids.Lists.of(model))
    assert (cluster[0], distance[0], met[0]) == (0, 25, 2)


def brute_clusters(rows, count, rounds, seed):
    named = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), np.array(r[2], "<i4").tobytes()))
    model = [r[2] for r in named[:count]]
    best = lambda v: min((squared(v, c), k) for k, c in enumerate(model))
    for _ in range(rounds):
        groups = {}
        for r in rows:
            groups.setdefault(best(r[2])[1], []).append(r[2])
        model = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(model)]
    found = [(r[0], *best(r[2])[::-1]) for r in rows]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), names[k]) for i, k, d in found)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("count, rounds", [(5, 10), (300, 1), (1, 2)])
def test_clusters_equal_brute_force(odd_vectors, count, rounds):
    got = centroids.clusters(odd_vectors, count, 8, rounds)
    want = brute_clusters(kept_vectors(odd_vectors, 1024, 8), count, rounds, "3:")
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == want


def test_clusters_of_nothing(odd_vectors):
    for rows in (odd_vectors.limit(0), odd_vectors.where("vec_id >= 800 AND vec_id < 805")):
        got = centroids.clusters(rows, 5, 8)
        assert got.columns == [*COLUMNS, "met"] and got.count() == 0


def test_sums_of_many_blocks(odd_vectors, monkeypatch):
    want = sorted(map(str, centroids.clusters(odd_vectors, 4, 8).collect()))
    monkeypatch.setattr(centroids, "CELLS", 64)
    assert sorted(map(str, centroids.clusters(odd_vectors, 4, 8).collect())) == want


def test_a_component_too_large_is_told(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(rows, 1, 2).collect()


# --- vector codes -----------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 24, 25, 2**52 - 1, (2**26 - 1) ** 2, (2**26 - 1) ** 2 - 1])
def test_roots_are_exact(n):
    assert int(vectors.floor_root(np.array([n]))[0]) == math.isqrt(n)
    assert int(vectors.ceil_root(np.array([n]))[0]) == math.isqrt(max(0, n - 1)) + (n > 0)


@pytest.mark.parametrize("entries, width, b", [(64, 4, 16), (8, 2, 2), (3, 1, 2), (1, 2, 0), (2, 1, 1), (40, 2, 39)])
@pytest.mark.parametrize("move", [0, 1, 4, 30, 100_000])
def test_bounds_never_hide_an_entry(entries, width, b, move):
    rng = np.random.default_rng(entries + move)
    book, points = rng.integers(-40, 40, (entries, width)), rng.integers(-45, 45, (300, width))
    state, _ = codes.search(points, book, b)
    for step in range(5):
        moved = book + rng.integers(-move, move + 1, book.shape)
        state, squares, _, _ = codes.update(points, moved, codes.drifts(book[None], moved[None])[0], state)
        book = moved
        exact = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (state.code == exact.argmin(1)).all() and (squares == exact.min(1)).all()
        if step == 2:
            b = max(0, b - 1) if b > 1 else b
            state = codes.shortened(state, b)


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(8)
    book = rng.integers(-1000, 1000, (64, 4))
    points = book[rng.integers(0, 64, 2000)] + rng.integers(-60, 60, (2000, 4))
    state, _ = codes.search(points, book, 16)
    moved = book + rng.integers(-5, 6, book.shape)
    _, _, doubt, looked = codes.update(points, moved, codes.drifts(book[None], moved[None])[0], state)
    assert looked < 0.1 * points.shape[0] * 64 and (doubt == 0).mean() > 0.8


def test_list_length_adapts():
    assert codes.adapted(16, 8, {0: 990, 3: 9, 16: 1, 17: 400}) == 8
    assert codes.adapted(16, 2, {0: 900, 5: 95, 12: 5}) == 5
    assert codes.adapted(16, 8, {0: 50, 12: 50}) == 12
    assert codes.adapted(16, 8, {17: 10, 255: 4}) == 16


def brute_codes(rows, parts, entries, rounds):
    width = len(rows[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]
    best = lambda v, p: min((squared(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in rows:
                part = cut(r[2])[p]
                groups.setdefault(best(part, p)[1], []).append(part)
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = []
    for r in rows:
        hits = [best(part, p) for p, part in enumerate(cut(r[2]))]
        found.append((r[0], r[1], "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return found, digest


@pytest.mark.parametrize("parts, entries, rounds", [(4, 16, 3), (8, 4, 1), (2, 256, 2), (1, 1, 2)])
def test_codes_equal_brute_force(odd_vectors, parts, entries, rounds):
    rows = odd_vectors.where("vec_id IS NULL OR vec_id < 800")
    found, digest = brute_codes(kept_vectors(rows, 256, 8), parts, entries, rounds)
    errors = Counter()
    for _, label, _, error in found:
        errors[label] += error
    want = Counter((i, code, error, errors[label], digest) for i, label, code, error in found)
    assert Counter(tuple(r) for r in codes.codes(rows, parts, entries, rounds).collect()) == want


def test_vectors_of_other_lengths_have_no_code(odd_vectors):
    got = {r.vec_id: r for r in codes.codes(odd_vectors, 4, 8).where("vec_id >= 800").collect()}
    assert sorted(got) == [801, 805, 806, 807] and all(r.code is None and r.error is None for r in got.values())
    assert got[806].label_error is None and got[805].label_error > 0


def test_codes_of_nothing(odd_vectors):
    assert codes.codes(odd_vectors.limit(0), 4).count() == 0
    alone = codes.codes(odd_vectors.where("vec_id = 807"), 4)
    assert [tuple(r) for r in alone.collect()] == [(807, None, None, None, None)]


def test_written_lists_get_shorter(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 1, (32, 8))
    rows = [(k, [float(x) for x in middles[k % 32] + rng.normal(0, 0.002, 8)], 0) for k in range(1500)]
    table = vectors.whole(
        spark.createDataFrame(rows, "vec_id long, vector array<double>, label int"), 256, 8, "test_vectors"
    )
    books = np.floor(np.array([r[1] for r in rows[:64]]) * 256).astype(np.int64).reshape(64, 2, 4).transpose(1, 0, 2)
    last, _, lengths = codes.improve(table, np.ascontiguousarray(books), 3)
    assert lengths[0] == 16 and lengths[-1] < 16
    assert last.agg(F.sum("looked")).collect()[0][0] < 1500 * 2 * 64


# --- shards -----------------------------------------------------------------

DOCS = "doc_id long, text string, shard string, slot string, size string, doc string, place int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(6)
    rows = [(k, "é" * rng.randint(0, 300)) for k in range(300)]
    rows += [(None, "same words")] * 150 + [(None, None)] * 20 + [(77, "x")] * 4 + [(5, ""), (6, None), (400, "long " * 4000)]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "a", "b", "c", "d", 1) for r in rows], DOCS).repartition(7)


def written(spark, docs, **options):
    path = shared_dir(spark, "test_shards")
    shards.write(docs, path, **options)
    return shards.read(spark, path, docs)


def brute_shards(sizes, count):
    total, at, out = sum(sizes), 0, []
    for size in sizes:
        out.append(sum(2 * at + size > 2 * (k * total // count) for k in range(1, count)))
        at += size
    return out


@pytest.mark.parametrize("count", [1, 2, 8, 40, 700])
def test_shards_equal_brute_force(spark, odd_docs, count):
    got = sorted(written(spark, odd_docs, shards=count).collect(), key=lambda r: (r.shard, r.slot))
    assert Counter((r.doc.doc_id, r.doc.text, r.doc.shard, r.doc.place) for r in got) == Counter(
        (r.doc_id, r.text, r.shard, r.place) for r in odd_docs.collect()
    )
    ids = [math.inf if r.doc.doc_id is None else r.doc.doc_id for r in got]
    assert ids == sorted(ids)
    sizes = [len((r.doc.text or "").encode()) + 1 for r in got]
    assert [r.size for r in got] == sizes
    assert [r.shard for r in got] == brute_shards(sizes, count)
    for k, n in Counter(r.shard for r in got).items():
        assert [r.slot for r in got if r.shard == k] == list(range(n))


def test_a_repeated_id_divides_among_partitions(spark):
    docs = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("ab").alias("text"))
    rows = shards.placed(docs, "text", ["doc_id"])
    parts = rows.groupBy(F.shiftright("place", shards.ROW_BITS).alias("p")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2000
    assert [r["count"] for r in written(spark, docs).groupBy("shard").count().collect()] == [500] * 8


def test_stored_order_is_kept(spark, odd_docs):
    got = sorted(written(spark, odd_docs, shards=5, order=()).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.shard for r in got] == brute_shards([r.size for r in got], 5)
    assert [(r.doc.doc_id, r.doc.text) for r in got] == [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert max(Counter(r.shard for r in got)) == 4


def test_one_shard_is_read_alone_and_checksums_agree(spark, odd_docs):
    path = shared_dir(spark, "test_shards")
    shards.write(odd_docs, path, 4)
    alone = shards.read(spark, path, odd_docs, 2)
    assert "PartitionFilters: [isnotnull(shard" in alone._jdf.queryExecution().toString()
    crc = alone.select("doc.text", F.crc32(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("crc")).collect()
    assert crc and all(r.crc == zlib.crc32((r.text or "").encode()) for r in crc)


def test_shards_of_nothing(spark, odd_docs):
    assert written(spark, odd_docs.limit(0)).count() == 0
