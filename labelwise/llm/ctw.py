"""Language-model scoring by context-tree weighting: code length of every text, and a word-count base beside it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm import bytetree, common, ctw_model, ctw_sharded

DEPTH = 6
#: Contexts of a tree that tasks hold; with 256 possible bytes each this bounds the cost table at 32 MB.  A corpus that
#: may have more is scored by a sharded table of all its contexts.
CONTEXTS = 32_768
#: Words held by every task; rarer ones are joined.
COMMON_WORDS = 150_000
END_BYTE = b"\n"
WORD_KIND, WINDOW_KIND = 0, 1


def spelled(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _counting(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word and window counts of a task's training texts, with one end after each."""

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 200_000):
            part = slice(at, at + 200_000)
            kinds = np.full(len(keys[part]), kind, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(keys[part]), pa.array(counts[part].astype(np.int64))], names=["kind", "key", "n"]
            )

    def word_rows(words: Counter) -> Iterator[pa.RecordBatch]:
        keys = np.fromiter(map(_word_key, words), np.int64, len(words))
        yield from rows(WORD_KIND, keys, np.fromiter(words.values(), np.int64, len(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, words = bytetree.WindowCounts(depth), Counter()
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 256):
                said = [spelled(t) for t in texts[at : at + 256].to_pylist()]
                windows.add([b" ".join(s) + END_BYTE for s in said])
                for s in said:
                    words.update(s)
                words[END_BYTE] += len(said)
                if windows.full():
                    yield from rows(WINDOW_KIND, *windows.take())
                if len(words) > bytetree.HELD // 8:
                    yield from word_rows(words)
                    words = Counter()
        yield from rows(WINDOW_KIND, *windows.take())
        yield from word_rows(words)

    return run


def learn(training: DataFrame, text_col: str = "text", depth: int = DEPTH, contexts: int = CONTEXTS):
    """``(word counts (key, n), tree, cost table)`` from every text of ``training``, none left out.

    Tasks send sums for distinct words and byte windows; the tree keeps the commonest contexts, so that what
    the scoring tasks hold is bounded while what is counted grows with the corpus.
    """
    counted = training.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(
        _counting(depth), "kind int, key long, n long"
    )
    sums = common.keep_table(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    rows = bytetree.context_rows(sums.where(F.col("kind") == WINDOW_KIND), depth)
    kept = bytetree.common_contexts(rows, depth, contexts)
    seen = kept[0]["byte"].unique()
    bounds = [np.unique(k["context"].to_numpy(np.int64)) for k in kept]
    if not len(bounds[0]):
        bounds[0] = np.zeros(1, np.int64)
    tree = bytetree.build_tree(bounds, np.sort(seen))
    keys = [
        (tree.bounds[d] + np.searchsorted(bounds[d], k["context"].to_numpy(np.int64))) * 256 + k["byte"].to_numpy(np.int64)
        for d, k in enumerate(kept)
    ]
    numbers = [k["n"].to_numpy(np.int64) for k in kept]
    table = ctw_model.cost_table(tree, ctw_model.Counts(np.concatenate(keys), np.concatenate(numbers)))
    return sums.where(F.col("kind") == WORD_KIND).select("key", "n"), tree, table


def commonest(counts: DataFrame, limit: int) -> pd.DataFrame:
    """The rows of ``counts (key, n)`` with the highest numbers, at most ``limit``; numbers of one step fall together."""
    step = F.floor(F.log2("n") * 8)
    kept, bound = 0, math.inf
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        kept += row["count"]
        if kept > limit:
            break
        bound = row["step"]
    return counts.where(step >= bound).toArrow().to_pandas()


SCORED = "bits double, n_tokens long, n_common long, common_score double, rare array<long>, times array<long>"
NAMES = ["row", "id", "bits", "n_tokens", "n_common", "common_score", "rare", "times"]
#: What a worker holds of the common words, kept for its next group: what was sent, logs by key, logs by word.
_common: list = [None, {}, {}]


def _word_columns(said: list[list[bytes]], words) -> list[pa.Array]:
    """Tokens of each text, the base over common words, and its rarer words with their numbers."""
    if _common[0] is not words.value:
        keys, logs = words.value
        _common[:] = words.value, dict(zip(keys.tolist(), logs.tolist())), {}
    _, known, spelled_keys = _common
    out = []
    for s in said:
        total, sure, rare = 0.0, 0, {}
        for word, n in Counter([*s, END_BYTE]).items():
            if word in spelled_keys:
                log = spelled_keys[word]
            else:
                key = _word_key(word)
                log = known.get(key)
                if log is None:
                    rare[key] = n
                    continue
                if len(spelled_keys) < COMMON_WORDS:
                    spelled_keys[word] = log
            total += n * log
            sure += n
        out.append((len(s) + 1, sure, total, list(rare), list(rare.values())))
    lists = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.float64(), lists, lists)
    return [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]


def _scoring(model, words) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text its code length by a held tree, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, table = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                row, ids, texts = (batch.column(k)[at : at + 256] for k in range(3))
                said = [spelled(t) for t in texts.to_pylist()]
                bits = bytetree.text_costs(tree, table, [b" ".join(s) + END_BYTE for s in said])
                yield pa.RecordBatch.from_arrays([row, ids, pa.array(bits), *_word_columns(said, words)], names=NAMES)

    return run


def _asking(shape: ctw_sharded.Shape) -> Callable[[pa.Table], pa.Table]:
    """A chunk's windows by part, and the words of its training texts as part -1."""

    def run(chunk: pa.Table) -> pa.Table:
        said = [spelled(t) for t in chunk.column("text").to_pylist()]
        taught = chunk.column("taught").to_numpy()
        number = chunk.column("chunk")[0].as_py()
        words = Counter()
        for s, t in zip(said, taught):
            if t:
                words.update(s)
                words[END_BYTE] += 1
        keys = np.fromiter(map(_word_key, words), np.int64, len(words))
        n = np.fromiter(words.values(), np.int64, len(words))
        rows = [(number, -1, 0, ctw_sharded.packed_keys(keys), ctw_sharded.packed(n))]
        coded = [b" ".join(s) + END_BYTE for s in said]
        del said, words  # many small objects
        rows += ctw_sharded.asks(coded, taught, number, shape)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, kind) for c, v, kind in zip(("chunk", "part", "sub", "keys", "n"), zip(*rows), kinds)})

    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            columns = [ctw_sharded.unpacked_keys(keys), ctw_sharded.unpacked(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n"])


def _chunk_scoring(shape: ctw_sharded.Shape, words) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same of a chunk's texts by the costs that came back."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        said = [spelled(t) for t in chunk.column("text").to_pylist()]
        bits = ctw_sharded.text_costs([b" ".join(s) + END_BYTE for s in said], answers, shape)
        columns = [chunk.column("row"), chunk.column("id"), pa.array(bits), *_word_columns(said, words)]
        return pa.Table.from_arrays(columns, names=NAMES)

    return run


def score(
    docs: DataFrame,
    is_training,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    contexts: int = CONTEXTS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Texts are their lower-cased (A-Z) words with one space between and one end; null counts as empty, and an
    empty text has the end alone.  ``is_training(id column)`` names the rows that the model and the counts
    learn from; a null there counts as training.  ``score`` is the log10 probability of the text under the
    frozen weighted context tree of all contexts up to ``depth`` bytes; up to ``contexts`` of them are held by the
    tasks, more are a sharded table; ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over its words.
    Words are told apart by a 64-bit hash.  Repeated rows and ids each get their row; other columns play no part.
    """
    spark = docs.sparkSession
    taught = F.coalesce(is_training(F.col("id")), F.lit(True)).alias("taught")
    rows = common.narrow(docs, id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "id", F.col("text").cast("string").alias("text"), taught
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1), F.lit(0))).first()[0]
    held = size * (depth + 1) <= contexts  # no byte makes more contexts than these
    if held:
        counts, tree, table = learn(rows.where("taught"), "text", depth, contexts)
    else:
        shape = ctw_sharded.Shape.of(depth, size)
        dealt = rows.withColumn("chunk", ctw_sharded.chunk(shape, "id", "text"))
        asked = dealt.select("chunk", "text", "taught").groupBy("chunk").applyInArrow(_asking(shape), ctw_sharded.ASKS)
        asked = common.keep_table(asked, "asks", compression="zstd")
        words = asked.where("part = -1").select("keys", "n").mapInArrow(_word_rows, "key long, n long")
        counts = common.keep_table(words.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_distinct = int(whole[0]), int(whole[1])
    denominator = n_all + 0.5 * (n_distinct + 1)
    unseen = math.log10(0.5 / denominator)
    most = commonest(counts, COMMON_WORDS)
    logs = np.log10((most["n"].to_numpy(float) + 0.5) / denominator)
    words = spark.sparkContext.broadcast((most["key"].to_numpy(np.int64), logs))
    kinds = f"row long, id {dict(rows.dtypes)['id']}, {SCORED}"
    if held:
        model = spark.sparkContext.broadcast((tree, table))
        scored = rows.select("row", "id", "text").mapInArrow(_scoring(model, words), kinds)
    else:
        answers = ctw_sharded.answers(asked.where("part >= 0"), shape)
        texts = dealt.select("chunk", "row", "id", "text").groupBy("chunk")
        scored = texts.cogroup(answers.groupBy("chunk")).applyInArrow(_chunk_scoring(shape, words), kinds)
    scored = common.keep_table(scored, "scored")
    rare = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).toDF("row", "key", "times")
    found = rare.join(counts, "key").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(denominator))).alias("rare_score")
    )
    n_known = F.col("n_common") + F.coalesce("n_rare", F.lit(0))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0)) + (F.col("n_tokens") - n_known) * F.lit(unseen)).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
    )
