"""Language identification by partial matching: per-language trees of byte contexts give exact code lengths."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm import bytetree, common
from labelwise.llm.ctw_model import Counts

DEPTH = 4
#: Training documents of each language, about; the rest of the labelled rows is not needed.
TRAIN_DOCS = 1500
#: Contexts kept, and costs (context, byte, language) that every task holds at most.
CONTEXTS = 10_000
CELLS = 64 << 20
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def training_sample(labelled: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """Of ``labelled (id, text, lang)`` about ``per_language`` rows of each language, chosen by a hash of the id."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return labelled
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    return labelled.where(place < F.element_at(shares, F.col("lang")))


def _counting(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.released()
        counts: dict[str, bytetree.WindowCounts] = {}

        def rows(lang: str) -> pa.RecordBatch:
            keys, n = counts[lang].take()
            langs = pa.DictionaryArray.from_arrays(np.zeros(len(keys), np.int32), [lang]).cast(pa.string())
            return pa.RecordBatch.from_arrays([langs, pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = counts.setdefault(lang, bytetree.WindowCounts(depth))
                held.add([encoded(text)])
                if held.full():
                    yield rows(lang)
        for lang in counts:
            yield rows(lang)

    return run


def escape_costs(tree: bytetree.ContextTree, counts: Counts) -> np.ndarray:
    """``[node, code]``: bits of a byte after a node's context, by escape method C with exclusion.

    A context gives each byte it has seen ``c / (n + q)`` (``q``: distinct bytes seen) and the rest to the
    next shorter context, among the bytes not yet excluded; below the empty context bytes are uniform.
    """
    total = len(tree.parent)
    columns = np.zeros(tree.size, np.int64)
    columns[tree.codes[::-1]] = np.arange(255, -1, -1)
    held = np.concatenate([counts(lo, min(total, lo + 4096))[:, columns] for lo in range(0, total, 4096)])
    held[:, 0] = 0
    out = np.zeros((total, tree.size), np.float32)
    for lo in range(0, total, 4096):
        hi = min(total, lo + 4096)
        node, cost = np.arange(lo, hi), np.zeros((hi - lo, tree.size))
        escape, gone = np.zeros(hi - lo), np.zeros((hi - lo, tree.size), bool)
        active = np.ones(hi - lo, bool)
        while active.any():
            c = np.where(gone, 0, held[node]) * active[:, None]
            n, q = c.sum(axis=1), (c > 0).sum(axis=1)
            seen = c > 0
            with np.errstate(divide="ignore"):
                bits = escape[:, None] - np.log2(c / np.maximum(1, n + q)[:, None])
                escape = escape - np.where(n > 0, np.log2(np.maximum(1, q) / np.maximum(1, n + q)), 0)
            cost[seen] = bits[seen]
            gone |= seen
            active &= node > 0
            node = tree.parent[node]
        left = np.maximum(1, 256 - gone.sum(axis=1))
        out[lo:hi] = np.where(gone, cost, (escape + np.log2(left))[:, None])
    return out


def learn(labelled: DataFrame, depth: int = DEPTH, contexts: int = CONTEXTS, per_language: int = TRAIN_DOCS):
    """``(languages, tree, table)`` from ``labelled (id, text, lang)``; the model's size is bounded by ``CELLS``."""
    sample = training_sample(labelled, per_language)
    counted = sample.select("text", "lang").mapInArrow(_counting(depth), "lang string, key long, n long")
    sums = common.keep_table(counted.groupBy("lang", "key").agg(F.sum("n").alias("n")), "lang_windows")
    languages = sorted(r["lang"] for r in sums.select("lang").distinct().collect())
    if not languages:
        return [], None, None
    rows = bytetree.context_rows(sums, depth, "lang")
    room = max(256, min(contexts, CELLS // (256 * len(languages))))
    kept = bytetree.common_contexts(rows, depth, room, least=4)
    seen = np.sort(kept[0]["byte"].unique())
    held = [np.unique(k["context"].to_numpy(np.int64)) for k in kept]
    if not len(held[0]):
        held[0] = np.zeros(1, np.int64)
    tree = bytetree.build_tree(held, seen)
    table = np.zeros((len(tree.parent), tree.size, len(languages)), np.float32)
    for at, lang in enumerate(languages):
        mine = [k[k["lang"] == lang] for k in kept]
        keys = [
            (tree.bounds[d] + np.searchsorted(held[d], k["context"].to_numpy(np.int64))) * 256 + k["byte"].to_numpy(np.int64)
            for d, k in enumerate(mine)
        ]
        table[:, :, at] = escape_costs(tree, Counts(np.concatenate(keys), np.concatenate([k["n"].to_numpy() for k in mine])))
    return languages, tree, table.reshape(-1, len(languages))


def _predicting(languages: list[str], model) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.released()
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 256):
                texts = batch.iloc[at : at + 256].tolist()
                coded = [encoded(t) for t in texts]
                lettered = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
                if model is None:
                    parts.append(pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "bits_per_byte": 0.0}))
                    continue
                tree, table = model.value
                bits = bytetree.text_costs(tree, table, coded)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                share = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
                names = np.where(lettered, np.array(languages, object)[best], UNKNOWN)
                parts.append(
                    pd.DataFrame(
                        {
                            "lang_pred": names,
                            "score": np.where(lettered, share, 0.0),
                            "bits_per_byte": least / np.maximum(1, [len(c) for c in coded]),
                        }
                    )
                )
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": [], "score": [], "bits_per_byte": []})

    return run


def predict(docs: DataFrame, labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language``: lang_pred, score (0 to 1) and bits_per_byte under the best model.

    ``labelled (id, text, lang)`` is what may be learned from; rows with a null lang are ignored.  The whole
    text is coded by every language's model; the shortest code wins, ties by name, and ``score`` is its share
    of the probability.  A null text or one without a letter is ``und`` with score 0, and so is every text
    if there is nothing to learn from.  A column named ``language`` is replaced.
    """
    languages, tree, table = learn(labelled.where("lang IS NOT NULL"))
    model = docs.sparkSession.sparkContext.broadcast((tree, table)) if languages else None
    say = F.pandas_udf(_predicting(languages, model), "lang_pred string, score double, bits_per_byte double")
    return docs.withColumn("language", say(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
