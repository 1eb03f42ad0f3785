"""Token ids in Parquet: list columns with dictionary encoding, delta-encoded metadata, page indexes.

A store is a folder of files in ascending id order, or in an order of the caller's.  Row groups and pages have set sizes, so a reader that
wants a few documents or only the counts touches a few pages: ``read_counts`` never reads a token page and
``read_documents`` prunes row groups and pages by the id.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwise.llm import common

#: Parquet settings of a store; ids repeat much, so tokens take a dictionary, and the sorted numbers take deltas.
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 512
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
#: Chunks met in several batches that a worker remembers before it starts afresh.
MEMORY = 100_000
#: Characters of texts that one batch holds at most (one document more), and chunks that go to the library at a time.
BATCH_CHARS = 4 << 20
JOINED = 512
SCHEMA = "doc_id long, first long, n_tokens int, tokens array<int>"

#: How a byte-level vocabulary writes a space.
SPACE_MARK = "\u0120"
#: The settings under which texts may be cut at spaces; any other tokenizer encodes whole texts.
CUTTABLE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: A space with more than white space after it.  What the library takes for white space is white space here too.
CUT = re.compile(r" (?=\S)")


class ChunkEncoder:
    """Ids of whole texts as the tokenizers library gives them, each distinct chunk of a batch encoded once.

    A byte-level tokenizer splits a text before it merges, and it always splits before a space with more than white
    space after it; what stands between two such places (a chunk) has the same ids in any text.  Chunks that a batch
    holds for the first time go to the library joined by spaces, and tokens that open with a space tell them apart
    again.  A chunk is remembered for one more batch, and for good if it comes up there; a full memory starts afresh,
    which costs time only.  A text that holds an added token, which the library looks for before it splits, goes to it whole, as do all texts of any
    other kind of tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        split = self.library.pre_tokenizer
        split = json.loads(split.__getstate__()) if split else {}
        self.cuttable = not self.library.normalizer and all(split.get(k) == v for k, v in CUTTABLE.items())
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[k for t, k in vocabulary.items() if t.startswith(SPACE_MARK)]] = True
        self.common: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in done]

    def _new(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks behind a space."""
        plain = [c for c in chunks if " " not in c]
        spaced = [c for c in chunks if " " in c]
        out = dict(zip(spaced, self._library([" " + c for c in spaced])))
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            [joined] = self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            flat = np.asarray(joined.ids, "<u4")
            ids, cuts = flat.tobytes(), (4 * np.flatnonzero(self.opens[flat])).tolist()
            out.update(zip(some, [ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]))
        return [out[c] for c in chunks]

    def _cut(self, texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray]:
        """Each text's first chunk, all other chunks, and how many of these each text has."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = split.values
        # a space before white space, or at the end, is no place to cut; such texts are cut by the pattern
        odd = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(flat, 0, 1)))
        ends = split.offsets.to_numpy()
        many = np.add.reduceat(np.r_[odd.to_numpy(zero_copy_only=False), False].astype("i8"), ends[:-1])
        regular = np.flatnonzero(many == 0)
        if len(regular) < len(texts):
            parts = [None] * len(texts)
            for k in np.flatnonzero(many):
                parts[k] = CUT.split(texts[k])
            heads = [texts[k].partition(" ")[0] if p is None else p[0] for k, p in enumerate(parts)]
            counts = np.array([ends[k + 1] - ends[k] if p is None else len(p) for k, p in enumerate(parts)]) - 1
            pieces, run = [], 0
            for k, p in enumerate([*parts, []]):
                if p is not None:
                    pieces.append(self._tails(split, ends, run, k))
                    pieces.append(pa.array(p[1:], pa.large_string()))
                    run = k + 1
            return heads, pa.concat_arrays(pieces), counts
        return [t.partition(" ")[0] for t in texts], self._tails(split, ends, 0, len(texts)), np.diff(ends) - 1

    @staticmethod
    def _tails(split: pa.Array, ends: np.ndarray, start: int, stop: int) -> pa.Array:
        """All chunks but the first of the texts from ``start`` to ``stop``."""
        if start >= stop:
            return pa.array([], pa.large_string())
        keep = np.ones(ends[stop] - ends[start], bool)
        keep[ends[start:stop] - ends[start]] = False
        return split.values.slice(ends[start], ends[stop] - ends[start]).filter(pa.array(keep))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of a batch's distinct chunks, remembered or new."""
        ids = list(map(self.common.get, words))
        if len(self.common) > MEMORY:
            self.common = {}
        fresh = []
        for k in [k for k, b in enumerate(ids) if b is None]:
            ids[k] = self.recent.get(words[k])
            if ids[k] is None:
                fresh.append(k)
            else:
                self.common[words[k]] = ids[k]
        new = [words[k] for k in fresh]
        self.recent = dict(zip(new, self._new(new)))
        for k, w in zip(fresh, new):
            ids[k] = self.recent[w]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [not self.cuttable or bool(self.added and self.added.search(t)) for t in texts]
        out = [b""] * len(texts)
        for k, ids in zip(np.flatnonzero(whole), self._library([t for t, w in zip(texts, whole) if w])):
            out[k] = ids
        places = [k for k, w in enumerate(whole) if not w]
        if not places:
            return out
        heads, chunks, counts = self._cut([texts[k] for k in places])
        first = pa.array(heads, pa.large_string()).dictionary_encode()
        head_ids = self._library(first.dictionary.to_pylist())
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = self._ids(words)
        sizes = np.array([len(b) // 4 for b in ids], "i8")
        table = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        taken = table.take(coded.indices)
        flat, ends = memoryview(taken.flatten().to_numpy().tobytes()), 4 * np.r_[0, np.cumsum(sizes[coded.indices.to_numpy()])]
        stops = np.cumsum(counts)
        for k, head, a, b in zip(places, first.indices.to_pylist(), ends[stops - counts].tolist(), ends[stops].tolist()):
            out[k] = head_ids[head] + bytes(flat[a:b])
        return out


def _by_chars(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for k, size in enumerate(sizes):
        held += size
        if held >= BATCH_CHARS:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _encode_with(path: str, end: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a task of its own
        encoder = common.kept(("encoder", path), lambda: ChunkEncoder(path))  # with what it has learned
        first = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in _by_chars(pc.utf8_length(texts).to_pylist()):
                coded = [b + end for b in encoder.encode(texts[part].to_pylist())]
                sizes = np.array([len(b) // 4 for b in coded], "i8")
                values = np.frombuffer(b"".join(coded), "<i4")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, part.stop - part.start),
                        pa.array(first + ends - sizes),
                        pa.array(sizes.astype("i4")),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("i4")), pa.array(values)),
                    ],
                    names=["doc_id", "first", "n_tokens", "tokens"],
                )
                first += int(ends[-1])
                pa.default_memory_pool().release_unused()

    return run


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    order: Sequence[str] = (),
) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write a store in ascending id order.

    Null ids come first; rows of one id lie side by side in order of their texts.  With columns ``order`` the
    documents lie in ascending order of these instead.  ``part`` numbers the files
    in that order and ``first`` counts the ids before a document in its file.  An empty table gives an empty store.
    """
    places = {f"order{k}_": name for k, name in enumerate(order)}
    rows = common.narrow(docs, doc_id=id_col, text=text_col, **places).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *places
    )
    ranges, within = (list(places), list(places)) if order else (["doc_id"], ["doc_id", "text"])
    ordered = rows.repartitionByRange(*ranges).sortWithinPartitions(*within).select("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")
    coded = ordered.mapInArrow(_encode_with(tokenizer, end), SCHEMA)
    with common.small_batches(docs.sparkSession):
        coded.withColumn("part", F.spark_partition_id()).write.options(**LAYOUT).parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, first, n_tokens, start)``; ``start`` counts the ids of all documents before. Reads no tokens."""
    rows = spark.read.parquet(path).select("doc_id", "part", "first", "n_tokens")
    return rows.join(manifest(spark, path).select("part", "base"), "part").withColumn("start", F.col("base") + F.col("first"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: part, documents, ids, and ``base``, the ids of all files before it."""
    files = spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_documents(spark: SparkSession, path: str, chosen: Callable[[Column], Column]) -> DataFrame:
    """``(doc_id, tokens)`` of the documents whose id fits, such as ``lambda i: i.between(3, 9)``."""
    rows = spark.read.parquet(path)
    return rows.where(chosen(rows["doc_id"])).select("doc_id", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(3)
        values = tokens.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
        ends = tokens.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].data) for a, b in zip(ends[:-1], ends[1:])]
        sizes = np.diff(ends).astype("i8")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "first", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, and the crc32 of its ids as little-endian 32-bit integers."""
    rows = spark.read.parquet(path).select("doc_id", "part", "first", "tokens")
    read = rows.mapInArrow(_checksums, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    with common.small_batches(spark):
        read = common.keep_table(read, "token_sums")
    bases = common.keep_table(manifest(spark, path).select("part", "base"), "token_manifest")
    return read.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
