"""Cleaning of noisy text: in place for short texts, by vocabulary for long ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.functions import text as X
from labelwise.functions.spans import let
from labelwise.session import cut, spread, written

LITERAL_WORDS = 20_000
#: Texts of at most so many bytes a core in few files are dealt out: their repair costs more than their shuffle.
TEXT_BYTES = 512 << 20
SLOTS = 1 << 14


def clean_text(text: Column) -> Column:
    """Fully cleaned text as one narrow expression, every word scored in place.

    Right for short regions.  For tables use :func:`clean_corpus`, which scores
    each distinct word once.
    """
    return let(
        X.rebuild(let(X.repair(text), X.mark_words), X.heal_word),
        lambda healed: X.finish(X.heal_numbers(healed)),
    )


def heal_vocabulary(words: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words that heal to a keyword: ``word, keyword``.

    Duplicates fold on the map side and the distinct words are written, or Spark would push the condition on the
    keyword below the folding and score every word as often as it is printed.
    """
    return (
        written(words.select(F.col(word).alias("word")).distinct())
        .select("word", X.heal_word(F.col("word")).alias("keyword"))
        .where("keyword is not null")
    )


def marked_words(marked: DataFrame, column: str) -> DataFrame:
    """Looked-up words (``word``) of a column of marked texts; words as printed fold first and are looked up once."""
    pieces = marked.select(F.explode(F.split(column, X.SPAN)).alias("piece")).where(F.contains("piece", F.lit(X.BODY)))
    printed = pieces.select(F.substring_index("piece", X.BODY, 1).alias("word")).distinct()
    return printed.select(X.heal_lookup(F.col("word")).alias("word"))


def _slot(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(SLOTS))


def _literal_lookup(vocabulary: list) -> Callable[[Column], Column]:
    """Lookup expression over a hash table held as a literal in the plan."""
    by_slot: list[dict[str, str]] = [{} for _ in range(SLOTS)]
    for r in vocabulary:
        by_slot[r.slot][r.word] = r.keyword
    table = X.literal_table(by_slot, "array<map<string,string>>")
    return lambda w: F.element_at(F.get(table, _slot(w)), w)


def clean_corpus(df: DataFrame, key: list[str], text: str, out: str = "clean") -> DataFrame:
    """Clean a table of texts with one scoring per distinct word of the whole table.

    Only words travel to build the vocabulary; what comes back are the healed
    words.  A checked small set becomes a literal hash table and the texts are
    rebuilt where they are, with no shuffle.  A larger set joins by shuffle on
    the word and meets its texts on a row number, so ``key`` need not be unique.
    Both give the same rows.
    """
    # both the vocabulary and the texts rebuilt with it read the repaired texts
    marked = written(spread(df, TEXT_BYTES).withColumn("_marked", let(X.repair(F.col(text)), X.mark_words)))
    vocabulary = heal_vocabulary(marked_words(marked, "_marked"))
    head = vocabulary.withColumn("slot", _slot(F.col("word"))).limit(LITERAL_WORDS + 1).collect()
    if len(head) <= LITERAL_WORDS:
        healed = X.rebuild(F.col("_marked"), _literal_lookup(head))
    else:
        # one small map per text: bounded by that text's own distinct words
        marked = cut(marked.withColumn("_row", F.monotonically_increasing_id()))
        vocabulary = cut(vocabulary)
        own = marked.select("_row", F.explode(F.array_distinct(X.marked_words(F.col("_marked")))).alias("word"))
        fixes = (
            own.join(vocabulary, "word")
            .groupBy("_row")
            .agg(F.map_from_entries(F.collect_list(F.struct("word", "keyword"))).alias("_fixes"))
        )
        marked = marked.join(fixes, "_row", "left")
        healed = X.rebuild(F.col("_marked"), lambda w: F.element_at(F.col("_fixes"), w))
    done = let(healed, lambda h: X.finish(X.heal_numbers(h)))
    return marked.withColumn(out, done).drop("_marked", "_fixes", "_row")


def once(df: DataFrame, texts: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with what ``make`` adds to a table of its distinct ``texts``, each read once however often it is printed.

    ``make`` must be a pure function of these columns.  Duplicates fold on the map side; where the distinct texts are
    few, Spark broadcasts the results and the rows stay where they are, else both sides meet by shuffle.
    """
    done = written(make(written(df.select(*texts).distinct())))
    keys = [f"_once{i}" for i in range(len(texts))]
    done = done.withColumnsRenamed(dict(zip(texts, keys)))
    same = [df[t].eqNullSafe(done[k]) for t, k in zip(texts, keys)]
    return df.join(done, same).drop(*keys)
