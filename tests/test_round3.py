"""Findings of the third review: each test failed before its change."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon


def equal_to_sql(spark, sf, name):
    """A query on the tables of ``sf`` against its SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, str(sf))
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), names)


@pytest.fixture(scope="session")
def twice(sf, tmp_path_factory):
    """The small tables with some line items twice, the second time with one more in quantity: equal ids, two texts."""
    root = tmp_path_factory.mktemp("twice")
    for t in TABLES:
        (root / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    (root / "lineitem.parquet").unlink()
    duckdb.execute(
        f"COPY (SELECT * FROM '{sf}/lineitem.parquet' UNION ALL SELECT * REPLACE (l_quantity + 1 AS l_quantity) "
        f"FROM '{sf}/lineitem.parquet' WHERE l_orderkey % 50 = 0) TO '{root}/lineitem.parquet' (FORMAT parquet)")
    return root


@pytest.mark.parametrize("name", ["contained_spans", "overlapping_spans", "nearest_label", "within_reach", "following_span", "following_licences"])
def test_rows_of_one_id_keep_their_own_spans(spark, twice, name):
    equal_to_sql(spark, twice, name)


@pytest.mark.parametrize("name", ["extract_dates", "parse_signal", "validate_scans", "digest"])
def test_equal_texts_are_read_once(spark, twice, name, monkeypatch):
    """The per-text work sees distinct texts only, and the rows are those of the SQL."""
    from labelwise.operators import clean, extract, sweep
    from labelwise.plans import extraction

    seen = []

    def watched(df, texts, make, once=clean.once):
        def noted(rows):
            seen.append((rows.count(), rows.distinct().count()))
            return make(rows)

        return once(df, texts, noted)

    for module in (clean, extract, sweep, extraction):
        monkeypatch.setattr(module, "once", watched)
    if name in ("extract_dates", "parse_signal"):
        equal_to_sql(spark, twice, name)
    else:
        entry.queries()[name](spark, str(twice)).count()
    assert seen and all(n == distinct for n, distinct in seen)


def test_every_group_that_a_parser_cannot_read_has_its_own_message(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from labelwise.functions import parse as P
    from labelwise.operators import sweep as W
    from labelwise.operators.extract import Telling

    log = spark.range(120).select(
        F.lit("detection").alias("record_type"), F.concat(F.lit("i"), "id").alias("image_path"), F.lit(1).alias("detection_index"),
        F.col("id").alias("ln"), F.lit("product_name").alias("canonical_class"),
        F.concat(F.when(F.col("id") < 110, "bad ").otherwise("Tea "), "id").alias("ocr_text"))
    parser = Telling(lambda clean, wide: P.product_name(clean), lambda clean, wide: F.when(F.lower(clean).startswith("bad"), clean))
    got = W.digest(log, dt.date(2024, 1, 1), {"product_name": parser}).collect()
    bad = [r for r in got if r.combined_text.startswith("bad")]
    assert len(got) == 120 and len({r.parser_error for r in bad}) == 110
    assert all(r.is_compliant is None and r.parsed is None for r in bad)
    assert all(r.parser_error is None and r.is_compliant for r in got if r not in bad)


def test_a_split_behind_an_empty_first_partition_has_one_empty_file(spark, sf, monkeypatch):
    from labelwise.plans import storage

    keep = storage.written  # one file a split, so every split lacks rows in some first partition
    monkeypatch.setattr(storage, "written", lambda df: keep(df.repartitionByRange(3, "split")))
    equal_to_sql(spark, sf, "label_files")


def test_a_word_is_scored_once_however_often_it_is_printed(spark, monkeypatch):
    from pyspark.sql import functions as F

    from labelwise.functions import text as X
    from labelwise.operators import clean

    scored = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(word):
        scored.add(1)
        return word.upper()

    monkeypatch.setattr(X, "heal_word", lambda word, checked=False: counted(word))
    words = spark.range(1000).select(F.concat(F.lit("w"), F.col("id") % 5).alias("word"))
    assert {tuple(r) for r in clean.heal_vocabulary(words).collect()} == {(f"w{k}", f"W{k}") for k in range(5)}
    assert scored.value <= 10


def test_many_small_keys_are_thinned_without_a_call_for_each(spark, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from labelwise.operators import ordering as O

    def refused(*args):
        raise AssertionError("a call for each key")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", refused)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")  # keys go on from one batch to the next
    try:
        key = F.when(F.col("id") % 40 != 3, F.col("id") % 40)  # the rows of one key are left out
        rows = O.ranked(spark.range(800).select(key.alias("k"), (F.col("id") * F.col("id") % 500).alias("t"), "id"), ["k"], ["t", "id"])
        got = O.thin(rows.where("k is not null"), ["k"], "t", 60).collect()
    finally:
        spark.conf.set(size, before)
    want, last = set(), {}
    for r in sorted(got, key=lambda r: (r.k, r.rn)):
        if r.k not in last or r.t >= last[r.k] + 60:
            last[r.k] = r.t
            want.add(r.id)
    assert len(got) == 780 and {r.id for r in got if r.accepted} == want
