"""Field extraction on measured, mangled label strings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelwise.functions import parse as P
from labelwise.operators.clean import clean_corpus, clean_text

AS_OF = dt.date(2026, 6, 30)
D = dt.date

CASES = [
    ("dates", "USEBY:10/11/2026", {"expiry": D(2026, 11, 10), "packed": None}),
    ("dates", "PKD12/08/2026", {"packed": D(2026, 8, 12), "expiry": None}),
    ("dates", "PKD 12/08/2026 USE BY 10/11/2026",
     {"packed": D(2026, 8, 12), "expiry": D(2026, 11, 10), "is_compliant": True}),
    ("dates", "MFG 01JUN2026", {"packed": D(2026, 6, 1)}),
    ("dates", "No text detected", {"is_compliant": False, "packed": None}),
    ("dates", "04/05.26 13/05.27 MFG.DATF USE BY UE",
     {"packed": D(2026, 5, 4), "expiry": D(2027, 5, 13)}),
    ("dates", "30 JUL 2026 JAN 2028 MFD USEBY",
     {"packed": D(2026, 7, 30), "expiry": D(2028, 1, 1)}),
    ("dates", "&Use ByDate: 65.55 06 Mfd., 05.59", {"packed": None, "is_compliant": False}),
    ("dates", "BEFORE18MONTHSFROMMANUFACTURE",
     {"best_before_raw": "18MONTHSFROMMANUFACTURE", "is_compliant": True}),
    ("dates", "NET 6 MONTHS", {"best_before_raw": None}),
    ("dates", "12/08/2026 10/11/2026",
     {"unlabelled": [D(2026, 8, 12), D(2026, 11, 10)], "is_compliant": False}),
    ("dates", "PKD 31/02/2026", {"packed": None}),
    ("dates", "PKD 2026-06-20", {"packed": D(2026, 6, 20), "unlabelled": []}),
    ("quantity", "Net Wt. 200 g", {"value": 200.0, "unit": "g"}),
    ("quantity", "NET QUANTITY 1 kg", {"value": 1.0, "unit": "kg"}),
    ("quantity", "500ml", {"value": 500.0, "unit": "ml"}),
    ("quantity", "Net Wt 200 gms", {"is_compliant": False}),
    ("quantity", "Net Wt. 5OOml", {"value": 500.0, "unit": "ml", "is_compliant": True}),
    ("quantity", "Net wt 1OOg", {"value": 100.0, "unit": "g", "is_compliant": True}),
    ("quantity", "NETWEIGHT150g", {"value": 150.0, "unit": "g", "is_compliant": True}),
    ("quantity", "NETWEIGHT: 70 6 NEIGHT", {"value": 70.0, "unit": "g", "is_compliant": True}),
    ("quantity", "NET 100 6", {"unit": "g"}),
    ("quantity", "Net wt. 200 8", {"unit": "g"}),
    ("quantity", "1006", {"unit": None, "is_compliant": False}),
    ("quantity", "6 x 50 g", {"value": 300.0, "unit": "g", "is_compliant": True}),
    ("quantity", "300 g (6 x 50 g)", {"value": 300.0, "is_compliant": True}),
    ("quantity", "250 g (6 x 50 g)", {"value": 250.0, "is_compliant": False}),
    ("price", "MRP Rs. 29.00 (Inclusive of all Taxes)", {"mrp": 29.0, "is_compliant": True}),
    ("price", "MRP Rs. 29.00", {"mrp": 29.0, "is_compliant": False}),
    ("price", "VRP Rs.48- IINCL OF ALL TAXES! UNTSALEPRICE:",
     {"tax_clause": "inclusive of all taxes", "is_compliant": True}),
    ("price", "MRP: (nclofltaxes) 1 55 USP:E Rs 70 P m1",
     {"tax_clause": "of all taxes", "is_compliant": True}),
    ("price", 'taxes "MPP 20.00 USP Uinc.ofal Batoh',
     {"tax_clause": "incl. taxes", "is_compliant": True}),
    ("price", "(Incl. of all USP SD 20.00", {"tax_clause": "incl. of all", "is_compliant": True}),
    ("price", "taxes) (incl. of all 6 er Pe Rs.0.35 MRP 00 160 Rs.", {"tax_clause": "incl. taxes"}),
    ("price", "MRP Rs.185.00 (incl.of alltaxes) USP Rs.74/100g",
     {"mrp": 185.0, "unit_sale_price": 74.0, "usp_unit": "g"}),
    ("price", "MRP (Incl. of all.TAXES) Rs 140 00 (Rs 0 80/9",
     {"mrp": 140.0, "unit_sale_price": 0.8}),
    ("price", "(incl. of all taxes) USP 0.52/9 MRP 104 00",
     {"mrp": 104.0, "unit_sale_price": 0.52}),
    ("price", "(ind. ofalltaxes) R 00 MRP Rs.", {"mrp": 0.0, "is_compliant": False}),
    ("maker", "MKTD.BY:HINDUSTAN UNILEVER LTD.,MUMBAI-400 099",
     {"maker_type": "marketed_by", "is_compliant": True}),
    ("maker", "Repacked &Mktd.by: HARIMA FOODS, chennai-600 131",
     {"maker_type": "marketed_by", "is_compliant": True}),
    ("maker", "MFG/MKT BY HINDUSTAN COCA-COLA BEVERAGES, GURUGRAM-122 011",
     {"maker_type": "marketed_by", "is_compliant": True}),
    ("maker", "Imported by ACME TRADERS, DELHI-110 001",
     {"maker_type": "imported_by", "is_compliant": True}),
    ("maker", "Packed by ACME FOODS, Pune 411001",
     {"maker_type": "packed_by", "is_compliant": True}),
    ("maker", "Manufactured and Marketed by ZYDUS WELLNESS, AHMEDABAD-382 481",
     {"maker_type": "manufactured_and_marketed_by", "is_compliant": True}),
    ("maker", "Md.byReck Benckiserld, GURGAON-122 002",
     {"maker_type": "manufactured_by", "is_compliant": True}),
    ("maker", "MKT BYPASS ROAD, PUNE 411001", {"maker_type": None, "is_compliant": False}),
    ("maker", "HINDUSTAN FOODS LTD, NASHIK-422 403 MFD BY",
     {"pincode": "422403", "maker_name": "HINDUSTAN FOODS LTD, NASHIK-422 403"}),
    ("maker", "Packed by ACME FOODS, Plot No: 50, Industrial Area, Pune 411001",
     {"maker_name": "ACME FOODS, Plot No: 50, Industrial Area, Pune"}),
    ("maker", "ACME FOODS, NASHIK-422 403", {"pincode": "422403", "is_compliant": False}),
    ("contact", "FSSAI Lic No. 100 12 043 000 123 care@acme.com 1800 123 4567",
     {"licence": "10012043000123", "is_compliant": True}),
    ("contact", "F8SAILcNa100140210012590 care@acme.com 18001234567",
     {"licence": "10014021001259"}),
    ("contact", "123456789012345678 care@acme.com 18001234567", {"licence": None}),
    ("contact", "care@tataconsumer.com 1800 123 4567", {"email": "care@tataconsumer.com"}),
    ("batch", "Batch No. A21 09:45 MFD 12/08/2026",
     {"batch_number": "A21", "time": "09:45", "is_compliant": True}),
    ("batch", "B.N. XJ-7781", {"batch_number": "XJ-7781"}),
    ("batch", "nothing here", {"batch_number": None, "is_compliant": False}),
    ("product_name", "Product Name: Gram Flour", {"name": "Gram Flour", "is_compliant": True}),
    ("product_name", "12 / 34", {"is_compliant": False}),
]

CLEAN = [
    ("NET QUANTITY 1 kg", "NET QUANTITY 1 kg"),
    ("500ml", "500ml"),
    ("5OOml", "500ml"),
    ("1OOg", "100g"),
    ("1Okg", "10kg"),
    ("care@tataconsumer.com", "care@tataconsumer.com"),
    ("trur| CARE care@acme.com", "OUR, CARE care@acme.com"),
    ("trur| CARE", "OUR, CARE"),
    ("t0 v5: 1800 123 4567", "to US: 1800 123 4567"),
    ("NET WEIGHT 2OO9", "NET WEIGHT 2009"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, name, text) for i, (name, text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, name string, text string")
    c = clean_text(F.col("text"))
    parsers = {
        "quantity": P.quantity, "price": P.price, "batch": P.batch, "maker": P.maker,
        "contact": P.contact, "product_name": P.product_name,
        "dates": lambda t: P.dates(t, AS_OF),
    }
    out = df.withColumn("clean", c)
    for name, fn in parsers.items():
        out = out.withColumn(name, F.when(F.col("name") == name, fn(F.col("clean"))))
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fields(parsed, i):
    name, text, expected = CASES[i]
    row = parsed[i]
    got = row[name].asDict(recursive=True)
    assert {k: got[k] for k in expected} == expected, (text, row["clean"], got)


def test_clean_both_ways(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "i int, t string")
    inline = {r.i: r.c for r in df.select("i", clean_text(F.col("t")).alias("c")).collect()}
    corpus = {r.i: r.clean for r in clean_corpus(df, ["i"], "t").collect()}
    want = {i: w for i, (_, w) in enumerate(CLEAN)}
    assert inline == want
    assert corpus == want


def test_corpus_matches_inline_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(8)
    both = clean_corpus(docs, ["doc_id"], "text").withColumn("inline", clean_text(F.col("text")))
    rows = both.select("clean", "inline").collect()
    assert rows and all(r.clean == r.inline for r in rows)


def test_licence_may_come_from_another_region(spark):
    df = spark.createDataFrame([("care@acme.com 1800 123 4567", "FSSAI 10012043000123")], "a string, b string")
    wide = clean_text(F.concat_ws(" ", clean_text(F.col("a")), F.col("b")))
    row = df.select(P.contact(clean_text(F.col("a")), wide).alias("r")).first().r
    assert row.is_compliant and row.licence == "10012043000123"
