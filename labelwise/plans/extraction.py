"""Round-trip extraction queries: label text is composed from columns and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import parse as P
from labelwise.functions import spans as S
from labelwise.operators import spanjoin as J
from labelwise.operators.clean import clean_corpus, once
from labelwise.operators.extract import validate_scans
from labelwise.plans import bindings as B
from labelwise.plans.bindings import table
from labelwise.session import written

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def composed(spark, sf, sql: str, *names: str) -> DataFrame:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})


def read(df: DataFrame, key: str, parser) -> DataFrame:
    """Clean the composed text and parse it, equal texts once."""
    parsed = lambda texts: clean_corpus(texts, ["text"], "text").select("text", parser(F.col("clean")).alias("r"))
    return once(df, ["text"], parsed).select(key, "r")


QTY = f"""SELECT {B.RESULT_ID} AS id, CASE l_partkey % 5
    WHEN 0 THEN concat('Net Wt. ', CAST(CAST(l_quantity AS INT) AS STRING), ' g')
    WHEN 1 THEN concat('NETWEIGHT', CAST(CAST(l_quantity AS INT) AS STRING), 'kg')
    WHEN 2 THEN concat('Net Wt ', CAST(CAST(l_quantity AS INT) AS STRING), ' gms')
    WHEN 3 THEN concat('Net ', CAST(CAST(l_quantity AS INT) AS STRING), 'OOml')
    ELSE concat('6 x ', CAST(CAST(l_quantity AS INT) AS STRING), ' g') END AS text FROM lineitem"""


@query("extract_quantity", f"""SELECT {B.RESULT_ID} AS id,
    CASE l_partkey % 5 WHEN 3 THEN l_quantity * 100 WHEN 4 THEN l_quantity * 6 ELSE l_quantity END AS value,
    CASE l_partkey % 5 WHEN 1 THEN 'kg' WHEN 2 THEN NULL WHEN 3 THEN 'ml' ELSE 'g' END AS unit,
    CASE WHEN l_partkey % 5 = 4 THEN l_quantity END AS pack_weight, l_partkey % 5 <> 2 AS is_compliant FROM lineitem""")
def extract_quantity(spark, sf):
    r = read(composed(spark, sf, QTY, "lineitem"), "id", P.quantity)
    return r.select("id", "r.value", "r.unit", F.col("r.multipack.unit_weight").alias("pack_weight"), "r.is_compliant")


PRICE = """SELECT p_partkey AS id, CASE p_partkey % 4
    WHEN 0 THEN concat('MRP Rs. ', format_string('%.2f', p_retailprice), ' (inclusive of all taxes)')
    WHEN 1 THEN concat('MRP Rs.', format_string('%.2f', p_retailprice), ' (incl.of alltaxes) USP Rs.', CAST(p_size + 10 AS STRING), '/100g')
    WHEN 2 THEN concat('MRP Rs. ', format_string('%.2f', p_retailprice))
    ELSE concat('taxes) (incl. of all MRP Rs ', replace(format_string('%.2f', p_retailprice), '.', ' ')) END AS text FROM part"""


@query("extract_price", """SELECT p_partkey AS id, round(p_retailprice, 2) AS mrp,
    CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size + 10 AS DOUBLE) END AS unit_sale_price,
    CASE p_partkey % 4 WHEN 0 THEN 'inclusive of all taxes' WHEN 1 THEN 'of all taxes'
      WHEN 2 THEN NULL ELSE 'incl. taxes' END AS tax_clause, p_partkey % 4 <> 2 AS is_compliant FROM part""")
def extract_price(spark, sf):
    r = read(composed(spark, sf, PRICE, "part"), "id", P.price)
    return r.select("id", "r.mrp", "r.unit_sale_price", "r.tax_clause", "r.is_compliant")


DATES = f"""SELECT {B.RESULT_ID} AS id, CASE l_partkey % 6
    WHEN 0 THEN concat('PKD', date_format(l_shipdate, 'dd/MM/yyyy'))
    WHEN 1 THEN concat('USEBY:', date_format(l_shipdate, 'dd.MM.yyyy'))
    WHEN 2 THEN date_format(l_shipdate, 'dd/MM/yyyy')
    WHEN 3 THEN concat('MFG ', upper(date_format(l_shipdate, 'dd MMM yyyy')))
    WHEN 4 THEN concat(date_format(l_shipdate, 'yyyy-MM-dd'), ' ', date_format(date_add(CAST(l_shipdate AS DATE), 180), 'dd/MM/yy'), ' MFD USE BY')
    ELSE concat('BEST BEFORE ', CAST(CAST(l_quantity AS INT) AS STRING), ' MONTHS FROM MFD') END AS text FROM lineitem"""


@query("extract_dates", f"""SELECT {B.RESULT_ID} AS id,
    CASE WHEN l_partkey % 6 IN (0, 3, 4) THEN strftime(l_shipdate, '%Y-%m-%d') END AS packed,
    CASE l_partkey % 6 WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
      WHEN 4 THEN strftime(l_shipdate + INTERVAL 180 DAY, '%Y-%m-%d') END AS expiry,
    CASE WHEN l_partkey % 6 = 2 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS unlabelled,
    CASE WHEN l_partkey % 6 = 5 THEN concat(CAST(l_quantity AS INTEGER), ' MONTHS FROM MFD') END AS best_before,
    l_partkey % 6 <> 2 AS is_compliant FROM lineitem""")
def extract_dates(spark, sf):
    r = read(composed(spark, sf, DATES, "lineitem"), "id", lambda c: P.dates(c, B.AS_OF))
    loose = F.array_join(F.transform("r.unlabelled", lambda d: d.cast("string")), ",")
    return r.select(
        "id", F.col("r.packed").cast("string").alias("packed"), F.col("r.expiry").cast("string").alias("expiry"),
        loose.alias("unlabelled"), F.col("r.best_before_raw").alias("best_before"), "r.is_compliant",
    )


BATCH = f"""SELECT {B.RESULT_ID} AS id, concat(CASE WHEN l_partkey % 2 = 0 THEN 'Batch No. B' ELSE 'Lot: B' END,
    CAST(l_suppkey AS STRING), 'X', CAST(l_partkey AS STRING), CASE WHEN l_partkey % 3 = 0 THEN ' 09:45' ELSE '' END,
    ' MFD ', date_format(l_shipdate, 'dd/MM/yyyy')) AS text FROM lineitem"""


@query("extract_batch", f"""SELECT {B.RESULT_ID} AS id, concat('B', l_suppkey, 'X', l_partkey) AS batch_number,
    CASE WHEN l_partkey % 3 = 0 THEN '09:45' END AS time, true AS is_compliant FROM lineitem""")
def extract_batch(spark, sf):
    r = read(composed(spark, sf, BATCH, "lineitem"), "id", P.batch)
    return r.select("id", "r.batch_number", "r.time", "r.is_compliant")


MAKER = """SELECT c_custkey AS id, concat(CASE c_custkey % 4 WHEN 0 THEN 'Packed by ' WHEN 1 THEN 'MKTD.BY:'
    WHEN 2 THEN 'Imported by ' ELSE '' END, 'Acme Foods, ', 'Plot ', CAST(c_custkey AS STRING), 'A Pune-',
    CAST(411001 + c_custkey % 900 AS STRING), CASE WHEN c_custkey % 4 = 3 THEN ' MFD BY' ELSE '' END) AS text FROM customer"""


@query("extract_maker", """SELECT c_custkey AS id, CAST(411001 + c_custkey % 900 AS VARCHAR) AS pincode,
    CASE c_custkey % 4 WHEN 0 THEN 'packed_by' WHEN 1 THEN 'marketed_by' WHEN 2 THEN 'imported_by'
      ELSE 'manufactured_by' END AS maker_type, true AS is_compliant FROM customer""")
def extract_maker(spark, sf):
    r = read(composed(spark, sf, MAKER, "customer"), "id", P.maker)
    return r.select("id", "r.pincode", "r.maker_type", "r.is_compliant")


CARE = """SELECT c_custkey AS id, concat(CASE c_custkey % 3 WHEN 0 THEN 'FSSAI Lic No. 100 12 043 0' ELSE 'FSSAI 10012' END,
    CASE c_custkey % 3 WHEN 0 THEN format_string('%05d', c_custkey) ELSE format_string('%09d', c_custkey) END,
    CASE WHEN c_custkey % 5 = 0 THEN ' write to care @ acme.com' ELSE ' care@acme.com' END,
    CASE WHEN c_custkey % 2 = 0 THEN ' 1800 123 ' ELSE ' +91 98765 4' END, format_string('%04d', c_custkey % 10000)) AS text FROM customer"""


@query("extract_contact", """SELECT c_custkey AS id,
    CASE c_custkey % 3 WHEN 0 THEN concat('100120430', printf('%05d', c_custkey)) ELSE concat('10012', printf('%09d', c_custkey)) END AS licence,
    'care@acme.com' AS email,
    CASE WHEN c_custkey % 2 = 0 THEN concat('1800123', printf('%04d', c_custkey % 10000))
      ELSE concat('987654', printf('%04d', c_custkey % 10000)) END AS helpline, true AS is_compliant FROM customer""")
def extract_contact(spark, sf):
    r = read(composed(spark, sf, CARE, "customer"), "id", P.contact)
    return r.select("id", "r.licence", "r.email", "r.helpline", "r.is_compliant")


@query("extract_name", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name,
    p_partkey % 3 <> 0 AS is_compliant FROM part""")
def extract_name(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, "Product Name: ").when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("Product Name: "), "p_name")).otherwise(F.concat(F.lit("Brand - "), "p_name"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), "p_name")
    r = parts.select("id", P.product_name(F.col("text")).alias("r"))
    return r.select("id", F.coalesce("r.name", F.lit("")).alias("name"), "r.is_compliant")


@query("extract_contact_documents", None)
def extract_contact_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    # whole documents are not worth a shuffle
    r = clean_corpus(docs, ["id"], "text").select("id", P.contact(F.col("clean")).alias("r"))
    return r.select("id", "r.licence", "r.email", "r.helpline", "r.is_compliant")


@query("dietary_rows", """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'VEG' WHEN 'view' THEN 'NON_VEG'
    WHEN 'error' THEN 'UNCERTAIN' ELSE 'NOT_DETECTED' END AS dietary_status, event_type IN ('click', 'view') AS is_compliant,
    0 AS penalty_amount FROM events""")
def dietary_rows(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "click", "veg").when(t == "view", "NON_VEG").when(t == "error", "Uncertain").when(t == "signup", "banana")
    r = table(spark, sf, "events").select(F.col("event_id").alias("id"), P.dietary(status).alias("r"))
    return r.select("id", "r.dietary_status", "r.is_compliant", "r.penalty_amount")


VERDICT_CTE = f"""WITH r AS ({B.readings_cte()}),
  f AS (SELECT image, class, min(n) AS n, arg_min(k, ln) AS k FROM r GROUP BY image, class),
  v AS (SELECT image AS scan_id, CASE class WHEN 'mrp_declaration' THEN 'pricing' WHEN 'date_declarations' THEN 'dates'
      WHEN 'batch_number' THEN 'batch_details' WHEN 'manufacturer_details' THEN 'manufacturer_info'
      WHEN 'consumer_care_fssai' THEN 'compliance_and_support' ELSE class END AS rule_class,
    CASE class WHEN 'net_quantity' THEN k % 7 <> 0 WHEN 'mrp_declaration' THEN k % 5 <> 0
      WHEN 'date_declarations' THEN k % 6 <> 0 WHEN 'consumer_care_fssai' THEN k % 4 <> 0 ELSE true END AS ok FROM f),
  c(rule_class) AS (VALUES {", ".join(f"('{c}')" for c in K.RULE_CLASSES)})"""


@query("validate_scans", VERDICT_CTE + """
  SELECT i.scan_id, c.rule_class, CASE WHEN c.rule_class = 'dietary_mark' THEN CAST(i.scan_id AS BIGINT) % 2 = 0
      ELSE coalesce(v.ok, false) END AS is_compliant,
    CASE WHEN c.rule_class = 'dietary_mark' OR coalesce(v.ok, false) THEN 0 ELSE 25000 END AS penalty_amount
  FROM (SELECT DISTINCT scan_id FROM v) i CROSS JOIN c LEFT JOIN v ON v.scan_id = i.scan_id AND v.rule_class = c.rule_class""")
def validate(spark, sf):
    r = B.readings(spark, sf)
    # the first reading of each class; its region is named by the class itself
    first = r.groupBy("image", "class").agg(F.min("ln").alias("ord"), F.min_by("text", "ln").alias("text"))
    texts = first.select(F.col("image").alias("scan_id"), F.col("class").alias("region"), "ord", "text")
    marks = r.select(F.col("image").alias("scan_id")).distinct().withColumn(
        "dietary_status", F.when(F.col("scan_id").cast("long") % 2 == 0, "VEG"))
    return validate_scans(texts, marks, B.AS_OF).select("scan_id", "rule_class", "is_compliant", "penalty_amount")


# --- spans ------------------------------------------------------------------

MARKED = f"""SELECT {B.RESULT_ID} AS doc_id, concat('PKD ', date_format(l_shipdate, 'dd/MM/yyyy'), repeat('.', CAST(l_quantity AS INT) * 4),
    'EXP ', date_format(l_shipdate, 'dd/MM/yyyy')) AS text FROM lineitem"""
DATE_AT = r"\d{2}/\d{2}/\d{4}"


@query("match_spans", f"""SELECT {B.RESULT_ID} AS doc_id, 4 AS first_st, 14 AS first_en, 18 + CAST(l_quantity AS INTEGER) * 4 AS second_st,
    2 AS n FROM lineitem""")
def match_spans(spark, sf):
    docs = composed(spark, sf, MARKED, "lineitem")
    s = docs.select("doc_id", S.match_spans(F.col("text"), DATE_AT).alias("s"))
    return s.select(
        "doc_id", F.get("s", F.lit(0))["st"].alias("first_st"), F.get("s", F.lit(0))["en"].alias("first_en"),
        F.get("s", F.lit(1))["st"].alias("second_st"), F.size("s").alias("n"),
    )


@query("drop_overlaps", f"""SELECT {B.RESULT_ID} AS doc_id, CASE WHEN l_linenumber * 2 >= 5 THEN 2 ELSE 1 END AS kept FROM lineitem""")
def drop_overlaps(spark, sf):
    n = F.col("l_linenumber")

    def span(st, en):
        return F.struct(st.cast("int").alias("st"), en.cast("int").alias("en"))

    li = table(spark, sf, "lineitem").selectExpr(f"{B.RESULT_ID} AS doc_id", "l_linenumber")
    spans = F.array(span(n * 2, n * 2 + 3), span(F.lit(0), F.lit(5)), span(F.lit(0), F.lit(3)))
    return li.select("doc_id", F.size(S.drop_overlaps(spans)).alias("kept"))


def own_rows(docs: DataFrame) -> DataFrame:
    """``docs``, written, with their row as ``doc_id`` and that as ``id``: rows of one id are texts of their own."""
    return written(docs.withColumnRenamed("doc_id", "id").withColumn("doc_id", F.monotonically_increasing_id()))


def span_pair(spark, sf):
    docs = own_rows(composed(spark, sf, MARKED, "lineitem"))
    dates = J.span_table(docs, "doc_id", "text", DATE_AT, "date", also=["id"]).select("doc_id", "id", "st", "en")
    labels = J.span_tables(docs, "doc_id", "text", {"packed": "PKD", "expiry": "EXP"}, also=["id"])
    return docs, dates, labels


#: What tells the spans of one pattern apart.
SPAN_KEYS = ["doc_id", "st"]


@query("nearest_label", f"""SELECT {B.RESULT_ID} AS doc_id, 4 AS st, 'packed' AS kind, 1 AS gap FROM lineitem UNION ALL
  SELECT {B.RESULT_ID}, 18 + CAST(l_quantity AS INTEGER) * 4, 'expiry', 1 FROM lineitem""")
def nearest_label(spark, sf):
    _, dates, labels = span_pair(spark, sf)
    return J.nearest_span(dates, labels, K.PREFIX_REACH, SPAN_KEYS).select(
        F.col("id").alias("doc_id"), "st", F.col("label.kind").alias("kind"), "gap")


@query("within_reach", f"""SELECT {B.RESULT_ID} AS doc_id, 4 AS st FROM lineitem WHERE CAST(l_quantity AS INTEGER) * 4 <= 30 UNION ALL
  SELECT {B.RESULT_ID}, 18 + CAST(l_quantity AS INTEGER) * 4 FROM lineitem""")
def within_reach(spark, sf):
    _, dates, labels = span_pair(spark, sf)
    expiry = labels.where("kind = 'expiry'").select("doc_id", "st", "en")
    return J.within_reach(dates, expiry, K.ANCHOR_REACH, SPAN_KEYS).select(F.col("id").alias("doc_id"), "st")


@query("following_span", f"""SELECT {B.RESULT_ID} AS doc_id, 3 AS en, 4 AS run_st FROM lineitem UNION ALL
  SELECT {B.RESULT_ID}, 17 + CAST(l_quantity AS INTEGER) * 4, 18 + CAST(l_quantity AS INTEGER) * 4 FROM lineitem""")
def following_span(spark, sf):
    _, dates, labels = span_pair(spark, sf)
    anchors = labels.select("doc_id", "id", "st", "en")
    return J.following_span(anchors, dates.select("doc_id", "st", "en"), K.LICENCE_REACH, SPAN_KEYS).select(
        F.col("id").alias("doc_id"), "en", F.col("run.r_st").alias("run_st"))


RUNS = f"""SELECT {B.RESULT_ID} AS doc_id, concat('FSSAI', repeat('.', CAST(l_quantity AS INT) % 32), '1',
    CAST(l_orderkey + 1000000 AS STRING), repeat('7', CAST(l_partkey % 40 AS INT))) AS text FROM lineitem"""


@query("following_licences", f"""
  WITH t AS (SELECT {B.RESULT_ID} AS doc_id, CAST(l_quantity AS INT) % 32 AS dots,
      concat('1', CAST(l_orderkey + 1000000 AS VARCHAR), repeat('7', CAST(l_partkey % 40 AS INT))) AS digits FROM lineitem)
  SELECT doc_id, 5 + dots AS run_st, substr(digits, 1, 44 - dots) AS run FROM t
  WHERE dots <= 24 AND length(digits) >= 14 AND 44 - dots >= 14""")
def following_licences(spark, sf):
    """Runs of digits behind an anchor, cut where the window behind it ends."""
    docs = own_rows(composed(spark, sf, RUNS, "lineitem"))
    runs = J.span_table(docs, "doc_id", "text", K.LONG_DIGIT_RUN, "run")
    anchors = J.span_table(docs, "doc_id", "text", "FSSAI", "anchor", also=["id"])
    got = J.following_span(anchors.select("doc_id", "id", "st", "en"), runs.select("doc_id", "st", "en", "txt"), K.LICENCE_REACH, "doc_id", K.LICENCE_EXTRA, K.LONG_DIGIT_RUN)
    return got.select(F.col("id").alias("doc_id"), F.col("run.r_st").alias("run_st"), F.col("run.r_txt").alias("run"))


@query("nested_spans", """
  SELECT doc_id, CAST(len(list_filter(string_split(substr(text, 1, length(text) // 2), ' '), lambda w: length(w) > 0)) AS BIGINT) AS inside
  FROM documents WHERE length(text) // 2 > 0 AND len(list_filter(string_split(substr(text, 1, length(text) // 2), ' '), lambda w: length(w) > 0)) > 0""")
def nested_spans(spark, sf):
    """Words inside the first half of each whole text: short spans within spans of any length."""
    docs = table(spark, sf, "documents").select("doc_id", F.expr("substring(text, 1, length(text) div 2)").alias("half"), "text")
    words = J.span_table(docs.where("length(half) > 0"), "doc_id", "half", "[^ ]+", "word").select("doc_id", "st", "en", F.struct("doc_id", "st").alias("sid"))
    halves = docs.where("length(half) > 0").select("doc_id", F.lit(0).alias("st"), F.length("half").alias("en"))
    inside = J.contained_spans(words, halves, "sid")
    return inside.groupBy("doc_id").agg(F.count("*").alias("inside"))


@query("contained_spans", f"""SELECT {B.RESULT_ID} AS doc_id, 4 AS st FROM lineitem UNION ALL
  SELECT {B.RESULT_ID}, 18 + CAST(l_quantity AS INTEGER) * 4 FROM lineitem""")
def contained_spans(spark, sf):
    docs, dates, _ = span_pair(spark, sf)
    outer = J.span_table(docs, "doc_id", "text", r"(?:PKD|EXP) " + DATE_AT, "labelled")
    return J.contained_spans(dates, outer, SPAN_KEYS).select(F.col("id").alias("doc_id"), "st")


@query("overlapping_spans", f"""SELECT {B.RESULT_ID} AS doc_id, 4 AS st FROM lineitem""")
def overlapping_spans(spark, sf):
    docs, dates, _ = span_pair(spark, sf)
    head = J.span_table(docs, "doc_id", "text", r"^PKD \d{2}", "head")
    return J.overlapping_spans(dates, head, SPAN_KEYS).select(F.col("id").alias("doc_id"), "st")
