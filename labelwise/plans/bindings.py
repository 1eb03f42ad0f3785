"""The given tables read as the engine's own inputs.

Every binding has a DataFrame form and the same thing as a SQL common table
expression, so queries and oracles start from equal rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwise.functions import fixed as K

AS_OF = dt.date(1998, 6, 30)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- workflow ---------------------------------------------------------------

USERS_SELECT = """
  SELECT c_custkey AS user_id, c_name AS username,
    CASE WHEN c_custkey % 50 = 0 THEN 'Admin' WHEN c_custkey % 10 = 1 THEN 'Verifier'
         ELSE 'Inspector' END AS role,
    c_acctbal > 0 AS active
  FROM customer"""
SCANS_SELECT = """
  SELECT o_orderkey AS scan_id, o_custkey AS inspector_id,
    CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'APPROVED' ELSE 'OVERRIDDEN' END AS status,
    o_orderdate AS ts, o_orderpriority AS product_name,
    concat('note ', CAST(o_orderkey % 97 AS STRING)) AS evidence_notes,
    CASE o_orderkey % 4
      WHEN 0 THEN '' WHEN 1 THEN concat('["img/', CAST(o_orderkey AS STRING), '.jpg"]')
      WHEN 2 THEN concat('img/', CAST(o_orderkey AS STRING), '.jpg, img/back.jpg,')
      ELSE '["a.jpg", " ", "c.jpg"]' END AS image_paths
  FROM orders"""
RESULT_ID = (
    "(l_orderkey * 8 + l_linenumber) * 4999999 + CAST(round(l_extendedprice * 100) AS BIGINT) % 4999999"
)
RULE_CASE = (
    "CASE l_linenumber "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(K.RULE_CLASSES[:6], 1))
    + f" ELSE '{K.RULE_CLASSES[6]}' END"
)
RESULTS_SELECT = f"""
  SELECT {RESULT_ID} AS result_id, l_orderkey AS scan_id, {RULE_CASE} AS rule_class,
    l_linestatus AS extracted_text, l_returnflag <> 'R' AS is_compliant,
    CAST(l_quantity * 500 AS INT) AS penalty_amount, l_returnflag AS reason
  FROM lineitem"""
FRAMES_SELECT = """
  SELECT CAST(user_id AS STRING) AS cam, ts, event_id AS seq, value * 4 AS sharpness,
    CASE WHEN k % 3 = 0 THEN 480 ELSE 1280 END AS width, 720 AS height, k % 8 AS n_det,
    CASE WHEN k = 99 AND event_type = 'error' THEN 'detector lost' END AS det_error
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e"""
LOG_SELECT = """
  SELECT CASE WHEN event_type = 'signup' THEN 'image_done' ELSE 'detection' END AS record_type,
    concat('img/', CAST(user_id AS STRING), '.jpg') AS image_path, k % 5 AS detection_index,
    event_id AS ln,
    CASE event_type WHEN 'click' THEN 'net_quantity' WHEN 'view' THEN 'mrp_declaration'
      WHEN 'purchase' THEN 'date_declarations' ELSE 'dietary_symbol' END AS canonical_class,
    CASE WHEN k % 7 = 0 THEN '' ELSE concat('Net Wt. ', CAST(k AS STRING), ' g') END AS ocr_text,
    CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 100 END AS ocr_confidence,
    CASE WHEN k = 13 THEN 'engine stopped' END AS ocr_error,
    CASE WHEN k % 2 = 0 THEN 'easyocr' ELSE 'rapidocr' END AS ocr_engine,
    value AS seconds, k % 4 AS crops
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e"""

_CTE = {
    "users": USERS_SELECT, "scans": SCANS_SELECT, "results": RESULTS_SELECT,
    "frames": FRAMES_SELECT, "log": LOG_SELECT,
}
_TABLES = {"users": "customer", "scans": "orders", "results": "lineitem", "frames": "events", "log": "events"}


def bound(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of users, scans, results, frames, log."""
    source = _TABLES[name]
    df = table(spark, sf, source)
    return spark.sql(_CTE[name].replace(f"FROM {source}", "FROM {src}"), src=df)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their visible classes and a zoned timestamp."""
    required = F.array(*[F.lit(c) for c in K.REGION_CLASSES])
    return (
        bound(spark, sf, "frames")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("classes", F.slice(required, F.lit(1), F.col("n_det")))
        .withColumn("ocr", F.lit(None))
        .drop("ocr")
    )


def with_cte(names: str, query: str) -> str:
    """Oracle SQL over the named bindings."""
    parts = ", ".join(f"{n} AS ({_CTE[n]})" for n in names.split())
    return f"WITH RECURSIVE {parts}\n{query}"


# --- label text composed from structured columns ----------------------------

# One reading per line item; its class follows the line number, noise the part key.
READING_CTE = f"""
  SELECT CAST(l_orderkey AS STRING) AS image, l_linenumber - 1 AS detection_index,
    {RESULT_ID} AS ln, l_linenumber AS n, l_partkey AS k,
    CASE l_linenumber
      WHEN 1 THEN 'product_name' WHEN 2 THEN 'net_quantity' WHEN 3 THEN 'mrp_declaration'
      WHEN 4 THEN 'date_declarations' WHEN 5 THEN 'batch_number'
      WHEN 6 THEN 'manufacturer_details' ELSE 'consumer_care_fssai' END AS class,
    CASE l_linenumber
      WHEN 1 THEN concat('Product Name: ', p_name)
      WHEN 2 THEN concat('Net Wt. ', CAST(CAST(l_quantity AS INT) AS STRING),
                         CASE WHEN l_partkey % 7 = 0 THEN ' gms' ELSE ' g' END)
      WHEN 3 THEN concat('MRP Rs. ', {{price}},
                         CASE WHEN l_partkey % 5 = 0 THEN ' only' ELSE ' (inclusive of all taxes)' END)
      WHEN 4 THEN concat(CASE WHEN l_partkey % 6 = 0 THEN 'dt ' ELSE 'PKD ' END, {{date}})
      WHEN 5 THEN concat('Batch No. B', CAST(l_suppkey AS STRING), 'X', CAST(l_partkey AS STRING))
      WHEN 6 THEN concat('Packed by Acme Foods, Pune ', CAST(411001 + l_suppkey % 900 AS STRING))
      ELSE concat(CASE WHEN l_partkey % 4 = 0 THEN 'call ' ELSE 'FSSAI 10012043000123 ' END,
                  'care@acme.com 1800 123 ', CAST(1000 + l_partkey % 9000 AS STRING)) END AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of packs: image is the order, class the line number."""
    sql = READING_CTE.format(
        price="format_string('%.2f', p_retailprice)", date="date_format(l_shipdate, 'dd/MM/yyyy')"
    ).replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}")
    return spark.sql(sql, lineitem=table(spark, sf, "lineitem"), part=table(spark, sf, "part"))


def readings_cte() -> str:
    return READING_CTE.format(
        price="printf('%.2f', p_retailprice)", date="strftime(l_shipdate, '%d/%m/%Y')"
    )


# --- readings from conversations --------------------------------------------

CANDIDATE_SELECT = """
  SELECT conv_id AS image, turn // 3 AS det_idx, turn % 3 AS variant_ord,
    CASE turn % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'dotmatrix' ELSE 'enhanced' END AS variant,
    text, CAST(length(text) % 100 AS DOUBLE) / 100 AS conf, length(text) % 5 = 0 AS compliant,
    CAST(length(text) % 7 AS DOUBLE) / 7 AS signal, CAST(length(text) AS DOUBLE) / 1000 AS seconds
  FROM conversations"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    sql = CANDIDATE_SELECT.replace("turn // 3", "CAST(floor(turn / 3) AS BIGINT)")
    return spark.sql(sql.replace("FROM conversations", "FROM {src}"), src=table(spark, sf, "conversations"))


# --- label rows from embeddings ---------------------------------------------


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Box and polygon rows cut from whole embeddings, value after value, one file per label.

    The rows of every third vector are polygons in files whose label is not a multiple of 3;
    those of every eleventh are neither.
    """
    e = table(spark, sf, "embeddings")
    n = (
        F.when(F.col("vec_id") % 11 == 0, 3)
        .when((F.col("vec_id") % 3 == 0) & (F.col("label") % 3 != 0), 8)
        .otherwise(4)
    )
    e = e.withColumn("n", n)
    e = e.withColumn("k", F.explode(F.expr("sequence(0, int((size(embedding) - 1) div n))")))
    scaled = F.transform(F.expr("slice(embedding, k * n + 1, n)"), lambda v: F.round(v.cast("double") * 0.8 + 0.5, 6))
    return e.select(
        F.when(F.col("label") % 4 == 0, "valid").when(F.col("label") % 4 == 1, "test").otherwise("train").alias("split"),
        F.concat(F.lit("f"), F.col("label").cast("string"), F.lit(".txt")).alias("file"),
        (F.col("vec_id") * 32 + F.col("k") + 1).alias("line"),
        (F.col("vec_id") % 8).cast("int").alias("class_id"),
        scaled.alias("vals"),
    ).withColumn(
        "raw",
        F.concat_ws(" ", F.col("class_id").cast("string"),
                    F.array_join(F.transform("vals", lambda v: F.format_string("%.6f", v)), " ")),
    )


LABEL_CTE = """
  vecs AS (
    SELECT *, CASE WHEN vec_id % 11 = 0 THEN 3 WHEN vec_id % 3 = 0 AND label % 3 <> 0 THEN 8 ELSE 4 END AS step FROM embeddings),
  rows AS (SELECT *, unnest(range(0, len(embedding), step)) AS start FROM vecs),
  base AS (
    SELECT vec_id, label, embedding[start + 1:start + step] AS embedding,
      CASE WHEN label % 4 = 0 THEN 'valid' WHEN label % 4 = 1 THEN 'test' ELSE 'train' END AS split,
      concat('f', CAST(label AS VARCHAR), '.txt') AS file, vec_id * 32 + start // step + 1 AS line,
      CAST(vec_id % 8 AS INTEGER) AS class_id,
      len(embedding[start + 1:start + step]) AS n
    FROM rows),
  vals AS (
    SELECT *, list_transform(embedding[1:n], lambda v: round(CAST(v AS DOUBLE) * 0.8 + 0.5, 6)) AS v,
      max(n) OVER (PARTITION BY split, file) + 1 > 6 AS seg FROM base),
  cor AS (
    SELECT *,
      CASE WHEN n = 4 THEN greatest(0, least(1, v[1] - v[3] / 2))
           WHEN n = 8 THEN greatest(0, least(1, list_min([v[1], v[3], v[5], v[7]]))) END AS ax1,
      CASE WHEN n = 4 THEN greatest(0, least(1, v[1] + v[3] / 2))
           WHEN n = 8 THEN greatest(0, least(1, list_max([v[1], v[3], v[5], v[7]]))) END AS ax2,
      CASE WHEN n = 4 THEN greatest(0, least(1, v[2] - v[4] / 2))
           WHEN n = 8 THEN greatest(0, least(1, list_min([v[2], v[4], v[6], v[8]]))) END AS ay1,
      CASE WHEN n = 4 THEN greatest(0, least(1, v[2] + v[4] / 2))
           WHEN n = 8 THEN greatest(0, least(1, list_max([v[2], v[4], v[6], v[8]]))) END AS ay2,
      CASE WHEN seg AND n = 4 THEN greatest(0, least(1, least(v[1], v[3]))) END AS sx1,
      CASE WHEN seg AND n = 4 THEN greatest(0, least(1, greatest(v[1], v[3]))) END AS sx2,
      CASE WHEN seg AND n = 4 THEN greatest(0, least(1, least(v[2], v[4]))) END AS sy1,
      CASE WHEN seg AND n = 4 THEN greatest(0, least(1, greatest(v[2], v[4]))) END AS sy2
    FROM vals),
  lab AS (
    SELECT *, coalesce(sx1, ax1) AS tx1, coalesce(sx2, ax2) AS tx2, coalesce(sy1, ay1) AS ty1,
      coalesce(sy2, ay2) AS ty2 FROM cor),
  ov AS (
    SELECT *, greatest(0, least(ax2, tx2) - greatest(ax1, tx1)) * greatest(0, least(ay2, ty2) - greatest(ay1, ty1)) AS i,
      (ax2 - ax1) * (ay2 - ay1) AS aa, (tx2 - tx1) * (ty2 - ty1) AS ta FROM lab),
  lb AS (
    SELECT *, CASE WHEN ax1 IS NULL THEN NULL WHEN aa + ta - i > 0 THEN i / (aa + ta - i) ELSE 0.0 END AS iou FROM ov),
  l AS (
    SELECT *, ax1 IS NOT NULL AND iou <= 0.99 AS corrupted, (1 - iou) * greatest(aa, ta) AS damage,
      coalesce(least(ax2 - ax1, ay2 - ay1) < 0.008, false) AS tiny FROM lb)"""
