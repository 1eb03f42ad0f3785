"""Source and sink queries: derived data is written in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwise.operators import labels as L
from labelwise.operators import policy as P
from labelwise.operators import reports as R
from labelwise.operators import review as V
from labelwise.operators import sweep as W
from labelwise.plans import bindings as B
from labelwise.plans import reading, workflow
from labelwise.plans.bindings import bound, table, with_cte
from labelwise.session import shared_dir, spread, written
from labelwise.sources import readers as S
from labelwise.sources import sinks as K

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query("sweep_log_round_trip", with_cte("log", """
  SELECT record_type, image_path, ln, coalesce(ocr_text, '') AS ocr_text FROM log"""))
def sweep_log_round_trip(spark, sf):
    path = shared_dir(spark, "log")
    K.write_sweep_log(bound(spark, sf, "log"), path)
    return S.read_sweep_log(spark, path).select(
        "record_type", "image_path", "ln", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"))


@query("torn_log_lines", with_cte("log", "SELECT record_type, image_path, ln FROM log WHERE ln % 7 <> 3"))
def torn_log_lines(spark, sf):
    """Every seventh line is cut in the middle; blank lines are mixed in."""
    path = shared_dir(spark, "torn")
    line = F.to_json(F.struct("record_type", "image_path", "ln"))
    torn = F.when(F.col("ln") % 7 == 3, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    blank = F.when(F.col("ln") % 5 == 0, F.concat(torn, F.lit("\n"))).otherwise(torn)
    bound(spark, sf, "log").select(blank.alias("value")).write.text(path)
    return S.read_sweep_log(spark, path).select("record_type", "image_path", "ln")


@query("log_line_numbers", with_cte("log", """
  SELECT row_number() OVER (ORDER BY ln) AS ln, image_path, CAST(ln AS INTEGER) AS crops FROM log"""))
def log_line_numbers(spark, sf):
    """A log of several files without line numbers, some lines torn: rows are numbered by their place."""
    path = shared_dir(spark, "unnumbered")
    line = F.to_json(F.struct("record_type", "image_path", F.col("ln").cast("int").alias("crops")))
    torn = F.when(F.col("ln") % 9 == 4, F.concat(line, F.lit("\n"), F.substring(line, 1, 30))).otherwise(line)
    log = bound(spark, sf, "log").repartitionByRange(5, "ln").sortWithinPartitions("ln")
    log.select(torn.alias("value")).write.text(path)
    return S.read_sweep_log(spark, path).select("ln", "image_path", "crops")


@query("image_done_markers", with_cte("log", """
  SELECT image_path, max(ln) + 1 AS ln, CAST(count(*) AS INTEGER) AS crops FROM log GROUP BY image_path"""))
def image_done_markers(spark, sf):
    log = bound(spark, sf, "log").withColumn("ocr_seconds", F.col("seconds"))
    return K.image_done(log).select("image_path", "ln", "crops")


@query("label_file_round_trip", f"""WITH {B.LABEL_CTE}
  SELECT split, file, row_number() OVER (PARTITION BY split, file ORDER BY line) AS line, class_id,
    CAST(n AS INTEGER) AS n_vals, round(v[1], 6) AS v1 FROM l""")
def label_file_round_trip(spark, sf):
    """Label files written one per source and parsed back."""
    rows = B.label_rows(spark, sf)
    texts = K.label_texts(rows.withColumn("kept", F.lit(True)).withColumn("fixed", F.col("raw")))
    path = shared_dir(spark, "labels")
    texts.select("split", "file", "text").write.json(path)
    files = spark.read.schema("split string, file string, text string").json(path)
    parsed = S.read_label_rows(files.withColumnRenamed("text", "content"))
    return parsed.select(
        "split", "file", F.col("line").cast("long").alias("line"), "class_id",
        F.size("vals").alias("n_vals"), F.round(F.get("vals", F.lit(0)), 6).alias("v1"))


@query("write_labels", f"""WITH {B.LABEL_CTE},
  k AS (SELECT split, file FROM l WHERE ax1 IS NOT NULL AND least(ax2 - ax1, ay2 - ay1) >= 1e-4)
  SELECT split, file, count(*) AS rows FROM k GROUP BY 1, 2""")
def write_labels(spark, sf):
    path = shared_dir(spark, "repaired")
    K.write_labels(L.repair_rows(B.label_rows(spark, sf)), path)
    return spark.read.text(path).groupBy("split", "file").agg(F.count("*").alias("rows"))


@query("repair_manifest", f"""WITH {B.LABEL_CTE},
  k AS (SELECT *, ax1 IS NOT NULL AND least(ax2 - ax1, ay2 - ay1) >= 1e-4 AS kept FROM l)
  SELECT split, file, count(*) AS rows_before, count_if(kept) AS rows_after, count_if(kept AND n = 8) AS polygons_converted
  FROM k GROUP BY 1, 2""")
def repair_manifest(spark, sf):
    path = shared_dir(spark, "manifest")
    K.write_repair_manifest(L.repair_rows(B.label_rows(spark, sf)), path)
    return spark.read.json(f"{path}/files").select(
        "split", "file", "rows_before", "rows_after", "polygons_converted")


@query("class_name_files", """SELECT r_regionkey AS id, CAST(0 AS INTEGER) AS class_id, lower(r_name) AS name FROM region
  UNION ALL SELECT r_regionkey, 1, 'label' FROM region""")
def class_name_files(spark, sf):
    lines = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("id"),
        F.concat(F.lit("names: ['"), F.lower("r_name"), F.lit("', \"label\", ]")).alias("value"))
    path = shared_dir(spark, "names")
    lines.write.parquet(path)
    back = spark.read.schema("id int, value string").parquet(path)
    return S.class_names(back)


@query("truth_csv", """SELECT CAST(conv_id AS VARCHAR) AS key, arg_max(trim(text), turn) AS text FROM conversations
  WHERE trim(text) <> '' GROUP BY conv_id""")
def truth_csv(spark, sf):
    raw = table(spark, sf, "conversations").select(
        F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias("key"), "text", "turn")
    path = shared_dir(spark, "truth")
    raw.write.option("header", True).option("escape", '"').csv(path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return S.tidy_truth(back.withColumn("turn", F.col("turn").cast("int")), "turn")


@query("truth_csv_files", """SELECT CAST(conv_id AS VARCHAR) AS key, arg_max(concat('"q", ', trim(text)), turn) AS text
  FROM conversations GROUP BY conv_id""")
def truth_csv_files(spark, sf):
    """The reader itself on files in row order, with quotes and line breaks: the last row of a key wins."""
    quoted = F.concat(F.lit('"q", '), F.trim("text"))
    rows = table(spark, sf, "conversations").orderBy("conv_id", "turn").select(F.col("conv_id").alias("key"), quoted.alias("text"))
    path = shared_dir(spark, "truth_files")
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return S.read_truth_csv(spark, path)


@query("digest_csv", reading.DIGEST + """SELECT image, class, CAST(box_count AS VARCHAR) AS box_count,
    CASE WHEN is_compliant THEN 'yes' ELSE 'no' END AS is_compliant, combined_text FROM g JOIN t USING (image, class)""")
def digest_csv(spark, sf):
    path = shared_dir(spark, "digest")
    K.write_digest_csv(W.digest(reading.pack_log(spark, sf), B.AS_OF), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("image", "class", "box_count", "is_compliant", "combined_text")


@query("report_csv", workflow.rules_sql("users scans results", """
  SELECT CAST(scan_id AS VARCHAR) AS scan_id, rule_class,
    CASE WHEN NOT in_scope THEN 'NOT ASSESSED' WHEN is_compliant THEN 'PASS' ELSE 'FAIL' END AS is_compliant,
    CAST(penalty_amount AS VARCHAR) AS penalty_amount FROM o JOIN scans s USING (scan_id)"""))
def report_csv(spark, sf):
    scans, users = bound(spark, sf, "scans"), bound(spark, sf, "users")
    path = shared_dir(spark, "report")
    K.write_report_csv(R.report_rows(V.with_inspector(scans, users), workflow.overlaid(spark, sf)), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("scan_id", "rule_class", "is_compliant", "penalty_amount")


@query("report_json", workflow.rules_sql("scans results", """
  SELECT scan_id, count(*) AS total, count(*) AS n_results FROM o GROUP BY scan_id"""))
def report_json(spark, sf):
    scans = bound(spark, sf, "scans").withColumn("profile_id", F.col("inspector_id") % 25)
    rules = P.normalize_profiles(workflow.profiles(spark, sf))
    doc = R.report_payload(scans, workflow.overlaid(spark, sf), rules, ["profile_id"], "1998-06-30T00:00:00")
    path = shared_dir(spark, "payload")
    K.write_report_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    return back.select("scan_id", "summary.total", F.size("results").cast("long").alias("n_results"))


@query("export_tables", with_cte("scans results", """
  SELECT 'scans' AS name, count(*) AS n FROM scans UNION ALL SELECT 'results', count(*) FROM results"""))
def export_tables(spark, sf):
    path = shared_dir(spark, "export")
    K.export_tables(bound(spark, sf, "scans"), bound(spark, sf, "results"), path)

    def rows(name):
        df = spark.read.option("header", True).option("escape", '"').csv(f"{path}/{name}")
        return df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n"))

    return rows("scans").unionByName(rows("results"))


@query("truth_template", """SELECT DISTINCT concat(conv_id // 4, '-', turn // 3) AS key, role AS class FROM conversations""")
def truth_template(spark, sf):
    crops = reading.by_crop(spark, sf).select("key", "class").distinct()
    path = shared_dir(spark, "template")
    K.write_truth_template(crops, path)
    return spark.read.option("header", True).csv(path).select("key", "class")


@query("measurements_csv", reading.MEASURED + " SELECT backend, variant, count(*) AS n, count(cer) AS graded FROM t GROUP BY 1, 2")
def measurements_csv(spark, sf):
    path = shared_dir(spark, "measurements")
    K.write_measurements_csv(reading.graded(spark, sf), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.groupBy("backend", "variant").agg(F.count("*").alias("n"), F.count("cer").alias("graded"))


@query("run_summary_json", with_cte("log", """SELECT (SELECT count(*) FROM customer) AS image_count,
    (SELECT count(*) FROM log WHERE record_type = 'detection') AS detection_record_count"""))
def run_summary_json(spark, sf):
    path = shared_dir(spark, "summary")
    K.write_run_summary(W.run_summary(reading.all_images(spark, sf), reading.status_log(spark, sf)), path)
    return spark.read.json(path).select("image_count", "detection_record_count")


@query("evidence_hashes", """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN '' ELSE sha256(text) END AS hash,
    CASE WHEN doc_id % 10 = 3 THEN 'missing' ELSE 'read' END AS status FROM documents""")
def evidence_hashes(spark, sf):
    """File-like contents hashed beside their path list; every tenth path has no file."""
    docs = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    files = docs.where("doc_id % 10 <> 3").select("path", F.sha2("text", 256).alias("hash"))
    return V.evidence_hashes(docs.select("doc_id", "path"), files).select("doc_id", "hash", "status")


@query("evidence_files", """SELECT sha256(concat(s_name, chr(10))) AS hash, 'read' AS status FROM supplier
  UNION ALL SELECT '', 'missing' FROM supplier WHERE s_suppkey % 5 = 3""")
def evidence_files(spark, sf):
    """Real files in nested folders, hashed whole or in pieces, beside paths that lead nowhere."""
    root = shared_dir(spark, "evidence")
    names = table(spark, sf, "supplier")
    for part in range(2):
        # one task writes and renames its files one after another, so all cores share them
        some = spread(names).where(F.col("s_suppkey") % 2 == part).select("s_name")
        some.write.option("maxRecordsPerFile", 1).text(f"{root}/scan{part}/images")
    files = written(S.evidence_files(spark, root, whole=18))
    gone = names.where("s_suppkey % 5 = 3").select(F.concat(F.lit("file:/nowhere/"), "s_name").alias("path"))
    paths = files.select("path").where(~F.col("path").endswith("_SUCCESS") & ~F.col("path").endswith(".crc")).unionByName(gone)
    return V.evidence_hashes(paths, files).select("hash", "status")


@query("label_files", f"""WITH {B.LABEL_CTE}
  SELECT split, CAST(row_number() OVER (PARTITION BY split, file ORDER BY line) + 1 AS INTEGER) AS line, class_id,
    CAST(n AS INTEGER) AS n_vals, round(v[1], 6) AS v1, 'read' AS status FROM l
  UNION ALL SELECT split, 1, -1, 0, NULL, 'read' FROM (SELECT DISTINCT split, file FROM l)
  UNION ALL SELECT DISTINCT split, 0, NULL, NULL, NULL, 'read' FROM l""")
def label_files(spark, sf):
    """Label files in nested folders read back whole, each with a bad first row, and an empty file in every split."""
    rows = B.label_rows(spark, sf)
    texts = written(K.label_texts(rows.withColumn("kept", F.lit(True)).withColumn("fixed", F.col("raw"))))
    root = shared_dir(spark, "label_files")
    for (split,) in texts.select("split").distinct().collect():
        some = texts.where(F.col("split") == split)
        # the empty file comes first: Spark writes a file for a first partition without rows, which would be one more
        body = some.limit(1).select(F.lit("").alias("t")).unionByName(some.select(F.concat(F.lit("bad row\n"), "text").alias("t")))
        body.write.option("maxRecordsPerFile", 1).text(f"{root}/{split}/labels/deep")
    files = S.label_files(spark, root)
    parsed = S.read_label_rows(files).select(
        "split", "line", "class_id", F.size("vals").alias("n_vals"), F.round(F.get("vals", F.lit(0)), 6).alias("v1"), F.lit("read").alias("status"))
    empty = files.where(~F.col("content").rlike(r"\S")).select(
        "split", F.lit(0).alias("line"), F.lit(None).cast("int").alias("class_id"), F.lit(None).cast("int").alias("n_vals"),
        F.lit(None).cast("double").alias("v1"), "status")
    return parsed.unionByName(empty)


@query("image_listing", """SELECT CAST(n_nationkey % 3 AS VARCHAR) AS folder, count(*) AS images FROM nation GROUP BY 1""")
def image_listing(spark, sf):
    """Images below a folder whose name also occurs inside it."""
    root = shared_dir(spark, "img")
    nations = table(spark, sf, "nation")
    for part in range(3):
        some = nations.where(F.col("n_nationkey") % 3 == part)
        some.select(F.encode("n_name", "UTF-8").alias("value").cast("string")).write.format("csv").option("maxRecordsPerFile", 1).option(
            "extension", "jpg").save(f"{root}/{part}/img")
    listed = S.list_images(spark, root)
    return listed.groupBy(F.substring_index("image_path", "/", 1).alias("folder")).agg(F.count("*").alias("images"))
