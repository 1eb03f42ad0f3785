"""Inspection reports: nested payloads and flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.functions.predicates import path_list, row_status
from labelwise.operators.policy import scope_split, summary_columns


def report_rows(scans: DataFrame, overlaid: DataFrame) -> DataFrame:
    """One flat row per verdict with its scan and profile."""
    s = scans.select(
        "scan_id", "status", F.col("ts").cast("string").alias("timestamp"),
        F.col("username").alias("inspector"),
        F.array_join(path_list(F.col("image_paths")), " | ").alias("evidence_images"),
    )
    yes_no = F.when(F.col("in_scope"), "YES").otherwise("NO")
    parsed = F.col("parsed_data") if "parsed_data" in overlaid.columns else F.lit("{}")
    return overlaid.join(s, "scan_id").select(
        "scan_id", "status", "timestamp", "inspector",
        F.col("profile_name").alias("rule_profile"), "config_version", "rule_class",
        F.col("rule_label").alias("declaration"), yes_no.alias("in_scope"), "severity", "statute",
        row_status(F.col("in_scope"), F.col("is_compliant")).alias("is_compliant"),
        F.coalesce("extracted_text", F.lit("")).alias("extracted_text"), "reason",
        parsed.alias("parsed_data"), F.col("penalty_amount").cast("long").alias("penalty_amount"),
        "evidence_images",
    )


def result_rows(overlaid: DataFrame) -> DataFrame:
    """Display projection of verdicts."""
    parsed = F.col("parsed_data") if "parsed_data" in overlaid.columns else F.lit("{}")
    return overlaid.select(
        F.col("rule_label").alias("declaration"), "rule_class",
        row_status(F.col("in_scope"), F.col("is_compliant")).alias("status"), "severity", "statute",
        F.coalesce("extracted_text", F.lit("")).alias("extracted_text"),
        parsed.alias("parsed_values"), "reason", F.col("penalty_amount").cast("long").alias("penalty"),
    )


def report_payload(
    scans: DataFrame, overlaid: DataFrame, rules: DataFrame, rule_keys: list[str], generated_at: str
) -> DataFrame:
    """Nested report per scan: scan, rule set, summary, evidence and results.

    A scan has one result per rule class, so its array is bounded.
    """
    item = F.struct(
        "rule_class", "rule_label", "in_scope", "severity", "statute", "is_compliant",
        "extracted_text", "reason", "penalty_amount",
    )
    results = overlaid.groupBy("scan_id").agg(
        F.array_sort(F.collect_list(item)).alias("results"),
        F.array_sort(F.collect_set(F.when(F.col("in_scope"), F.col("rule_class")))).alias("assessed_classes"),
        *summary_columns(),
    ).select(
        "scan_id", "results", "assessed_classes",
        F.struct("total", "assessed", "skipped", "passed", "failed", "penalty", "highest_severity").alias("summary"),
    )
    split = scope_split(rules, rule_keys)
    out = scans.join(results, "scan_id")
    if rule_keys:
        out = out.join(split, rule_keys)
    else:
        out = out.join(F.broadcast(split), F.lit(True))  # one profile, one row
    return out.select(
        "scan_id",
        F.lit("LMPC Rule 6 inspection report").alias("report_type"),
        F.lit(generated_at).alias("generated_at"),
        F.struct("scan_id", "status", "product_name", "evidence_notes").alias("scan"),
        F.struct(
            F.col("in_scope").alias("rules_in_scope"), F.col("out_of_scope").alias("rules_out_of_scope"),
            F.col("assessed_classes").alias("assessed_rule_classes"),
        ).alias("rule_config"),
        "summary",
        F.struct(path_list(F.col("image_paths")).alias("image_paths")).alias("evidence"),
        "results",
    )
