"""Rule profiles: normalizing, versioning, overlaying on verdicts, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import text as X
from labelwise.functions.geometry import clamp_penalty
from labelwise.operators.ordering import carry_forward, ranked

CATALOGUE = (
    "array<struct<ord:int,rule_class:string,label:string,statute:string,"
    "severity:string,penalty:int,advisory:boolean>>"
)


def catalogue() -> Column:
    """The eight fixed rules as one literal array column."""
    names = ["rule_class", "label", "statute", "severity", "penalty", "advisory"]
    rows = [{"ord": i, **dict(zip(names, r))} for i, r in enumerate(K.RULE_CATALOGUE)]
    return X.literal_table(rows, CATALOGUE)


def rule_of(rule_class: Column) -> Column:
    """Catalogue entry of a class, or null."""
    return F.get(F.filter(catalogue(), lambda r: r["rule_class"] == rule_class), F.lit(0))


def default_label(rule_class: Column) -> Column:
    return F.initcap(F.replace(rule_class, F.lit("_"), F.lit(" ")))


def _truthy(text: Column) -> Column:
    return ~F.lower(text).isin("false", "0", "0.0", "", "[]", "{}")


def normalize_profiles(profiles: DataFrame, payload: str = "payload") -> DataFrame:
    """Stored JSON profiles to valid rules, one row per profile and catalogue class.

    Unknown classes vanish, missing ones come from the catalogue, severities are
    title-cased and checked, penalties clamped, advisory classes cost nothing.
    """
    raw = F.from_json(F.coalesce(F.col(payload), F.lit("{}")), "profile_name string, rules map<string,string>")
    name = F.substring(F.trim(F.coalesce(F.col("_raw.profile_name"), F.lit(""))), 1, 120)
    wide = profiles.withColumn("_raw", raw).select(
        *[c for c in profiles.columns if c not in (payload, "profile_name")],
        F.when(name == "", K.DEFAULT_PROFILE_NAME).otherwise(name).alias("profile_name"),
        F.col("_raw.rules").alias("_rules"),
        F.inline(catalogue()),
    )
    text = F.element_at(F.coalesce("_rules", F.expr("cast(map() as map<string,string>)")), F.col("rule_class"))
    keys = F.json_object_keys("_text")
    stored = F.from_json("_text", "enabled string, severity string, penalty string")
    named = F.array_contains(keys, "enabled")
    severity = F.initcap(F.trim(F.coalesce(F.col("_s.severity"), F.lit(""))))
    return (
        wide.withColumn("_text", text)
        .withColumn("_text", F.when(keys.isNotNull(), F.col("_text")))
        .withColumn("_s", stored)
        .withColumn(
            "enabled",
            F.when(named, F.coalesce(_truthy(F.col("_s.enabled")), F.lit(False))).otherwise(True),
        )
        .withColumn("severity", F.when(severity.isin(K.SEVERITIES), severity).otherwise(F.col("severity")))
        .withColumn(
            "penalty",
            F.when(F.col("advisory"), 0).otherwise(clamp_penalty(F.col("_s.penalty"), F.col("penalty"))),
        )
        .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
        .drop("_rules", "_text", "_s")
    )


def default_profile(spark: SparkSession) -> DataFrame:
    """The shipped profile as exploded rules."""
    return normalize_profiles(spark.sql("select 0L as profile_id, '{}' as payload"))


def _ascii_json(text: Column) -> Column:
    """Escape non-ASCII characters as ``\\uXXXX``, in surrogate pairs where needed."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def char(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high = F.floor((code - 0x10000) / 0x400) + 0xD800
        low = F.pmod(code - 0x10000, F.lit(0x400)) + 0xDC00
        return (
            F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(
                F.concat(unit(high), unit(low))
            )
        )

    escaped = F.array_join(F.transform(F.split(text, ""), char), "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), escaped).otherwise(text)


def profile_versions(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Twelve hex digits of the profile's canonical JSON, per profile."""
    body = F.struct("enabled", "penalty", "severity", "statute")
    entries = F.array_sort(F.collect_list(F.struct("rule_class", body.alias("b"))))
    doc = F.struct(
        F.col("profile_name"),
        F.map_from_entries("_e").alias("rules"),
        F.lit(K.SCHEMA_VERSION).alias("schema_version"),
    )
    return (
        rules.groupBy(*keys, "profile_name")
        .agg(entries.alias("_e"))
        .withColumn("payload", F.to_json(doc))
        .withColumn("config_version", F.substring(F.sha2(_ascii_json(F.col("payload")), 256), 1, 12))
        .drop("_e")
    )


def with_version(rules: DataFrame, keys: list[str]) -> DataFrame:
    versions = profile_versions(rules, keys).select(*keys, "config_version")
    return rules.join(versions, keys)


def apply_profile(verdicts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay scope, severity, statute, penalty and reason on verdicts.

    ``rules`` carries ``config_version`` and joins on ``keys`` (``rule_class``
    alone for one profile: eight rows; or profile and class).  The
    verdict itself never changes.  Uncovered classes are reported, never charged.
    A row goes under one rule; ``rules`` that hold two for the same keys raise an error, for either could be charged.
    """
    cols = [*keys, "profile_name", "config_version", "enabled", "severity", "penalty", "statute"]
    values = [c for c in cols if c not in keys]
    held = rules.select(*cols).groupBy(*keys).agg(F.collect_set(F.struct(*values)).alias("_rules"))
    twice = F.raise_error(F.concat(F.lit("several rules for "), F.concat_ws(", ", *keys)))
    only = F.when(F.size("_rules") > 1, twice).otherwise(F.get("_rules", F.lit(0)))
    side = held.select(*keys, only.alias("_rule")).select(*keys, "_rule.*").withColumnRenamed("statute", "_statute")
    own = verdicts.withColumn(
        "_own", F.col("statute") if "statute" in verdicts.columns else F.lit(None).cast("string")
    ).drop("statute")
    j = own.join(side, keys, "left")
    ok = F.coalesce(F.col("is_compliant"), F.lit(False))
    covered = F.col("_statute").isNotNull()
    off = covered & ~F.col("enabled")
    said = F.trim(F.coalesce(F.col("reason"), F.lit("")))
    reason = (
        F.when(
            ~covered,
            F.trim(F.format_string(
                "%s This class is not covered by profile '%s', so no penalty is proposed.",
                said, F.coalesce(F.col("profile_name"), F.lit(K.DEFAULT_PROFILE_NAME)),
            )),
        )
        .when(
            off,
            F.format_string(
                "Out of scope for profile '%s': this declaration was not assessed. "
                "Configured basis: %s.", "profile_name", "_statute",
            ),
        )
        .otherwise(
            F.trim(F.format_string(
                "%s Assessed under %s at %s severity (profile '%s', config %s).",
                said, F.col("_statute"), F.lower("severity"), F.col("profile_name"),
                F.col("config_version"),
            ))
        )
    )
    rule = rule_of(F.col("rule_class"))
    return (
        j.withColumn("rule_label", F.coalesce(rule["label"], default_label(F.col("rule_class"))))
        .withColumn("in_scope", ~off)
        .withColumn("reason", reason)
        .withColumn("severity", F.when(covered, F.col("severity")).otherwise("Unclassified"))
        .withColumn(
            "statute",
            F.coalesce("_statute", F.nullif("_own", F.lit("")), F.lit("Not mapped to a configured rule")),
        )
        .withColumn(
            "penalty_amount", F.when(covered & ~off & ~ok, F.col("penalty")).otherwise(0)
        )
        .drop("_own", "_statute", "enabled", "penalty")
    )


def summarize_verdicts(overlaid: DataFrame, keys: list[str], order: str = "rule_class") -> DataFrame:
    """Scope-aware totals; classes out of scope are neither pass nor fail."""
    return overlaid.groupBy(*keys).agg(*summary_columns(order))


def summary_columns(order: str = "rule_class") -> list[Column]:
    """The totals of ``summarize_verdicts`` as aggregates."""
    ok = F.coalesce(F.col("is_compliant"), F.lit(False))
    scope = F.col("in_scope")
    failed = scope & ~ok
    by_sev = [
        F.count_if(failed & (F.col("severity") == s)).alias(f"failed_{s.lower()}")
        for s in K.SEVERITIES
    ]
    rank = F.array_position(F.array(*[F.lit(s) for s in K.SEVERITIES]), F.col("severity"))

    def first_filled(c: str) -> Column:
        filled = F.nullif(F.col(c), F.lit(""))
        return F.coalesce(
            F.min_by(filled, F.when(filled.isNotNull(), F.col(order))), F.lit("")
        ).alias(c)

    return [
        F.count("*").alias("total"),
        F.count_if(scope).alias("assessed"),
        F.count_if(~scope).alias("skipped"),
        F.count_if(scope & ok).alias("passed"),
        F.count_if(failed).alias("failed"),
        F.coalesce(
            F.sum(F.when(failed, F.greatest(F.lit(0), F.coalesce("penalty_amount", F.lit(0))))),
            F.lit(0),
        ).alias("penalty"),
        *by_sev,
        F.coalesce(
            F.min_by("severity", F.when(failed & (rank > 0), rank)), F.lit("")
        ).alias("highest_severity"),
        first_filled("profile_name"),
        first_filled("config_version"),
    ]


def profile_diff(rules: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered list of what a profile changes against a baseline profile."""
    base = baseline.select(
        "rule_class",
        F.col("profile_name").alias("b_name"),
        F.col("enabled").alias("b_enabled"),
        F.col("severity").alias("b_severity"),
        F.col("penalty").alias("b_penalty"),
    )
    cls = F.col("rule_class")
    changes = F.array_compact(
        F.array(
            F.when(
                F.col("enabled") != F.col("b_enabled"),
                F.concat(cls, F.when(F.col("enabled"), F.lit(" set in scope")).otherwise(" set out of scope")),
            ),
            F.when(
                F.col("severity") != F.col("b_severity"),
                F.concat(cls, F.lit(" severity "), "b_severity", F.lit(" to "), "severity"),
            ),
            F.when(
                F.col("penalty") != F.col("b_penalty"),
                F.concat(
                    cls, F.lit(" penalty "), F.col("b_penalty").cast("string"), F.lit(" to "),
                    F.col("penalty").cast("string"),
                ),
            ),
        )
    )
    j = rules.join(base, "rule_class")
    renamed = F.max(
        F.when(
            F.col("profile_name") != F.col("b_name"),
            F.concat(F.lit("profile renamed to '"), "profile_name", F.lit("'")),
        )
    )
    ordered = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", changes.alias("c")))), lambda s: s["c"]
        )
    )
    return (
        j.groupBy(*keys)
        .agg(renamed.alias("_r"), ordered.alias("_c"))
        .select(*keys, F.array_compact(F.concat(F.array("_r"), F.col("_c"))).alias("changes"))
    )


def rules_to_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Editor rows back to a stored payload per profile."""
    return profile_versions(rows, keys).select(*keys, "profile_name", "payload", "config_version")


def scope_split(rules: DataFrame, keys: list[str]) -> DataFrame:
    """In-scope and out-of-scope classes of a profile, in catalogue order."""
    def classes(flag: Column) -> Column:
        return F.transform(
            F.array_sort(F.collect_list(F.when(flag, F.struct("ord", "rule_class")))),
            lambda s: s["rule_class"],
        )

    return rules.groupBy(*keys).agg(
        classes(F.col("enabled")).alias("in_scope"),
        classes(~F.col("enabled")).alias("out_of_scope"),
    )


def result_metadata(results: DataFrame) -> DataFrame:
    """Overlay fields from the row, else from ``parsed_data``, else the catalogue."""
    def stored(name: str) -> Column:
        return F.get_json_object("parsed_data", f"$.{name}")

    def live(name: str) -> Column:
        return F.col(name) if name in results.columns else F.lit(None).cast("string")

    rule = rule_of(F.col("rule_class"))
    scope = F.coalesce(live("in_scope").cast("string"), stored("in_scope"), F.lit("true"))
    blank = F.lit("")
    return results.select(
        *[c for c in results.columns if c not in
          ("in_scope", "severity", "rule_label", "statute", "config_profile", "config_version")],
        _truthy(scope).alias("in_scope"),
        F.coalesce(F.nullif(F.coalesce(live("severity"), stored("severity")), blank), rule["severity"], blank).alias("severity"),
        F.coalesce(
            F.nullif(live("rule_label"), blank), F.nullif(stored("rule_label"), blank), rule["label"],
            default_label(F.col("rule_class")),
        ).alias("rule_label"),
        F.coalesce(F.nullif(live("statute"), blank), stored("statute"), blank).alias("statute"),
        F.coalesce(F.nullif(live("config_profile"), blank), stored("config_profile"), blank).alias("config_profile"),
        F.coalesce(F.nullif(live("config_version"), blank), stored("config_version"), blank).alias("config_version"),
    )


def active_profile(configs: DataFrame) -> DataFrame:
    """Newest active stored profile as rules; the shipped one when none is active."""
    newest = configs.where("is_active").agg(
        F.coalesce(F.max_by("payload", "config_id"), F.lit("{}")).alias("payload"),
        F.coalesce(F.max("config_id"), F.lit(0)).alias("config_id"),
    )
    return normalize_profiles(newest)


def activate_profiles(
    configs: DataFrame, saves: DataFrame, users: DataFrame, baseline: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Saved profiles become new versions; the newest accepted save is active.

    ``saves`` is ``config_id, payload, actor_id, ts``; only active admins save.
    Returns all versions (old ones superseded, never removed) and audit rows.
    """
    admins = users.where("active and role = 'Admin'").select(F.col("user_id").alias("actor_id"))
    good = saves.join(admins, "actor_id", "left_semi")
    rules = normalize_profiles(good)
    versions = profile_versions(rules, ["config_id"])
    fresh = good.drop("payload").join(versions, "config_id").select(
        "config_id", "profile_name", "config_version", "payload",
        F.col("actor_id").alias("created_by"), F.col("ts").alias("created_at"),
    )
    newest = fresh.agg(F.max("config_id").alias("_top"))
    old = configs.select(
        "config_id", "profile_name", "config_version", "payload", "created_by", "created_at",
        "is_active",
    )
    everything = old.unionByName(fresh.withColumn("is_active", F.lit(True)))
    top = F.broadcast(newest)  # one row
    snapshot = (
        everything.join(top, F.lit(True), "left")
        .withColumn(
            "is_active",
            F.when(F.col("_top").isNull(), F.col("is_active")).otherwise(F.col("config_id") == F.col("_top")),
        )
        .drop("_top")
    )
    diff = profile_diff(rules, baseline, ["config_id"])
    text = F.when(F.size("changes") > 0, F.array_join("changes", ", ")).otherwise("matches shipped defaults")
    audit = fresh.join(diff, "config_id").select(
        F.col("created_by").alias("actor_id"),
        F.lit("UPDATE_RULE_CONFIG").alias("action"),
        F.concat(
            F.lit("Activated rule profile '"), "profile_name", F.lit("' ("), "config_version",
            F.lit("); "), text,
        ).alias("details"),
        F.col("created_at").alias("ts"),
    )
    return snapshot, audit


# --- versions in time -------------------------------------------------------


def validity(activations: DataFrame) -> DataFrame:
    """Activations ``(config_id, activated_at, ...)``, in any order of arrival, as versions that follow each other in time.

    Added are ``valid_from``, ``valid_to`` (excluded; null for the version in force) and ``superseded_by``.  Of
    activations at one time the largest id comes last; the others were in force for no time at all.
    """
    versions = ranked(activations, [], ["activated_at", "config_id"], "_rn")
    later = versions.select(
        (F.col("_rn") - 1).alias("_rn"), F.col("activated_at").alias("valid_to"), F.col("config_id").alias("superseded_by")
    )
    return versions.join(later, "_rn", "left").withColumn("valid_from", F.col("activated_at")).drop("_rn")


def in_force(rows: DataFrame, activations: DataFrame, at: str) -> DataFrame:
    """``rows`` with ``config_id``, the version that was in force at their time ``at``; null before the first one.

    Versions and rows are laid on one line of time, and the last version carries forward; a row at the very time of
    an activation is judged by it.  Rows without a time have no version.
    """
    events = activations.select(
        F.col("activated_at").alias("_time"), F.lit(0).alias("_kind"), F.col("config_id").alias("_config"), F.col("config_id").alias("_tie")
    )
    asking = rows.select(
        F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast(activations.schema["config_id"].dataType).alias("_config"),
        F.lit(None).cast(activations.schema["config_id"].dataType).alias("_tie"), F.struct(*rows.columns).alias("_row"),
    )
    line = ranked(events.unionByName(asking, allowMissingColumns=True), [], ["_time", "_kind", "_tie"])
    held = carry_forward(line, [], F.col("_config"), "config_id").where("_kind = 1")
    return held.select("_row.*", F.when(F.col("_time").isNotNull(), F.col("config_id")).alias("config_id"))
