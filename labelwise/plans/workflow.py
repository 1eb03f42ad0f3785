"""Review workflow and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwise.functions import predicates as Q
from labelwise.operators import policy as P
from labelwise.operators import reports as R
from labelwise.operators import review as V
from labelwise.plans.bindings import bound, table, with_cte
from labelwise.sources import readers as S

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def usr(*names: str):
    def load(spark, sf):
        return [bound(spark, sf, n) for n in names]

    return load


def ts_us():
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")


# --- audit ------------------------------------------------------------------


@query("audit_analytics", with_cte("users scans results", """
  SELECT (SELECT count(*) FROM scans) AS total_scans,
    count(DISTINCT scan_id) AS failed_scans, count(*) AS total_violations,
    CAST(sum(penalty_amount) AS BIGINT) AS total_penalty,
    (SELECT count(*) FROM users WHERE active) AS active_users,
    count(DISTINCT scan_id) / (SELECT count(*) FROM scans) * 100 AS failure_rate
  FROM results WHERE NOT is_compliant"""))
def audit_analytics(spark, sf):
    scans, results, users = usr("scans", "results", "users")(spark, sf)
    return V.audit_analytics(scans, results, users)


@query("status_counts", with_cte("scans", "SELECT status, count(*) AS n FROM scans GROUP BY status"))
def status_counts(spark, sf):
    return V.status_counts(bound(spark, sf, "scans"))


@query("violations_by_rule", with_cte("results", """
  SELECT rule_class, count(*) AS total, count_if(NOT is_compliant) AS violations
  FROM results GROUP BY rule_class ORDER BY violations DESC, rule_class"""))
def violations_by_rule(spark, sf):
    return V.violations_by_rule(bound(spark, sf, "results"))


@query("queue_metrics", with_cte("scans results", """
  SELECT (SELECT count(*) FROM scans WHERE status = 'PENDING') AS pending_scans,
    count(*) AS pending_violations, CAST(sum(penalty_amount) AS BIGINT) AS pending_penalty
  FROM results JOIN scans USING (scan_id) WHERE status = 'PENDING' AND NOT is_compliant"""))
def queue_metrics(spark, sf):
    scans, results = usr("scans", "results")(spark, sf)
    return V.queue_metrics(scans, results)


@query("history_table", with_cte("users scans results", """
  SELECT s.scan_id, s.product_name AS product, u.username AS inspector, s.status,
    CASE s.scan_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS evidence,
    coalesce(count_if(r.is_compliant), 0) AS passed, coalesce(count_if(NOT r.is_compliant), 0) AS failed,
    CAST(coalesce(sum(CASE WHEN NOT r.is_compliant THEN r.penalty_amount END), 0) AS BIGINT) AS penalty
  FROM scans s JOIN users u ON u.user_id = s.inspector_id LEFT JOIN results r ON r.scan_id = s.scan_id
  GROUP BY ALL"""))
def history_table(spark, sf):
    scans, users, results = usr("scans", "users", "results")(spark, sf)
    return V.history_table(scans, users, results)


@query("nested_scans", with_cte("scans results", """
  SELECT s.scan_id, count(result_id) AS n_results, min(result_id) AS first_result,
    coalesce(string_agg(rule_class, ',' ORDER BY result_id), '') AS classes
  FROM scans s LEFT JOIN results r ON r.scan_id = s.scan_id GROUP BY s.scan_id"""))
def nested_scans(spark, sf):
    scans, results = usr("scans", "results")(spark, sf)
    nested = V.nest_scans(scans.select("scan_id"), results)
    return nested.select(
        "scan_id", F.size("results").cast("long").alias("n_results"),
        F.get("results", F.lit(0))["result_id"].alias("first_result"),
        F.array_join(F.transform("results", lambda r: r["rule_class"]), ",").alias("classes"),
    )


# --- reads ------------------------------------------------------------------


@query("pending_queue", with_cte("users scans results", """
  SELECT s.scan_id, epoch_us(ts) AS ts_us, username, result_id, rule_class, penalty_amount
  FROM scans s JOIN users u ON u.user_id = s.inspector_id LEFT JOIN results r ON r.scan_id = s.scan_id
  WHERE status = 'PENDING' ORDER BY ts, s.scan_id, result_id"""))
def pending_queue(spark, sf):
    scans, users, results = usr("scans", "users", "results")(spark, sf)
    return V.pending_queue(scans, users, results).select(
        "scan_id", ts_us(), "username", "result_id", "rule_class", "penalty_amount"
    )


@query("history_search", with_cte("users scans", """
  SELECT scan_id, username, product_name, evidence_notes
  FROM scans s JOIN users u ON u.user_id = s.inspector_id
  WHERE status = 'APPROVED' AND (CAST(scan_id AS VARCHAR) ILIKE '%URGENT%' OR username ILIKE '%URGENT%'
    OR product_name ILIKE '%URGENT%' OR evidence_notes ILIKE '%URGENT%')"""))
def history_search(spark, sf):
    scans, users = usr("scans", "users")(spark, sf)
    found = V.history_search(V.with_inspector(scans, users), "URGENT", "approved")
    return found.select("scan_id", "username", "product_name", "evidence_notes")


@query("scoped_history", with_cte("users scans results", """
  , top AS (SELECT * FROM scans WHERE inspector_id IN (SELECT user_id FROM users WHERE user_id = 3 AND active)
    ORDER BY ts DESC, scan_id DESC LIMIT 200)
  SELECT t.scan_id, status, result_id, rule_class
  FROM top t LEFT JOIN results r ON r.scan_id = t.scan_id""".replace("\n  , top", ", top")))
def scoped_history(spark, sf):
    scans, users, results = usr("scans", "users", "results")(spark, sf)
    return V.history(scans, users, results, actor_id=3).select(
        "scan_id", "status", "result_id", "rule_class"
    )


@query("verifier_history", with_cte("users scans results", """
  , top AS (SELECT * FROM scans WHERE EXISTS (SELECT 1 FROM users WHERE user_id = 11 AND active
      AND role IN ('Verifier', 'Admin')) AND evidence_notes ILIKE '%note 5%'
    ORDER BY ts DESC, scan_id DESC LIMIT 100)
  SELECT t.scan_id, status, result_id, rule_class
  FROM top t LEFT JOIN results r ON r.scan_id = t.scan_id""".replace("\n  , top", ", top")))
def verifier_history(spark, sf):
    scans, users, results = usr("scans", "users", "results")(spark, sf)
    return V.history(scans, users, results, actor_id=11, query="note 5", limit=100).select(
        "scan_id", "status", "result_id", "rule_class"
    )


@query("list_users", with_cte("users", """
  SELECT user_id, username, role, active FROM users
  ORDER BY CASE role WHEN 'Admin' THEN 1 WHEN 'Verifier' THEN 2 ELSE 3 END, username"""))
def list_users(spark, sf):
    return V.list_users(bound(spark, sf, "users"))


@query("audit_log", with_cte("users", """
  SELECT event_id, user_id * 20 AS actor_id, event_type AS action, username AS actor_username
  FROM (SELECT event_id, e.user_id, event_type FROM events e ORDER BY event_id DESC LIMIT 200) e
  LEFT JOIN (SELECT user_id AS uid, username FROM users) u ON uid = e.user_id * 20"""))
def audit_log(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") * 20).alias("actor_id"), F.col("event_type").alias("action")
    )
    return V.audit_log(events, bound(spark, sf, "users"), 200)


@query("results_newest_first", with_cte("results", """
  SELECT result_id, scan_id, rule_class, is_compliant, penalty_amount FROM results ORDER BY result_id DESC"""))
def results_newest_first(spark, sf):
    return V.newest(bound(spark, sf, "results"), "result_id").select(
        "result_id", "scan_id", "rule_class", "is_compliant", "penalty_amount"
    )


@query("path_lists", with_cte("scans", """
  SELECT scan_id, CASE scan_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('img/', scan_id, '.jpg')
    WHEN 2 THEN concat('img/', scan_id, '.jpg|img/back.jpg') ELSE 'a.jpg|c.jpg' END AS paths FROM scans"""))
def path_lists(spark, sf):
    scans = S.read_path_list(bound(spark, sf, "scans"), "image_paths")
    return scans.select("scan_id", F.array_join("image_paths", "|").alias("paths"))


# --- writes -----------------------------------------------------------------

DECISIONS = """
  SELECT event_id AS seq, ts, event_id * 7 % 15013 AS scan_id, user_id * 5 AS actor_id,
    CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'OVERRIDDEN'
      WHEN 'purchase' THEN 'APPROVED' WHEN 'signup' THEN 'PENDING' ELSE 'LOST' END AS new_status,
    CASE WHEN value > 20 THEN 'checked' ELSE ' ' END AS reason
  FROM events"""


def decisions(spark, sf):
    return spark.sql(DECISIONS.replace("FROM events", "FROM {src}"), src=table(spark, sf, "events"))


REVIEW_CTE = f"""
  , d AS ({DECISIONS}),
  c AS (SELECT d.seq, d.scan_id, d.actor_id, upper(trim(new_status)) AS ns, trim(reason) AS reason, s.status,
      CASE WHEN upper(trim(new_status)) NOT IN ('PENDING', 'APPROVED', 'OVERRIDDEN') THEN 'unknown status'
           WHEN s.status IS NULL THEN 'scan not found'
           WHEN u.role IS NULL OR u.role NOT IN ('Verifier', 'Admin') THEN 'not allowed' END AS fault,
      CASE WHEN upper(trim(new_status)) = 'OVERRIDDEN' AND trim(reason) = '' THEN 'override needs a reason' END AS ofault
    FROM d LEFT JOIN scans s USING (scan_id) LEFT JOIN (SELECT * FROM users WHERE active) u ON u.user_id = d.actor_id),
  m AS (SELECT scan_id, min(seq) AS mseq, arg_min(ns, seq) AS mto FROM c
    WHERE fault IS NULL AND ofault IS NULL AND status = 'PENDING' AND ns <> 'PENDING' GROUP BY scan_id),
  j AS (SELECT c.*, CASE WHEN m.mseq IS NOT NULL AND c.seq > m.mseq THEN mto ELSE status END AS cur
    FROM c LEFT JOIN m USING (scan_id)),
  w AS (SELECT *, coalesce(fault, CASE WHEN cur <> 'PENDING' AND ns <> cur THEN 'only pending scans can move' END,
    ofault) AS verdict FROM j)"""


@query("apply_reviews", with_cte("users scans", REVIEW_CTE.strip() + """
  SELECT s.scan_id, coalesce(l.ns, s.status) AS status, l.actor_id AS reviewer_id,
    coalesce(l.reason, '') AS review_reason,
    CASE WHEN l.ns <> 'PENDING' THEN (SELECT epoch_us(ts) FROM events WHERE event_id = l.seq) END AS reviewed_us
  FROM scans s LEFT JOIN (SELECT scan_id, arg_max(ns, seq) AS ns, arg_max(actor_id, seq) AS actor_id,
    arg_max(reason, seq) AS reason, max(seq) AS seq FROM w WHERE verdict IS NULL GROUP BY scan_id) l USING (scan_id)
""").replace("\n, d AS", ", d AS"))
def apply_reviews(spark, sf):
    scans, users = usr("scans", "users")(spark, sf)
    updated, _, _ = V.apply_reviews(scans, decisions(spark, sf), users)
    return updated.select(
        "scan_id", "status", "reviewer_id", "review_reason", F.unix_micros(F.col("reviewed_at").cast("timestamp")).alias("reviewed_us"))


@query("rejected_reviews", with_cte("users scans", REVIEW_CTE.strip() + """
  SELECT scan_id, actor_id, ns AS new_status, seq, verdict AS fault FROM w WHERE verdict IS NOT NULL
""").replace("\n, d AS", ", d AS"))
def rejected_reviews(spark, sf):
    scans, users = usr("scans", "users")(spark, sf)
    return V.apply_reviews(scans, decisions(spark, sf), users)[2]


@query("review_audit", with_cte("users scans", REVIEW_CTE.strip() + """
  SELECT actor_id, scan_id, concat('SCAN_', ns) AS action, reason AS details, seq,
    (SELECT epoch_us(ts) FROM events WHERE event_id = w.seq) AS at_us FROM w WHERE verdict IS NULL
""").replace("\n, d AS", ", d AS"))
def review_audit(spark, sf):
    scans, users = usr("scans", "users")(spark, sf)
    audit = V.apply_reviews(scans, decisions(spark, sf), users)[1]
    return audit.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


@query("denied_actors", with_cte("users", """
  SELECT a.actor_id, 'DENIED' AS action, CASE WHEN coalesce(active, false) THEN 'This action requires one of these roles: Verifier, Admin'
    ELSE 'The account is unavailable' END AS details
  FROM (SELECT event_id AS actor_id FROM events) a LEFT JOIN users u ON u.user_id = a.actor_id
  WHERE NOT coalesce(active, false) OR role = 'Inspector'"""))
def denied_actors(spark, sf):
    """Every event's number as an actor who asks to review."""
    actors = table(spark, sf, "events").select(F.col("event_id").alias("actor_id"))
    return V.denied_actors(actors, bound(spark, sf, "users"), ("Verifier", "Admin"))


@query("user_status_changes", with_cte("users", """
  , ch AS (SELECT event_id AS seq, user_id * 10 AS user_id, (user_id * 50) % 500 AS actor_id, value > 30 AS set_active
    FROM events),
  adm AS (SELECT user_id, active FROM users WHERE role = 'Admin'),
  st AS (SELECT row_number() OVER (ORDER BY seq, user_id) AS k, * FROM ch
    WHERE user_id IN (SELECT user_id FROM adm) AND actor_id IN (SELECT user_id FROM adm)),
  f AS (SELECT 0 AS k, (SELECT list(user_id) FROM adm WHERE active) AS alive, CAST(NULL AS VARCHAR) AS fault
    UNION ALL SELECT st.k,
      CASE WHEN NOT list_contains(f.alive, st.actor_id) OR (NOT set_active AND (st.actor_id = st.user_id OR len(f.alive) <= 1))
        THEN f.alive
        WHEN set_active THEN list_distinct(list_append(f.alive, st.user_id))
        ELSE list_filter(f.alive, lambda x: x <> st.user_id) END,
      CASE WHEN NOT list_contains(f.alive, st.actor_id) THEN 'not allowed'
        WHEN NOT set_active AND st.actor_id = st.user_id THEN 'cannot deactivate self'
        WHEN NOT set_active AND len(f.alive) <= 1 THEN 'one active admin must remain' ELSE '' END
    FROM f JOIN st ON st.k = f.k + 1),
  reached AS (SELECT coalesce(st.seq, -1) AS at_seq, f.k, f.alive FROM f LEFT JOIN st USING (k)),
  upto AS (SELECT at_seq, arg_max(alive, k) AS alive FROM reached GROUP BY at_seq)
  SELECT ch.actor_id, ch.user_id, ch.set_active, ch.seq, CASE
    WHEN st.k IS NOT NULL THEN f.fault
    WHEN NOT coalesce(list_contains(upto.alive, ch.actor_id), false) THEN 'not allowed'
    WHEN u.user_id IS NULL THEN 'user not found' ELSE '' END AS fault
  FROM ch ASOF JOIN upto ON ch.seq >= upto.at_seq
  LEFT JOIN st ON st.seq = ch.seq AND st.user_id = ch.user_id LEFT JOIN f ON f.k = st.k
  LEFT JOIN users u ON u.user_id = ch.user_id""".replace("\n  , ch", ", ch")))
def user_status_changes(spark, sf):
    changes = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") * 10).alias("user_id"),
        (F.col("user_id") * 50 % 500).alias("actor_id"), (F.col("value") > 30).alias("set_active"),
    )
    accepted, rejected = V.user_status_changes(bound(spark, sf, "users"), changes)
    kept = accepted.drop("details").withColumn("fault", F.lit(""))
    return kept.unionByName(rejected)


@query("integrity_check", with_cte("users scans results", """
  SELECT 'results' AS table_name, 'scan' AS rule, CAST(result_id AS VARCHAR) AS row_key
  FROM (SELECT result_id, scan_id * 2 AS scan_id FROM results) WHERE scan_id NOT IN (SELECT scan_id FROM scans)
  UNION ALL SELECT 'scans', 'inspector', CAST(scan_id AS VARCHAR) FROM scans
  WHERE inspector_id NOT IN (SELECT user_id FROM users WHERE role = 'Inspector')"""))
def integrity_check(spark, sf):
    scans, users, results = usr("scans", "users", "results")(spark, sf)
    shifted = results.withColumn("scan_id", F.col("scan_id") * 2)
    return V.integrity_check(users.where("role = 'Inspector'"), scans, shifted)


SUBMITTED = """
  , subs AS (SELECT s.*, row_number() OVER (ORDER BY s.scan_id) AS rn FROM scans s
    JOIN users u ON u.user_id = s.inspector_id AND u.active AND u.role = 'Inspector' WHERE s.scan_id % 4 <> 0)"""


@query("submit_scans", with_cte("users scans results", SUBMITTED.strip() + """
  SELECT 100 + rn - 1 AS scan_id, inspector_id, status, evidence_notes,
    coalesce((SELECT arg_min(extracted_text, result_id) FROM results r
      WHERE r.scan_id = subs.scan_id AND rule_class = 'product_name'), '') AS product_name
  FROM (SELECT scan_id, inspector_id, rn, evidence_notes, 'PENDING' AS status FROM subs) subs"""
).replace("\n, subs", ", subs"))
def submit_scans(spark, sf):
    scans, users, results = usr("scans", "users", "results")(spark, sf)
    subs = scans.withColumnRenamed("scan_id", "submission_id")
    rows = results.select(
        F.col("scan_id").alias("submission_id"), F.col("result_id").alias("ord"), "rule_class",
        "extracted_text", "is_compliant", "penalty_amount", "reason",
    )
    made, _, _ = V.submit_scans(subs, rows, users, 100)
    return made.select("scan_id", "inspector_id", "status", "evidence_notes", "product_name")


@query("normalize_results", with_cte("results", """
  SELECT scan_id, result_id, rule_class, extracted_text, is_compliant,
    CAST(greatest(0, penalty_amount - 5000) AS BIGINT) AS penalty_amount,
    CASE WHEN reason <> 'N' THEN reason WHEN is_compliant
      THEN 'All detected declarations passed the configured checks.'
      ELSE 'The declaration is missing, unreadable, or failed a configured check.' END AS reason
  FROM results WHERE rule_class <> 'dates'"""))
def normalize_results(spark, sf):
    raw = bound(spark, sf, "results").select(
        "scan_id", "result_id",
        F.when(F.col("rule_class") == "dates", " ").otherwise(F.col("rule_class")).alias("rule_class"),
        "extracted_text", "is_compliant", (F.col("penalty_amount") - 5000).alias("penalty_amount"),
        F.when(F.col("reason") != "N", F.col("reason")).alias("reason"),
    )
    return V.normalize_results(raw, ["result_id"]).drop("parsed_data")


# --- policy -----------------------------------------------------------------

# A stored profile per nation: scope, severity and penalty vary with its key.
PROFILES = """
  SELECT CAST(n_nationkey AS BIGINT) AS profile_id, CAST(n_nationkey AS BIGINT) AS config_id,
    n_nationkey % 3 = 0 AS is_active, CAST(n_nationkey * 10 AS BIGINT) AS created_by,
    concat('{"profile_name": "', n_name, '", "rules": {',
      '"net_quantity": {"enabled": ', CASE WHEN n_nationkey % 2 = 0 THEN 'false' ELSE 'true' END,
      ', "severity": "minor", "penalty": ', CAST(n_nationkey * 2000 - 4000 AS STRING), '}, ',
      '"dates": {"severity": "grave", "penalty": "junk"}, "dietary_mark": {"penalty": 900}, ',
      '"unknown": {"penalty": 1}}}') AS payload
  FROM nation"""


def profiles(spark, sf):
    text = PROFILES.replace("{", "{{").replace("}", "}}").replace("FROM nation", "FROM {src}")
    return spark.sql(text, src=table(spark, sf, "nation"))


def _catalogue_sql() -> str:
    from labelwise.functions import fixed as K

    rows = ", ".join(
        "({}, '{}', '{}', '{}', '{}', {}, {})".format(i, r[0], r[1], r[2], r[3], r[4], r[5])
        for i, r in enumerate(K.RULE_CATALOGUE)
    )
    return f"cat(ord, rule_class, label, statute, severity, penalty, advisory) AS (VALUES {rows})"


RULES_CTE = _catalogue_sql() + """,
  rules AS (
    SELECT CAST(n_nationkey AS BIGINT) AS profile_id, n_name AS profile_name, ord, rule_class, label, statute,
      CASE WHEN rule_class = 'net_quantity' THEN 'Minor' ELSE severity END AS severity,
      NOT (rule_class = 'net_quantity' AND n_nationkey % 2 = 0) AS enabled,
      CASE WHEN rule_class = 'net_quantity' THEN greatest(0, least(25000, n_nationkey * 2000 - 4000))
           ELSE penalty END AS penalty, severity AS base_severity, penalty AS base_penalty
    FROM nation CROSS JOIN cat),
  versions AS (
    SELECT profile_id, sha256(concat('{"profile_name":"', any_value(profile_name), '","rules":{',
      string_agg(concat('"', rule_class, '":{"enabled":', CASE WHEN enabled THEN 'true' ELSE 'false' END,
        ',"penalty":', penalty, ',"severity":"', severity, '","statute":"', statute, '"}'), ',' ORDER BY rule_class),
      '},"schema_version":1}'))[1:12] AS config_version FROM rules GROUP BY profile_id),
  v AS (
    SELECT r.*, s.inspector_id % 25 AS profile_id FROM results r JOIN scans s USING (scan_id)),
  o AS (
    SELECT v.scan_id, v.result_id, v.rule_class, v.is_compliant, v.reason AS said, v.profile_id,
      g.label AS rule_label, g.profile_name, config_version, g.severity, g.statute, g.enabled AS in_scope,
      CAST(CASE WHEN g.enabled AND NOT is_compliant THEN g.penalty ELSE 0 END AS BIGINT) AS penalty_amount
    FROM v JOIN rules g ON g.profile_id = v.profile_id AND g.rule_class = v.rule_class
    JOIN versions z ON z.profile_id = v.profile_id)"""


def rules_sql(names: str, query: str) -> str:
    return with_cte(names, "~" + query).replace("\n~", ", " + RULES_CTE + "\n")


def overlaid(spark, sf):
    """Results judged under the profile of the inspector's office."""
    scans, results = usr("scans", "results")(spark, sf)
    rules = P.with_version(P.normalize_profiles(profiles(spark, sf)), ["profile_id"])
    snap = scans.select("scan_id", (F.col("inspector_id") % 25).alias("profile_id"))
    return P.apply_profile(results.join(snap, "scan_id"), rules, ["profile_id", "rule_class"])


@query("normalized_profiles", rules_sql("scans results", """
  SELECT profile_id, profile_name, rule_class, enabled, severity, CAST(penalty AS INTEGER) AS penalty, statute
  FROM rules"""))
def normalized_profiles(spark, sf):
    return P.normalize_profiles(profiles(spark, sf)).select(
        "profile_id", "profile_name", "rule_class", "enabled", "severity", "penalty", "statute"
    )


@query("profile_versions", rules_sql("scans results", "SELECT profile_id, config_version FROM versions"))
def profile_versions(spark, sf):
    rules = P.normalize_profiles(profiles(spark, sf))
    return P.profile_versions(rules, ["profile_id"]).select("profile_id", "config_version")


@query("profile_overlay", rules_sql("scans results", """
  SELECT scan_id, result_id, rule_class, is_compliant, rule_label, profile_name, config_version, severity, statute,
    in_scope, penalty_amount,
    CASE WHEN in_scope THEN concat(said, ' Assessed under ', statute, ' at ', lower(severity),
      ' severity (profile ''', profile_name, ''', config ', config_version, ').')
    ELSE concat('Out of scope for profile ''', profile_name, ''': this declaration was not assessed. ',
      'Configured basis: ', statute, '.') END AS reason
  FROM o"""))
def profile_overlay(spark, sf):
    return overlaid(spark, sf).select(
        "scan_id", "result_id", "rule_class", "is_compliant", "rule_label", "profile_name",
        "config_version", "severity", "statute", "in_scope",
        F.col("penalty_amount").cast("long").alias("penalty_amount"), "reason",
    )


@query("verdict_summary", rules_sql("scans results", """
  SELECT scan_id, count(*) AS total, count_if(in_scope) AS assessed, count_if(NOT in_scope) AS skipped,
    count_if(in_scope AND is_compliant) AS passed, count_if(in_scope AND NOT is_compliant) AS failed,
    CAST(sum(penalty_amount) AS BIGINT) AS penalty,
    count_if(in_scope AND NOT is_compliant AND severity = 'Critical') AS failed_critical,
    count_if(in_scope AND NOT is_compliant AND severity = 'Major') AS failed_major,
    count_if(in_scope AND NOT is_compliant AND severity = 'Minor') AS failed_minor,
    coalesce(arg_min(severity, list_position(['Critical', 'Major', 'Minor', 'Advisory'], severity))
      FILTER (in_scope AND NOT is_compliant), '') AS highest_severity,
    any_value(profile_name) AS profile_name, any_value(config_version) AS config_version
  FROM o GROUP BY scan_id"""))
def verdict_summary(spark, sf):
    return P.summarize_verdicts(overlaid(spark, sf), ["scan_id"]).drop("failed_advisory")


@query("profile_diff", rules_sql("scans results", """
  SELECT profile_id, concat_ws('; ', concat('profile renamed to ''', any_value(profile_name), ''''),
    string_agg(concat_ws('; ',
      CASE WHEN NOT enabled THEN concat(rule_class, ' set out of scope') END,
      CASE WHEN severity <> base_severity THEN concat(rule_class, ' severity ', base_severity, ' to ', severity) END,
      CASE WHEN penalty <> base_penalty THEN concat(rule_class, ' penalty ', base_penalty, ' to ', penalty) END),
      '; ' ORDER BY ord) FILTER (NOT enabled OR severity <> base_severity OR penalty <> base_penalty)) AS changes
  FROM rules GROUP BY profile_id"""))
def profile_diff(spark, sf):
    rules = P.normalize_profiles(profiles(spark, sf))
    diff = P.profile_diff(rules, P.default_profile(spark), ["profile_id"])
    return diff.select("profile_id", F.array_join("changes", "; ").alias("changes"))


@query("scope_split", rules_sql("scans results", """
  SELECT profile_id, string_agg(rule_class, ',' ORDER BY ord) FILTER (enabled) AS in_scope,
    coalesce(string_agg(rule_class, ',' ORDER BY ord) FILTER (NOT enabled), '') AS out_of_scope
  FROM rules GROUP BY profile_id"""))
def scope_split(spark, sf):
    split = P.scope_split(P.normalize_profiles(profiles(spark, sf)), ["profile_id"])
    return split.select(
        "profile_id", F.array_join("in_scope", ",").alias("in_scope"),
        F.array_join("out_of_scope", ",").alias("out_of_scope"),
    )


@query("active_profile", rules_sql("scans results", """
  SELECT CAST(24 AS BIGINT) AS config_id, rule_class, enabled, severity, CAST(penalty AS INTEGER) AS penalty
  FROM rules WHERE profile_id = 24"""))
def active_profile(spark, sf):
    return P.active_profile(profiles(spark, sf)).select(
        "config_id", "rule_class", "enabled", "severity", "penalty"
    )


@query("profile_history", with_cte("users", """
  SELECT config_id, coalesce(username, 'unknown') AS author FROM
    (SELECT CAST(n_nationkey AS BIGINT) AS config_id, n_nationkey * 1000 AS created_by FROM nation
     ORDER BY 1 DESC LIMIT 20) LEFT JOIN users ON user_id = created_by"""))
def profile_history(spark, sf):
    configs = profiles(spark, sf).withColumn("created_by", F.col("config_id") * 1000)
    return V.profile_history(configs, bound(spark, sf, "users"), 20).select("config_id", "author")


@query("activate_profiles", rules_sql("users scans results", """
  SELECT 100 + profile_id AS config_id, config_version, profile_id = (SELECT max(n_nationkey) FROM nation
      JOIN users ON user_id = n_nationkey * 10 WHERE role = 'Admin' AND active) AS is_active
  FROM versions WHERE profile_id * 10 IN (SELECT user_id FROM users WHERE role = 'Admin' AND active)
  UNION ALL SELECT profile_id, config_version, false FROM versions"""))
def activate_profiles(spark, sf):
    stored = profiles(spark, sf)
    versions = P.profile_versions(P.normalize_profiles(stored), ["config_id"])
    configs = versions.join(stored.select("config_id", "is_active", "created_by"), "config_id").withColumn(
        "created_at", F.lit("1998-01-01")
    )
    saves = stored.select(
        (F.col("config_id") + 100).alias("config_id"), "payload",
        F.col("created_by").alias("actor_id"), F.lit("1998-02-01").alias("ts"),
    )
    snapshot, _ = P.activate_profiles(configs, saves, bound(spark, sf, "users"), P.default_profile(spark))
    return snapshot.select("config_id", "config_version", "is_active")


@query("activation_audit", rules_sql("users scans results", """
  , diffs AS (SELECT profile_id, concat_ws(', ', concat('profile renamed to ''', any_value(profile_name), ''''),
      string_agg(concat_ws(', ',
        CASE WHEN NOT enabled THEN concat(rule_class, ' set out of scope') END,
        CASE WHEN severity <> base_severity THEN concat(rule_class, ' severity ', base_severity, ' to ', severity) END,
        CASE WHEN penalty <> base_penalty THEN concat(rule_class, ' penalty ', base_penalty, ' to ', penalty) END),
        ', ' ORDER BY ord) FILTER (NOT enabled OR severity <> base_severity OR penalty <> base_penalty)) AS changes,
      any_value(profile_name) AS profile_name FROM rules GROUP BY profile_id)
  SELECT CAST(profile_id * 10 AS BIGINT) AS actor_id, 'UPDATE_RULE_CONFIG' AS action,
    concat('Activated rule profile ''', profile_name, ''' (', config_version, '); ', changes) AS details, '1998-02-01' AS ts
  FROM diffs JOIN versions USING (profile_id) WHERE profile_id * 10 IN (SELECT user_id FROM users WHERE role = 'Admin' AND active)"""))
def activation_audit(spark, sf):
    """Who activated what, and how it differs from the shipped profile."""
    stored = profiles(spark, sf)
    versions = P.profile_versions(P.normalize_profiles(stored), ["config_id"])
    configs = versions.join(stored.select("config_id", "is_active", "created_by"), "config_id").withColumn("created_at", F.lit("1998-01-01"))
    saves = stored.select(
        (F.col("config_id") + 100).alias("config_id"), "payload", (F.col("config_id") * 10).alias("actor_id"), F.lit("1998-02-01").alias("ts"))
    _, audit = P.activate_profiles(configs, saves, bound(spark, sf, "users"), P.default_profile(spark))
    return audit.select("actor_id", "action", "details", "ts")


# activations arrive in no order of time, some of them at one time
ACTIVATED = """SELECT CAST(n_nationkey AS BIGINT) AS config_id,
    CAST(DATE '1993-01-01' + CAST((n_nationkey * 7) % 11 AS INT) * INTERVAL '200' DAY AS DATE) AS activated_at FROM nation"""


def activations(spark, sf):
    return spark.sql(ACTIVATED.replace("FROM nation", "FROM {src}"), src=table(spark, sf, "nation"))


@query("profile_validity", f"""
  SELECT config_id, activated_at AS valid_from, lead(activated_at) OVER o AS valid_to, lead(config_id) OVER o AS superseded_by
  FROM ({ACTIVATED}) WINDOW o AS (ORDER BY activated_at, config_id)""")
def profile_validity(spark, sf):
    return P.validity(activations(spark, sf)).select("config_id", "valid_from", "valid_to", "superseded_by")


@query("profiles_in_force", f"""WITH last AS (SELECT activated_at, max(config_id) AS config_id FROM ({ACTIVATED}) GROUP BY 1)
  SELECT o_orderkey AS scan_id, config_id FROM orders ASOF LEFT JOIN last ON CAST(o_orderdate AS DATE) >= activated_at""")
def profiles_in_force(spark, sf):
    """Each scan under the profile that was active at its time."""
    scans = bound(spark, sf, "scans").select("scan_id", F.col("ts").cast("date").alias("day"))
    return P.in_force(scans, activations(spark, sf), "day").select("scan_id", "config_id")


@query("rules_round_trip", rules_sql("scans results", "SELECT profile_id, config_version FROM versions"))
def rules_round_trip(spark, sf):
    stored = P.rules_to_profile(P.normalize_profiles(profiles(spark, sf)), ["profile_id"])
    again = P.normalize_profiles(stored.select("profile_id", "payload"))
    return P.profile_versions(again, ["profile_id"]).select("profile_id", "config_version")


@query("result_metadata", with_cte("results", """
  SELECT result_id, rule_class, scan_id % 3 <> 0 AS in_scope,
    CASE WHEN scan_id % 2 = 0 THEN 'Minor' WHEN rule_class IN ('net_quantity', 'pricing', 'manufacturer_info')
      THEN 'Critical' WHEN rule_class = 'batch_details' THEN 'Minor' ELSE 'Major' END AS severity
  FROM results"""))
def result_metadata(spark, sf):
    stored = bound(spark, sf, "results").withColumn(
        "parsed_data",
        F.to_json(F.struct(
            (F.col("scan_id") % 3 != 0).alias("in_scope"),
            F.when(F.col("scan_id") % 2 == 0, "Minor").alias("severity"),
        )),
    )
    return P.result_metadata(stored).select("result_id", "rule_class", "in_scope", "severity")


@query("drop_out_of_scope", rules_sql("scans results", """
  SELECT rule_class, count(*) AS n, CAST(sum(penalty_amount) AS BIGINT) AS penalty FROM o WHERE in_scope GROUP BY 1"""))
def drop_out_of_scope(spark, sf):
    kept = V.drop_out_of_scope(overlaid(spark, sf))
    return kept.groupBy("rule_class").agg(F.count("*").alias("n"), F.sum("penalty_amount").alias("penalty"))


@query("report_rows", rules_sql("users scans results", """
  SELECT o.scan_id, s.status, u.username AS inspector, o.rule_class, rule_label AS declaration,
    CASE WHEN in_scope THEN 'YES' ELSE 'NO' END AS in_scope, severity, statute,
    CASE WHEN NOT in_scope THEN 'NOT ASSESSED' WHEN o.is_compliant THEN 'PASS' ELSE 'FAIL' END AS is_compliant,
    penalty_amount,
    CASE o.scan_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('img/', o.scan_id, '.jpg')
      WHEN 2 THEN concat('img/', o.scan_id, '.jpg | img/back.jpg') ELSE 'a.jpg | c.jpg' END AS evidence_images
  FROM o JOIN scans s ON s.scan_id = o.scan_id JOIN users u ON u.user_id = s.inspector_id"""))
def report_rows(spark, sf):
    scans, users = usr("scans", "users")(spark, sf)
    rows = R.report_rows(V.with_inspector(scans, users), overlaid(spark, sf))
    return rows.select(
        "scan_id", "status", "inspector", "rule_class", "declaration", "in_scope", "severity",
        "statute", "is_compliant", "penalty_amount", "evidence_images",
    )


@query("result_rows", rules_sql("scans results", """
  SELECT rule_class, CASE WHEN NOT in_scope THEN 'NOT ASSESSED' WHEN is_compliant THEN 'PASS' ELSE 'FAIL' END AS status,
    severity, count(*) AS n, CAST(sum(penalty_amount) AS BIGINT) AS penalty FROM o GROUP BY 1, 2, 3"""))
def result_rows(spark, sf):
    return R.result_rows(overlaid(spark, sf)).groupBy("rule_class", "status", "severity").agg(
        F.count("*").alias("n"), F.sum("penalty").alias("penalty")
    )


@query("report_payload", rules_sql("scans results", """
  SELECT scan_id, count(*) AS total, count_if(in_scope) AS assessed,
    coalesce(string_agg(DISTINCT rule_class, ',' ORDER BY rule_class) FILTER (in_scope), '') AS assessed_classes,
    CAST(sum(penalty_amount) AS BIGINT) AS penalty, count(*) AS n_results
  FROM o GROUP BY scan_id"""))
def report_payload(spark, sf):
    scans = bound(spark, sf, "scans").withColumn("profile_id", F.col("inspector_id") % 25)
    rules = P.normalize_profiles(profiles(spark, sf))
    doc = R.report_payload(scans, overlaid(spark, sf), rules, ["profile_id"], "1998-06-30T00:00:00")
    return doc.select(
        "scan_id", "summary.total", "summary.assessed",
        F.array_join("rule_config.assessed_rule_classes", ",").alias("assessed_classes"),
        "summary.penalty", F.size("results").cast("long").alias("n_results"),
    )


@query("evolve_schema", """
  SELECT c_custkey AS user_id, c_name AS username, 1 AS active, 'Inspector' AS role FROM customer""")
def evolve_schema(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return S.evolve_schema(old, {"active": ("int", 1), "role": ("string", "Inspector")})


@query("coverage", with_cte("frames", """
  SELECT seq, CAST(n_det AS DOUBLE) / 7 AS coverage, CASE WHEN n_det < 7 THEN array_to_string((
    ['product_name', 'net_quantity', 'mrp_declaration', 'date_declarations', 'batch_number',
     'manufacturer_details', 'consumer_care_fssai'])[n_det + 1:], ',') ELSE '' END AS missing FROM frames"""))
def coverage(spark, sf):
    from labelwise.plans.bindings import frames

    return frames(spark, sf).select(
        "seq", Q.coverage(F.col("classes")).alias("coverage"),
        F.array_join(Q.missing_classes(F.col("classes")), ",").alias("missing"),
    )
