"""Review workflow: scoped reads, queues, decisions, audit analytics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions.predicates import path_list
from labelwise.operators.ordering import carry_forward, ranked
from labelwise.session import written


def _failed() -> Column:
    return ~F.coalesce(F.col("is_compliant"), F.lit(False))


# --- reads ------------------------------------------------------------------


def actor_scope(scans: DataFrame, users: DataFrame, actor_id: int) -> DataFrame:
    """Rows an actor may see: inspectors their own, verifiers and admins all.

    An inactive or unknown actor sees nothing.
    """
    actor = users.where((F.col("user_id") == actor_id) & F.col("active")).select(
        F.col("user_id").alias("_actor"), "role"
    )
    sees = (F.col("role").isin("Verifier", "Admin")) | (
        (F.col("role") == "Inspector") & (F.col("_actor") == F.col("inspector_id"))
    )
    return scans.join(F.broadcast(actor.limit(1)), sees, "left_semi")


def denied_actors(actors: DataFrame, users: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Audit rows ``(actor_id, action, details)`` of those ``actors (actor_id)`` who may not act in any of ``roles``.

    An unknown or inactive account is told apart from one whose role does not allow the action.
    """
    known = users.select(F.col("user_id").alias("actor_id"), "role", "active")
    gone = ~F.coalesce(F.col("active"), F.lit(False))
    details = F.when(gone, K.ACCOUNT_UNAVAILABLE).otherwise(F.lit(K.ROLE_REQUIRED.format(", ".join(roles))))
    asked = actors.select("actor_id").join(known, "actor_id", "left")
    return asked.where(gone | ~F.col("role").isin(*roles)).select("actor_id", F.lit("DENIED").alias("action"), details.alias("details"))


def history_search(scans_users: DataFrame, query: str = "", status: str = "ALL") -> DataFrame:
    """Status filter plus case-insensitive search over id, user, product and notes.

    ``%`` and ``_`` in the query keep their wildcard meaning.
    """
    wanted = status.upper().strip() or "ALL"
    if wanted != "ALL" and wanted not in K.SCAN_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    out = scans_users if wanted == "ALL" else scans_users.where(F.col("status") == wanted)
    text = query.strip()
    if not text:
        return out
    like = f"%{text}%"
    return out.where(
        F.col("scan_id").cast("string").ilike(like)
        | F.col("username").ilike(like)
        | F.col("product_name").ilike(like)
        | F.col("evidence_notes").ilike(like)
    )


def with_inspector(scans: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("user_id").alias("inspector_id"), "username")
    return scans.join(names, "inspector_id")


def history(
    scans: DataFrame, users: DataFrame, results: DataFrame, actor_id: int,
    query: str = "", status: str = "ALL", limit: int = 200,
) -> DataFrame:
    """Newest matching scans with their results; the limit counts scans."""
    k = max(1, min(int(limit), 1000))
    seen = actor_scope(scans, users, actor_id)
    found = history_search(with_inspector(seen, users), query, status)
    top = found.orderBy(F.desc("ts"), F.desc("scan_id")).limit(k)
    return top.join(results, "scan_id", "left")


def pending_queue(scans: DataFrame, users: DataFrame, results: DataFrame) -> DataFrame:
    """Pending scans with results, oldest first."""
    pending = scans.where("status = 'PENDING'")
    return (
        with_inspector(pending, users)
        .join(results, "scan_id", "left")
        .orderBy("ts", "scan_id", "result_id")
    )


def nest_scans(scans: DataFrame, results: DataFrame) -> DataFrame:
    """Scans with their results as an ordered array, empty when there are none.

    A scan's results are one row per rule class, so the array is bounded.
    """
    item = F.struct(
        "result_id", "rule_class", "extracted_text", "is_compliant", "penalty_amount", "reason"
    )
    nested = results.groupBy("scan_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    empty = F.slice(F.array(F.struct(*[
        F.lit(None).cast(results.schema[c].dataType).alias(c)
        for c in ["result_id", "rule_class", "extracted_text", "is_compliant", "penalty_amount", "reason"]
    ])), 1, 0)
    return scans.join(nested, "scan_id", "left").withColumn("results", F.coalesce("results", empty))


def history_table(scans: DataFrame, users: DataFrame, results: DataFrame) -> DataFrame:
    """Per scan: evidence count, passed, failed and penalty."""
    totals = results.groupBy("scan_id").agg(
        F.count_if(~_failed()).alias("passed"),
        F.count_if(_failed()).alias("failed"),
        F.sum(F.when(_failed(), F.col("penalty_amount")).otherwise(0)).alias("penalty"),
    )
    zero = F.lit(0)
    return with_inspector(scans, users).join(totals, "scan_id", "left").select(
        "scan_id",
        F.coalesce(F.nullif("product_name", F.lit("")), F.lit("Not detected")).alias("product"),
        F.col("username").alias("inspector"),
        "status",
        F.size(path_list(F.col("image_paths"))).alias("evidence"),
        F.coalesce("passed", zero).alias("passed"),
        F.coalesce("failed", zero).alias("failed"),
        F.coalesce("penalty", zero).alias("penalty"),
    )


# --- aggregates -------------------------------------------------------------


def audit_analytics(scans: DataFrame, results: DataFrame, users: DataFrame) -> DataFrame:
    """Headline totals in one row.

    Failing advisory rows count as violations too; they carry no penalty.
    Results fold to one row per scan before totals, so no distinct runs over
    the raw rows.
    """
    per_scan = results.where(_failed()).groupBy("scan_id").agg(
        F.count("*").alias("n"), F.sum("penalty_amount").alias("p")
    )
    bad = per_scan.agg(
        F.count("*").alias("failed_scans"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_violations"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("total_penalty"),
    )
    total = scans.agg(F.count("*").alias("total_scans"))
    active = users.where("active").agg(F.count("*").alias("active_users"))
    one = F.lit(True)  # each side is exactly one row
    return (
        total.join(F.broadcast(bad), one)
        .join(F.broadcast(active), one)
        .withColumn(
            "failure_rate",
            F.when(F.col("total_scans") > 0, F.col("failed_scans") / F.col("total_scans") * 100).otherwise(0.0),
        )
    )


def status_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("status").agg(F.count("*").alias("n"))


def violations_by_rule(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("rule_class")
        .agg(F.count("*").alias("total"), F.count_if(_failed()).alias("violations"))
        .orderBy(F.desc("violations"), "rule_class")
    )


def queue_metrics(scans: DataFrame, results: DataFrame) -> DataFrame:
    pending = scans.where("status = 'PENDING'").select("scan_id")
    n = pending.agg(F.count("*").alias("pending_scans"))
    owed = (
        results.where(_failed())
        .join(pending, "scan_id", "left_semi")
        .agg(
            F.count("*").alias("pending_violations"),
            F.coalesce(F.sum("penalty_amount"), F.lit(0)).alias("pending_penalty"),
        )
    )
    return n.join(F.broadcast(owed), F.lit(True))


# --- ordered lists ----------------------------------------------------------


def list_users(users: DataFrame) -> DataFrame:
    rank = F.when(F.col("role") == "Admin", 1).when(F.col("role") == "Verifier", 2).otherwise(3)
    return users.orderBy(rank, "username")


def newest(df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(key))
    return out if k is None else out.limit(max(1, min(k, 1000)))


def with_actor(events: DataFrame, users: DataFrame, actor: str, name: str, missing=None) -> DataFrame:
    """Name the actor of each row; apply after any limit so the join stays small."""
    names = users.select(F.col("user_id").alias(actor), F.col("username").alias(name))
    out = events.join(names, actor, "left")
    return out if missing is None else out.withColumn(name, F.coalesce(name, F.lit(missing)))


def audit_log(events: DataFrame, users: DataFrame, k: int = 200) -> DataFrame:
    return with_actor(newest(events, "event_id", k), users, "actor_id", "actor_username")


def profile_history(configs: DataFrame, users: DataFrame, k: int = 20) -> DataFrame:
    top = newest(configs, "config_id", k)
    return with_actor(top, users, "created_by", "author", "unknown")


# --- writes as jobs ---------------------------------------------------------


def normalize_results(results: DataFrame, control: list[str] | None = None) -> DataFrame:
    """Tidy raw verdict rows for storage; extra columns fold into ``parsed_data``."""
    known = ["scan_id", "ord", "rule_class", "extracted_text", "is_compliant", "penalty_amount",
             "reason", "parsed_data", *(control or [])]
    extra = [c for c in results.columns if c not in known]
    ok = F.coalesce(F.col("is_compliant"), F.lit(False))
    said = F.nullif(F.trim(F.coalesce("reason", F.lit(""))), F.lit(""))
    parsed = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    if "parsed_data" in results.columns:
        parsed = F.coalesce("parsed_data", parsed)
    amount = F.col("penalty_amount").cast("string").try_cast("double").try_cast("long")
    return results.where(F.trim(F.coalesce("rule_class", F.lit(""))) != "").select(
        *[c for c in ["scan_id", "ord", *(control or [])] if c in results.columns],
        F.trim("rule_class").alias("rule_class"),
        F.coalesce("extracted_text", F.lit("")).alias("extracted_text"),
        ok.alias("is_compliant"),
        F.greatest(F.lit(0), F.coalesce(amount, F.lit(0))).alias("penalty_amount"),
        F.coalesce(said, F.when(ok, K.STORED_PASS_REASON).otherwise(K.STORED_FAIL_REASON)).alias("reason"),
        parsed.alias("parsed_data"),
    )


def drop_out_of_scope(overlaid: DataFrame) -> DataFrame:
    return overlaid.where("in_scope")


def submit_scans(
    submissions: DataFrame, results: DataFrame, users: DataFrame, next_id: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions to scan, result and audit rows.

    Only active inspectors submit and a scan needs at least one image path.
    Ids continue from ``next_id`` in submission order without a single-task sort.
    """
    inspectors = users.where("active and role = 'Inspector'").select(
        F.col("user_id").alias("inspector_id")
    )
    good = submissions.withColumn("paths", path_list(F.col("image_paths"))).where(
        F.size("paths") > 0
    ).join(inspectors, "inspector_id", "left_semi")
    numbered = ranked(good, [], ["submission_id"], "_rn").withColumn("scan_id", F.col("_rn") + next_id - 1)
    tidy = normalize_results(results, ["submission_id"])
    ids = numbered.select("submission_id", "scan_id")
    rows = tidy.join(ids, "submission_id")
    named = rows.where(F.col("rule_class").isin("product_name", "product_name_region"))
    product = named.groupBy("scan_id").agg(
        F.min_by("extracted_text", F.struct("ord", "rule_class")).alias("product_name")
    )
    scans = numbered.drop("product_name").join(product, "scan_id", "left").select(
        "scan_id", "inspector_id", "paths", F.lit("PENDING").alias("status"), "ts",
        F.coalesce("product_name", F.lit("")).alias("product_name"),
        F.trim(F.coalesce("evidence_notes", F.lit(""))).alias("evidence_notes"),
    )
    audit = numbered.select(
        F.col("inspector_id").alias("actor_id"), "scan_id", F.lit("SUBMIT_SCAN").alias("action"),
        F.format_string("Submitted %d evidence image(s)", F.size("paths")).alias("details"), "ts",
    )
    return scans, rows.drop("submission_id"), audit


def apply_reviews(
    scans: DataFrame, decisions: DataFrame, users: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judge review decisions: updated scans, audit rows, rejected decisions.

    A decision needs a known status and scan, an active verifier or admin, a
    reason when overriding, and a pending scan (or no change of status).  The
    first acceptable decision per scan wins; later ones see its result.  A decision's
    time ``ts`` becomes the scan's ``reviewed_at``, unless it leaves the scan pending, and the audit row's.
    """
    if "ts" not in decisions.columns:
        decisions = decisions.withColumn("ts", F.lit(None).cast("timestamp"))
    reviewers = users.where("active").select(F.col("user_id").alias("actor_id"), "role")
    d = (
        decisions.withColumn("new_status", F.upper(F.trim("new_status")))
        .join(scans.select("scan_id", "status"), "scan_id", "left")
        .join(reviewers, "actor_id", "left")
    )
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    fault = (
        F.when(~F.col("new_status").isin(K.SCAN_STATUSES), "unknown status")
        .when(F.col("status").isNull(), "scan not found")
        .when(~F.coalesce(F.col("role").isin("Verifier", "Admin"), F.lit(False)), "not allowed")
    )
    override = F.when((F.col("new_status") == "OVERRIDDEN") & blank, "override needs a reason")
    checked = d.withColumn("fault", fault).withColumn("override_fault", override)
    # the decision that moves each pending scan: an aggregate, not a window over a hot scan
    able = F.col("fault").isNull() & F.col("override_fault").isNull()
    moves = checked.where(able & (F.col("status") == "PENDING") & (F.col("new_status") != "PENDING"))
    first = moves.groupBy("scan_id").agg(
        F.min("seq").alias("_seq"), F.min_by("new_status", "seq").alias("_to")
    )
    j = checked.join(first, "scan_id", "left")
    now = F.when(F.col("_seq").isNotNull() & (F.col("seq") > F.col("_seq")), F.col("_to")).otherwise(
        F.col("status")
    )
    late = F.when((now != "PENDING") & (F.col("new_status") != now), "only pending scans can move")
    judged = j.withColumn("fault", F.coalesce("fault", late, "override_fault"))
    accepted = judged.where("fault is null")
    last = accepted.groupBy("scan_id").agg(
        F.max_by(F.struct("new_status", "actor_id", "reason", "ts"), "seq").alias("r")
    )
    updated = scans.join(last, "scan_id", "left").select(
        *[c for c in scans.columns if c != "status"],
        F.coalesce("r.new_status", "status").alias("status"),
        F.col("r.actor_id").alias("reviewer_id"),
        F.when(F.col("r.new_status") != "PENDING", F.col("r.ts")).alias("reviewed_at"),
        F.trim(F.coalesce("r.reason", F.lit(""))).alias("review_reason"),
    )
    audit = accepted.select(
        "actor_id", "scan_id", F.concat(F.lit("SCAN_"), "new_status").alias("action"),
        F.trim(F.coalesce("reason", F.lit(""))).alias("details"), "seq", "ts",
    )
    rejected = judged.where("fault is not null").select(
        "scan_id", "actor_id", "new_status", "seq", "fault"
    )
    return updated, audit, rejected


#: Changes among administrators that are judged together, and the shape of a block's outcome.
BLOCK_CHANGES = 100_000
_OUTCOME = "blk long, seq long, actor_id long, user_id long, set_active boolean, fault string, flag boolean, turn long"


def _judge_block(steps: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """One block under its entry state: a row for each step with its fault, and one with the exit ``flag`` of each
    administrator it touches; a row without a user has the change in the number of active ones."""
    if steps.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in _OUTCOME.split(", ")])
    known = entry[entry["user_id"].notna()]
    flags = dict(zip(known["user_id"].astype("int64"), known["flag"].astype(bool)))
    count = started = int(entry.loc[entry["user_id"].isna(), "n"].iloc[0])
    steps = steps.sort_values(["turn"])
    faults = []
    for actor, user, to in zip(steps["actor_id"], steps["user_id"], steps["set_active"]):
        fault = None
        if not flags[actor]:
            fault = "not allowed"
        elif actor == user and not to:
            fault = "cannot deactivate self"
        elif not to and count <= 1:
            fault = "one active admin must remain"
        else:
            count += int(to) - int(flags[user])
            flags[user] = bool(to)
        faults.append(fault)
    out = steps[["blk", "seq", "actor_id", "user_id", "set_active", "turn"]].assign(fault=faults, flag=None)
    exits = pd.DataFrame({"user_id": list(flags), "flag": list(flags.values())}).assign(blk=out["blk"].iloc[0], turn=None)
    moved = pd.DataFrame({"blk": [out["blk"].iloc[0]], "turn": [count - started]})
    both = pd.concat([out.astype(object), exits.astype(object), moved.astype(object)], ignore_index=True)
    return both.reindex(columns=[c.split()[0] for c in _OUTCOME.split(", ")])


def _entries(touched: DataFrame, blocks: DataFrame, start: DataFrame, outcome: DataFrame | None) -> DataFrame:
    """``(blk, user_id, flag, n)``: what each block meets.  A flag is the exit flag of the last block before that touches
    the administrator, the number of active ones the sum of the changes of all blocks before; both start from ``start``."""
    first = start.select(F.lit(-1).cast("long").alias("blk"), "user_id", F.col("active").alias("flag"))
    count = start.agg(F.count_if("active").alias("n0"))
    moved = blocks.withColumn("moved", F.lit(0).cast("long"))
    exits = touched.select("blk", "user_id", F.lit(None).cast("boolean").alias("flag"))
    if outcome is not None:
        exits = outcome.where("seq IS NULL AND user_id IS NOT NULL").select("blk", "user_id", "flag")
        moved = outcome.where("user_id IS NULL").select("blk", F.col("turn").alias("moved"))
    before = Window.partitionBy("user_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    flags = first.unionByName(exits).withColumn("flag", F.last("flag", ignorenulls=True).over(before)).where("blk >= 0")
    ahead = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    counts = moved.withColumn("moved", F.coalesce(F.sum("moved").over(ahead), F.lit(0))).join(F.broadcast(count), F.lit(True))
    return flags.select("blk", "user_id", "flag", F.lit(None).cast("long").alias("n")).unionByName(
        counts.select("blk", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("boolean").alias("flag"), (F.col("n0") + F.col("moved")).alias("n"))
    )


def _judged_steps(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Changes among administrators with their faults, block by block in parallel.

    Every block is judged under what it is thought to meet (at first, the starting state), and reports the flags it
    leaves and the change in their number.  A running fold over these small reports gives each block its entry state
    anew, and only blocks that meet something else than they were judged by are judged again.  The first wrong
    block is right a round later, so the rounds end at the sequential result, as a rule after two or three of them.
    """
    touched = steps.select("blk", F.explode(F.array("actor_id", "user_id")).alias("user_id")).distinct()
    blocks = steps.select("blk").distinct()
    entry = written(_entries(touched, blocks, start, None))
    again, outcome = steps, None
    while True:
        fresh = again.groupBy("blk").cogroup(entry.groupBy("blk")).applyInPandas(_judge_block, _OUTCOME)
        if outcome is not None:
            fresh = fresh.unionByName(outcome.join(stale, "blk", "left_anti"))
        outcome = written(fresh)
        met = written(_entries(touched, blocks, start, outcome))
        same = F.col("m.user_id").eqNullSafe(F.col("e.user_id")) & (F.col("m.blk") == F.col("e.blk"))
        differs = ~F.col("m.flag").eqNullSafe(F.col("e.flag")) | ~F.col("m.n").eqNullSafe(F.col("e.n"))
        stale = written(met.alias("m").join(entry.alias("e"), same).where(differs).select("m.blk").distinct())
        if stale.isEmpty():
            return outcome.where("seq IS NOT NULL")
        again, entry = steps.join(stale, "blk", "left_semi"), met


def user_status_changes(
    users: DataFrame, changes: DataFrame, block_rows: int = BLOCK_CHANGES
) -> tuple[DataFrame, DataFrame]:
    """Judge activation changes in order: accepted with audit text, and rejected with fault.

    Every change is judged by the accounts as the accepted changes before it left them: only an active
    admin may change accounts, no one deactivates themselves, and one active admin always remains.
    Changes to admins decide this alone; they are cut into blocks of ``block_rows`` that are judged in parallel.
    All other changes look up their actor's state at their time.
    """
    admins = users.where("role = 'Admin'").select(F.col("user_id").cast("long").alias("user_id"), "active")
    known = users.select("user_id", F.col("role").alias("t_role"))
    longs = [F.col(c).cast("long").alias(c) for c in ("seq", "actor_id", "user_id")]
    asked = changes.join(known, "user_id", "left").select(*longs, "set_active", "t_role")
    of_admins = asked.where("t_role = 'Admin'")
    actors = admins.select(F.col("user_id").alias("actor_id"))
    numbered = ranked(of_admins.join(actors, "actor_id", "left_semi").drop("t_role"), [], ["seq", "user_id"], "turn")
    steps = written(numbered.withColumn("blk", F.expr(f"(turn - 1) div {block_rows}")))
    folded = _judged_steps(steps, admins)
    # what each admin is from each accepted step on, and every change's actor looked up in that
    states = admins.select(F.col("user_id").alias("actor_id"), F.lit(-1).cast("long").alias("seq"), F.col("active").alias("state")).unionByName(
        folded.where("fault is null").select(F.col("user_id").alias("actor_id"), "seq", F.col("set_active").alias("state"))
    )
    others = asked.where("t_role is null or t_role <> 'Admin'").withColumn("kind", F.lit(1))
    events = states.withColumn("kind", F.lit(0)).unionByName(others, allowMissingColumns=True)
    looked = carry_forward(ranked(events, ["actor_id"], ["seq", "kind"]), ["actor_id"], F.col("state"), "may").where("kind = 1")
    plain = looked.select(
        "actor_id", "user_id", "set_active", "seq",
        F.when(~F.coalesce("may", F.lit(False)), "not allowed").when(F.col("t_role").isNull(), "user not found").alias("fault"),
    )
    outside = of_admins.join(actors, "actor_id", "left_anti").select(
        "actor_id", "user_id", "set_active", "seq", F.lit("not allowed").alias("fault")
    )
    judged = plain.unionByName(outside).unionByName(folded.select("actor_id", "user_id", "set_active", "seq", "fault"))
    accepted = judged.where("fault is null").select(
        "actor_id", "user_id", "set_active", "seq",
        F.format_string("User %d active=%s", "user_id", F.initcap(F.col("set_active").cast("string"))).alias("details"),
    )
    return accepted, judged.where("fault is not null")


def integrity_check(users: DataFrame, scans: DataFrame, results: DataFrame) -> DataFrame:
    """Rows that break an enum, sign or foreign-key rule."""
    def bad(df: DataFrame, rule: str, table: str, key: str) -> DataFrame:
        return df.select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
            F.col(key).cast("string").alias("row_key"),
        )

    user_ids = users.select(F.col("user_id").alias("inspector_id"))
    return (
        bad(users.where(~F.col("role").isin(K.ROLES)), "role", "users", "user_id")
        .unionByName(bad(scans.where(~F.col("status").isin(K.SCAN_STATUSES)), "status", "scans", "scan_id"))
        .unionByName(bad(scans.join(user_ids, "inspector_id", "left_anti"), "inspector", "scans", "scan_id"))
        .unionByName(bad(results.where("penalty_amount < 0"), "penalty", "results", "result_id"))
        .unionByName(
            bad(results.join(scans.select("scan_id"), "scan_id", "left_anti"), "scan", "results", "result_id")
        )
    )


def evidence_hashes(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths`` with the ``hash`` of each listed file, '' and ``missing`` where there is none to read.

    ``files`` is what ``evidence_files`` reads.
    """
    return paths.join(files.select("path", "hash"), "path", "left").select(
        *paths.columns,
        F.coalesce("hash", F.lit("")).alias("hash"),
        F.when(F.col("hash").isNull(), "missing").otherwise("read").alias("status"),
    )
