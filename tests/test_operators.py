"""Operators on small fixtures: logs, readings, profiles, labels, frames."""

import hashlib
import json

import os

import pytest
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import predicates as Q
from labelwise.functions import spans as S
from labelwise.functions import text as X
from labelwise.functions.register import register
from labelwise.operators import clean as CL
from labelwise.operators import labels as L
from labelwise.operators import policy as P
from labelwise.operators import readings as C
from labelwise.operators import review as V
from labelwise.operators import spanjoin as J
from labelwise.operators import sweep as W
from labelwise.sources import readers as R

LOG = "record_type string, image_path string, detection_index int, canonical_class string, ocr_text string, ln long"


def log(spark, rows):
    return spark.createDataFrame(
        [(t, i, d, "net_quantity", x, n) for n, (t, i, d, x) in enumerate(rows)], LOG
    )


def passes(spark, rows):
    return [r.ocr_text for r in W.newest_pass(log(spark, rows)).orderBy("ln").collect()]


def test_newest_pass(spark):
    det, done = "detection", ("image_done", "a", None, None)
    assert passes(spark, [(det, "a", 0, "old"), done, (det, "a", 0, "new"), (det, "a", 1, "n2"), done]) == ["new", "n2"]
    assert passes(spark, [(det, "a", 0, "old"), (det, "a", 1, "o2"), (det, "a", 0, "new")]) == ["new"]
    assert passes(spark, [(det, "a", 0, "only"), done, done]) == ["only"]
    assert passes(spark, [(det, "a", 0, "x"), done, (det, "a", 3, "y")]) == ["y"]


def test_completed_images(spark):
    rows = [("detection", i, 0, "t") for i in ("a", "b", "c")]
    done = {r.image_path for r in W.completed_images(log(spark, rows)).collect()}
    assert done == {"a", "b"}
    marked = {r.image_path for r in W.completed_images(log(spark, [*rows, ("image_done", "c", None, None)])).collect()}
    assert marked == {"a", "b", "c"}


def test_torn_lines_do_not_stop_the_reader(spark, tmp_path):
    good = json.dumps({"record_type": "detection", "image_path": "a", "ocr_text": "x"})
    (tmp_path / "log.jsonl").write_text(f"{good}\n{good[:20]}\n\n{good}\n")
    assert R.read_sweep_log(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("rows,alert", [
    ([(1, 1), (1, 1), (4, 1), (4, 1)], 1), ([(1, 1)] * 8, None), ([(1, 0)] * 4, None),
])
def test_slowdown(spark, rows, alert):
    done = spark.createDataFrame([(i, float(s), c) for i, (s, c) in enumerate(rows)], "ln long, seconds double, crops int")
    buckets = W.throughput_buckets(done, 2)
    got = W.slowdown_alert(buckets, 2).collect()
    assert [r.bucket for r in got] == ([] if alert is None else [alert])


def test_throughput_overall(spark):
    done = spark.createDataFrame([(0, 10.0, 10), (1, 2.0, 1)], "ln long, seconds double, crops int")
    assert W.throughput_rates(W.throughput_buckets(done, 2)).first().overall == pytest.approx(12 / 11)


@pytest.mark.parametrize("texts,want", [
    (["MRP: Rs 29.00", "mrp rs29,00"], "MRP: Rs 29.00"), (["-", "/"], "- /"), (["", "   ", "500 g"], "500 g"),
])
def test_join_readings(spark, texts, want):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "scan string, i int, text string")
    assert C.join_readings(df, ["scan"], ["i"]).first().text == want


def test_candidates(spark):
    rows = [("a", 0, "plain", "x" * 40, 0.95, 1.0, True, 1.0), ("a", 1, "enhanced", "y" * 40, 0.99, 1.0, True, 1.0),
            ("b", 0, "plain", "", 0.9, 0.0, False, 1.0)]
    df = spark.createDataFrame(rows, "image string, variant_ord int, variant string, text string, conf double, signal double, compliant boolean, seconds double")
    df = df.withColumn("score", C.candidate_score(F.col("text"), F.col("conf"), F.col("signal")))
    kept = C.early_stop(df, ["image"])
    assert kept.count() == 2
    best = {r.image: r for r in C.best_candidate(kept, ["image"]).collect()}
    assert best["a"].variant == "plain" and best["a"].score == pytest.approx(0.475 + 0.35 + 0.15)
    assert best["b"].variant is None and best["b"].text == ""


def test_lines_read_in_order(spark):
    rows = [("a", "29.00", 0.9, 90, 10, 180, 26), ("a", "MRP", 0.1, 10, 11, 60, 27), ("a", "below", 0.5, 0, 60, 40, 76)]
    df = spark.createDataFrame(rows, "image string, text string, conf double, x1 int, y1 int, x2 int, y2 int")
    r = C.result_lines(df, ["image"]).first()
    assert r.text == "MRP 29.00 below" and r.lines == 3
    assert r.conf == pytest.approx((5 * 0.9 + 3 * 0.1 + 5 * 0.5) / 13)


def canonical(name, changes):
    rules = {c: {"enabled": True, "severity": s, "penalty": p, "statute": st} for c, _, st, s, p, _ in K.RULE_CATALOGUE}
    for c, change in changes.items():
        rules[c].update(change)
    doc = {"schema_version": 1, "profile_name": name, "rules": rules}
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def test_profile_versions_match_canonical_json(spark):
    payloads = [
        (1, json.dumps({"profile_name": "Größe 标签", "rules": {"net_quantity": {"enabled": False}}})),
        (2, json.dumps({"rules": {"pricing": {"penalty": 10_000_000}, "dates": {"penalty": -5, "severity": "minor"}}})),
        (3, "not json"),
    ]
    df = spark.createDataFrame(payloads, "pid long, payload string")
    got = {r.pid: r.config_version for r in P.profile_versions(P.normalize_profiles(df), ["pid"]).collect()}
    assert got == {
        1: canonical("Größe 标签", {"net_quantity": {"enabled": False}}),
        2: canonical(K.DEFAULT_PROFILE_NAME, {"pricing": {"penalty": 25000}, "dates": {"penalty": 0, "severity": "Minor"}}),
        3: canonical(K.DEFAULT_PROFILE_NAME, {}),
    }


def test_profile_never_flips_a_verdict(spark):
    verdicts = spark.createDataFrame(
        [("s", "product_name", True, "ok", 0), ("s", "net_quantity", False, "bad", 25000), ("s", "odd_class", False, "odd", 9)],
        "scan_id string, rule_class string, is_compliant boolean, reason string, penalty_amount int")
    raw = spark.createDataFrame([(1, json.dumps({"rules": {"net_quantity": {"severity": "Minor", "penalty": 5000}}}))], "pid long, payload string")
    rules = P.with_version(P.normalize_profiles(raw), ["pid"])
    out = {r.rule_class: r for r in P.apply_profile(verdicts, rules, ["rule_class"]).collect()}
    assert not out["net_quantity"].is_compliant and out["net_quantity"].penalty_amount == 5000
    assert out["odd_class"].severity == "Unclassified" and out["odd_class"].penalty_amount == 0
    s = P.summarize_verdicts(P.apply_profile(verdicts, rules, ["rule_class"]), ["scan_id"]).first()
    assert (s.total, s.failed, s.penalty, s.highest_severity) == (3, 2, 5000, "Minor")


LABELS = "split string, file string, content string"


def test_label_audit_and_verify(spark):
    box = "5 0.500000 0.500000 0.200000 0.100000"
    poly = "1 0.10 0.10 0.30 0.10 0.30 0.20 0.10 0.20"
    files = spark.createDataFrame(
        [("train", "clean.txt", f"{box}\n\n{box}\n"), ("train", "mixed.txt", f"{box}\n{poly}\n"),
         ("valid", "odd.txt", "banana 0.1 0.2\n0 0.5 0.5 0.002 0.002\n"), ("valid", "empty.txt", "\n")], LABELS)
    rows = R.read_label_rows(files)
    audit = {r.split: r for r in L.label_audit(rows, files.drop("content")).collect()}
    t = audit["train"]
    assert (t.files, t.rows, t.bbox_rows, t.polygon_rows, t.mixed_files, t.corrupted_rows) == (2, 4, 3, 1, 1, 1)
    assert audit["valid"].empty_files == 1 and audit["valid"].unknown_rows == 1 and audit["valid"].tiny_rows == 1
    assert audit["all"].rows == 6
    assert [r.line for r in rows.where("file = 'clean.txt'").orderBy("line").collect()] == [1, 3]
    fixed = L.repair_rows(rows).where("file = 'mixed.txt'").orderBy("line").collect()
    assert [r.fixed for r in fixed] == [box, "1 0.200000 0.150000 0.200000 0.100000"]
    again = L.repair_rows(R.read_label_rows(spark.createDataFrame(
        [("train", "mixed.txt", "\n".join(r.fixed for r in fixed))], LABELS)))
    assert again.where("changed").count() == 0
    assert {r.problem for r in L.verify_rows(rows, 3).where("file = 'mixed.txt'").collect()} == {
        "field_count", "class_range", "relocated"}


def test_predicates(spark):
    df = spark.createDataFrame([('["a", " ", "b"]',), ("a, b,,",), ("",), (None,)], "p string")
    assert [r.x for r in df.select(Q.path_list(F.col("p")).alias("x")).collect()] == [["a", "b"], ["a", "b"], [], []]
    assert df.select(Q.canonical_class(F.lit(" Brand Region ")).alias("c")).first().c == "product_name"


def test_review_rules(spark):
    users = spark.createDataFrame([(1, "v", "Verifier", True), (2, "i", "Inspector", True), (3, "off", "Admin", False)],
                                  "user_id long, username string, role string, active boolean")
    scans = spark.createDataFrame([(10, "PENDING"), (11, "APPROVED"), (12, "PENDING"), (13, "PENDING")], "scan_id long, status string")
    dec = spark.createDataFrame(
        [(1, 10, 1, "OVERRIDDEN", " "), (2, 10, 1, "approved", ""), (3, 10, 1, "OVERRIDDEN", "late"), (4, 11, 1, "PENDING", ""),
         (5, 12, 2, "APPROVED", ""), (6, 12, 3, "APPROVED", ""), (7, 99, 1, "APPROVED", ""), (8, 13, 1, "OVERRIDDEN", "why")],
        "seq long, scan_id long, actor_id long, new_status string, reason string")
    updated, audit, rejected = V.apply_reviews(scans, dec, users)
    assert {r.scan_id: r.status for r in updated.collect()} == {10: "APPROVED", 11: "APPROVED", 12: "PENDING", 13: "OVERRIDDEN"}
    assert sorted(r.seq for r in audit.collect()) == [2, 8]
    assert {r.seq: r.fault for r in rejected.collect()} == {
        1: "override needs a reason", 3: "only pending scans can move", 4: "only pending scans can move",
        5: "not allowed", 6: "not allowed", 7: "scan not found"}


def test_shuffled_vocabulary_gives_the_same_text(spark, monkeypatch):
    df = spark.createDataFrame([(1, "trur| CARE Manutactured bv ACME"), (2, "NETWEIGHT150g"), (3, "")], "i int, t string")
    want = {r.i: r.clean for r in CL.clean_corpus(df, ["i"], "t").collect()}
    monkeypatch.setattr(CL, "LITERAL_WORDS", 0)
    assert {r.i: r.clean for r in CL.clean_corpus(df, ["i"], "t").collect()} == want
    assert want[1] == "OUR, CARE MANUFACTURED BY ACME"


def test_rows_that_share_a_key_are_cleaned_each(spark, monkeypatch):
    df = spark.createDataFrame([(1, "trur| CARE"), (1, "Manutactured bv ACME")], "i int, t string")
    want = sorted(r.clean for r in CL.clean_corpus(df, ["i"], "t").collect())
    monkeypatch.setattr(CL, "LITERAL_WORDS", 0)
    assert sorted(r.clean for r in CL.clean_corpus(df, ["i"], "t").collect()) == want


def test_a_long_run_of_look_alikes_is_repaired_whole(spark):
    df = spark.createDataFrame([("12" + "O" * 60 + "Z",)], "t string")
    assert df.select(X.heal_numbers(F.col("t")).alias("h")).first().h == "12" + "0" * 60 + "Z"


def test_admins_are_judged_by_the_state_at_their_turn(spark):
    users = spark.createDataFrame([(1, "Admin", True), (2, "Admin", True), (3, "Admin", True), (9, "Viewer", True)], "user_id long, role string, active boolean")
    rows = [(1, 2, False, 1), (2, 9, False, 2), (1, 3, False, 3), (1, 2, True, 4), (2, 1, False, 5), (2, 2, False, 6), (2, 7, True, 7), (1, 9, True, 8)]
    changes = spark.createDataFrame(rows, "actor_id long, user_id long, set_active boolean, seq long")
    accepted, rejected = V.user_status_changes(users, changes)
    assert sorted(r.seq for r in accepted.collect()) == [1, 3, 4, 5]
    assert {r.seq: r.fault for r in rejected.collect()} == {
        2: "not allowed", 6: "cannot deactivate self", 7: "user not found", 8: "not allowed"}


@pytest.mark.parametrize("block_rows", [3, 7, 1_000_000])
def test_account_changes_in_blocks_equal_one_fold(spark, block_rows):
    import random
    rnd = random.Random(block_rows)
    users = [(k, "Admin" if k < 6 else "Viewer", k % 2 == 0) for k in range(10)]
    rows = [(rnd.randint(0, 7), rnd.randint(0, 11), rnd.random() < 0.45, s) for s in range(60)]
    state = {u: a for u, r, a in users if r == "Admin"}
    want = {}
    for actor, user, to, seq in rows:
        if not state.get(actor, False):
            want[seq] = "not allowed"
        elif user > 9:
            want[seq] = "user not found"
        elif user in state and not to and actor == user:
            want[seq] = "cannot deactivate self"
        elif user in state and not to and sum(state.values()) <= 1:
            want[seq] = "one active admin must remain"
        else:
            want[seq] = None
            if user in state:
                state[user] = to
    accepted, rejected = V.user_status_changes(
        spark.createDataFrame(users, "user_id long, role string, active boolean"),
        spark.createDataFrame(rows, "actor_id long, user_id long, set_active boolean, seq long").repartition(4), block_rows)
    got = {r.seq: None for r in accepted.collect()} | {r.seq: r.fault for r in rejected.collect()}
    assert got == want


def test_log_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    for f in ("b", "a", "c"):
        lines = []
        for k in range(300):
            lines.append('{"record_type": "detection", "image_path": "%s%03d", "crops": %d}' % (f, k, k))
            if k % 50 == 7:
                lines += ["", '{"record_type": "dete']
        (tmp_path / f"{f}.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "d.json").write_text('{"record_type": "image_done", "image_path": "z", "ln": 77}\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = R.read_sweep_log(spark, str(tmp_path)).orderBy("ln").collect()
        whole = R.read_sweep_log(spark, str(tmp_path / "d.json"))
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    by_place = [r for r in got if r.record_type == "detection"]
    assert [r.image_path for r in by_place] == [f"{f}{k:03d}" for f in "abc" for k in range(300)]
    assert [r.ln for r in by_place] == list(range(2, 902))
    assert [r.ln for r in got if r.record_type == "image_done"] == [77]


def test_a_folder_named_like_the_root_is_kept(spark, tmp_path):
    (tmp_path / "img" / "a" / "img").mkdir(parents=True)
    (tmp_path / "img" / "a" / "img" / "x.jpg").write_bytes(b"x")
    (tmp_path / "img" / "B.png").write_bytes(b"x")
    got = [r.image_path for r in R.list_images(spark, str(tmp_path / "img")).collect()]
    assert got == ["a/img/x.jpg", "B.png"]


def test_a_relative_root(spark, tmp_path, monkeypatch):
    from labelwise.session import qualified
    inside = tmp_path / "img" / "deep" / "img"
    inside.mkdir(parents=True)
    (inside / "x.jpg").write_bytes(b"x")
    # the JVM keeps the folder it was started in
    start = qualified(spark, ".").removeprefix("file:")
    relative = os.path.relpath(tmp_path / "img", start)
    assert [r.image_path for r in R.list_images(spark, relative).collect()] == ["deep/img/x.jpg"]


def test_label_files_that_cannot_be_read_are_rows(spark, tmp_path):
    folder = tmp_path / "train" / "labels" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("1 0.5 0.5 0.1 0.1\n\nbad 1\n2.7 0.1 0.2 0.3 0.4")
    (folder / "empty.txt").write_text("")
    (folder / "gone.txt").write_text("0 0.5 0.5 0.1 0.1")
    (tmp_path / "train" / "labels" / "note.md").write_text("no label")
    files = R.label_files(spark, str(tmp_path))
    (folder / "gone.txt").unlink()
    got = {r.file: r for r in files.collect()}
    assert {f: r.status for f, r in got.items()} == {"deep/a.txt": "read", "deep/empty.txt": "read", "deep/gone.txt": "unreadable"}
    assert all(r.split == "train" for r in got.values()) and got["deep/empty.txt"].content in ("", None)
    rows = sorted((r.line, r.class_id, len(r.vals)) for r in R.read_label_rows(files).collect())
    assert rows == [(1, 1, 4), (3, -1, 0), (4, 2, 4)]


def test_evidence_is_hashed_whole_or_in_pieces(spark, tmp_path):
    import hashlib
    data = {"a.bin": b"", "b.bin": b"x" * 10, "c d.bin": bytes(range(256)) * 5000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "gone.bin").write_bytes(b"y" * 100)
    files = R.evidence_files(spark, str(tmp_path), whole=20)
    names = files.select("path").collect()
    (tmp_path / "gone.bin").unlink()
    paths = spark.createDataFrame([(r.path,) for r in names] + [("file:/nowhere",)], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.hash, r.status) for r in V.evidence_hashes(paths, files).collect()}
    assert got == {n: (hashlib.sha256(c).hexdigest(), "read") for n, c in data.items()} | {
        "gone.bin": ("", "missing"), "nowhere": ("", "missing")}


def test_two_rules_for_one_class_are_refused(spark):
    from labelwise.operators import policy as PO
    verdicts = spark.createDataFrame([("pricing", True, "r", 5)], "rule_class string, is_compliant boolean, reason string, penalty_amount int")
    rule = ("pricing", "p", "v1", True, "Major", 100, "s")
    ddl = "rule_class string, profile_name string, config_version string, enabled boolean, severity string, penalty int, statute string"
    same = spark.createDataFrame([rule, rule], ddl)
    assert PO.apply_profile(verdicts, same, ["rule_class"]).count() == 1
    twice = spark.createDataFrame([rule, (*rule[:5], 200, "s")], ddl)
    with pytest.raises(Exception, match="several rules for pricing"):
        PO.apply_profile(verdicts, twice, ["rule_class"]).collect()


def test_unknown_classes_are_refused(spark):
    with pytest.raises(ValueError):
        Q.class_filter(["mrp", "nonsense"], ["mrp"])


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def test_similarity_against_brute_force(spark):
    words = ["kg", "pkg", "plot", "lot", "area", "care", "tataconsumer", "consumer", "", "zzz"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    register(spark)
    rows = df.select("a", "b", X.indel_ratio(F.col("a"), F.col("b")).alias("r"), F.expr("lw_indel_ratio(a, b)").alias("s")).collect()
    for r in rows:
        assert r.r == pytest.approx(lcs_ratio(r.a, r.b)) and r.s == pytest.approx(r.r)
    texts = ["(incl.of alltaxes) rs 20", "taxes of all", "abc", "INCLUSIVE OF ALL TAXES extra words here"]
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.phrase_window_score(F.col("t"), K.TAX_FULL, 6).alias("s")).collect()}
    for t in texts:
        h, n = "".join(c for c in t.lower() if "a" <= c <= "z"), K.TAX_FULL
        best = max(
            lcs_ratio(h, n) if w >= len(h) else max(lcs_ratio(h[s:s + w], n) for s in range(len(h) - w + 1))
            for w in {max(4, len(n) - 6), len(n), len(n) + 6})
        assert got[t] == pytest.approx(best)


def test_similarity_of_long_strings(spark):
    import random
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(1000))
    other = "".join(c for c in base if rnd.random() < 0.8) + "".join(rnd.choice("abcxyz") for _ in range(300))
    pairs = [(base[:n], other[:m]) for n in (1, 61, 62, 63, 124, 125, 1000) for m in (1, 62, 400, 1000)] + [(base, base), ("", base), (base, "")]
    register(spark)
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    for r in df.select("a", "b", X.indel_ratio(F.col("a"), F.col("b")).alias("r"), F.expr("lw_indel_ratio(a, b)").alias("s")).collect():
        assert r.r == pytest.approx(lcs_ratio(r.a, r.b)) and r.s == pytest.approx(r.r)


def test_heal_vocabulary_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    words = docs.select(F.explode(X.marked_words(X.mark_words(X.repair(F.col("text"))))).alias("word")).distinct()
    got = {r.word: r.k for r in words.select("word", X.heal_word(F.col("word")).alias("k")).collect()}
    for w in sorted(got)[:: max(1, len(got) // 400)]:
        c = w.translate(str.maketrans("015|", "oisi"))
        best, top = None, 0.0
        for k in K.KEYWORDS:
            r = lcs_ratio(c, k)
            if r > top:
                best, top = k.upper(), r
        want = K.DIRECT_FIXES.get(w) or (best if top >= (0.68 if len(c) <= 4 else 0.76) else None)
        assert got[w] == want, w


def test_span_joins_against_brute_force(spark):
    import random
    rnd = random.Random(5)

    def spans(n, kind):
        return [(d, kind, s, s + rnd.randint(1, 12), "t") for d in (1, 2) for s in (rnd.randint(0, 400) for _ in range(n))]

    left, right = spans(25, "x"), spans(12, "packed")
    ddl = "doc_id int, kind string, st int, en int, txt string"
    ldf = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "id int, " + ddl)
    rdf = spark.createDataFrame(right, ddl)

    def gap(a, b):
        return max(0, b[2] - a[3], a[2] - b[3])

    near = {r.id: (r.gap, r.label.st) if r.label else None for r in J.nearest_span(ldf, rdf, 30, "id").collect()}
    for i, a in enumerate(left):
        hits = sorted((gap(a, b), b[2]) for b in right if b[0] == a[0] and gap(a, b) <= 30)
        assert near[i] == (hits[0] if hits else None)
    inside = {r.id for r in J.contained_spans(ldf, rdf, "id").collect()}
    assert inside == {i for i, a in enumerate(left) if any(b[0] == a[0] and b[2] <= a[2] and a[3] <= b[3] for b in right)}
    over = {r.id for r in J.overlapping_spans(ldf, rdf, "id").collect()}
    assert over == {i for i, a in enumerate(left) if any(b[0] == a[0] and a[2] < b[3] and b[2] < a[3] for b in right)}


def test_spans_of_any_length(spark):
    import random
    rnd = random.Random(11)

    def spans(n):
        out = []
        for d in (1, 2, 3):
            for _ in range(n):
                st = rnd.randint(0, 50_000)
                out.append((d, "k", st, st + rnd.choice([0, 1, 7, 31, 32, 33, 64, 100, 1000, 20_000]), "t"))
        return out

    left, right = spans(40), [*spans(30), (9, "k", 0, 5, "t")]
    ddl = "doc_id int, kind string, st int, en int, txt string"
    ldf = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "id int, " + ddl)
    rdf = spark.createDataFrame(right, ddl)
    for reach in (0, 30, 4000):
        pairs = sorted((r.id, r.r_st, r.r_en) for r in J._near(ldf, rdf, reach).collect())
        want = sorted(
            (i, b[2], b[3]) for i, a in enumerate(left) for b in right
            if a[0] == b[0] and max(0, b[2] - a[3], a[2] - b[3]) <= reach)
        assert pairs == want


def test_a_long_span_costs_its_document_one_level(spark):
    words = spark.range(4000).selectExpr("1 AS doc_id", "'w' AS kind", "int(id * 5) AS st", "int(id * 5 + 4) AS en", "id AS sid")
    whole = spark.createDataFrame([(1, "long", 0, 20_000), (1, "short", 9_000, 9_004)], "doc_id int, kind string, st int, en int")
    a, b = J._indexed(words, whole, 0)
    assert a.count() <= 4000 * 4 and b.count() <= 2 * 2 + 2
    assert J.contained_spans(words, whole, "sid").count() == 4000


def test_runs_are_cut_at_the_window(spark):
    from labelwise.functions import parse as P
    texts = ["FSSAI Lic 100" + "7" * 20, "FSSAI" + "." * 24 + "2" * 40, "FSSAI" + "." * 25 + "2" * 40, "FSSAI....1" + " 2" * 30,
             "FSSAI" + "." * 10 + "3" * 13 + "x" + "4" * 15, "lc no 3" + "1" * 14, "no anchor " + "1" * 15, "FSSAI 9 FSSAI " + "8" * 15]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    anchors = J.span_table(docs, "doc_id", "text", K.LICENCE_ANCHOR, "anchor").withColumn("sid", F.struct("doc_id", "st"))
    runs = J.span_table(docs, "doc_id", "text", K.LONG_DIGIT_RUN, "run")
    hits = J.following_span(anchors, runs, K.LICENCE_REACH, "sid", K.LICENCE_EXTRA, K.LONG_DIGIT_RUN)
    first = hits.groupBy("doc_id").agg(F.min_by("run.r_txt", "st").alias("run"))
    digits = {r.doc_id: "".join(c for c in r.run if c.isdigit()) for r in first.collect()}

    def pick(d):
        at = next((i for i in range(len(d) - 13) if d[i] in "12"), 0)
        return d[at:at + 14]

    want = {r.doc_id: r.n for r in docs.select("doc_id", P.licence_number(F.col("text")).alias("n")).collect() if r.n}
    assert {k: pick(d) for k, d in digits.items()} == want and len(want) >= 4


def test_a_raising_parser_breaks_its_own_group_only(spark):
    import datetime as dt
    from labelwise.functions import parse as P
    from labelwise.operators import sweep as W

    rows = [("a", "product_name", "Tea"), ("b", "product_name", "broken one"), ("c", "product_name", "broken two"), ("a", "batch_number", "Batch No. B1"),
            ("a", "consumer_care_fssai", "care@acme.com 1800 123 4567"), ("d", "consumer_care_fssai", "care@acme.com 1800 123 4567"),
            ("d", "manufacturer_details", "broken zebra"), ("e", "product_name", "")]
    log = spark.createDataFrame(
        [("detection", i, 1, k, c, t) for k, (i, c, t) in enumerate(rows)],
        "record_type string, image_path string, detection_index int, ln long, canonical_class string, ocr_text string")

    def name(clean, wide):
        return F.when(clean.contains("one"), F.raise_error(F.concat(F.lit("bad: "), clean))).when(
            clean.contains("two"), P.product_name(clean.cast("int").cast("string"))).otherwise(P.product_name(clean))

    def care(clean, wide):
        if wide is None:
            return P.contact(clean, wide)
        return F.when(F.lower(wide).contains("zebra"), F.raise_error(F.lit("bad pack"))).otherwise(P.contact(clean, wide))

    got = {(r.image, r["class"]): r for r in W.digest(log, dt.date(2024, 1, 1), {"product_name": name, "consumer_care_fssai": care}).collect()}
    assert len(got) == len(rows)
    assert got["b", "product_name"].parser_error == "bad: broken one" and got["b", "product_name"].is_compliant is None
    assert "CAST_INVALID_INPUT" in got["c", "product_name"].parser_error and got["c", "product_name"].parsed is None
    assert got["d", "consumer_care_fssai"].parser_error == "bad pack"
    assert got["d", "consumer_care_fssai"].is_compliant == got["d", "consumer_care_fssai"].strict_is_compliant is not None
    fine = [r for k, r in got.items() if k not in {("b", "product_name"), ("c", "product_name"), ("d", "consumer_care_fssai")}]
    assert all(r.parser_error is None for r in fine) and got["a", "product_name"].is_compliant
    csv = {(r.image, r["class"]): r.parsed_json for r in W.digest_csv_rows(W.digest(log, dt.date(2024, 1, 1), {"product_name": name})).collect()}
    assert csv["b", "product_name"] == '{"parser_error":"bad: broken one"}'


def test_beyond_the_explained_rows_the_first_message_stands(spark, monkeypatch):
    from labelwise.operators import extract

    monkeypatch.setattr(extract, "EXPLAINED", 2)
    rows = spark.range(6).withColumn("t", F.col("id").cast("string"))
    got = extract.isolated(rows, {"r": F.when(F.col("id") > 1, F.raise_error(F.col("t"))).otherwise(F.col("t"))}).collect()
    assert {r.id: (r.r, r.r_error) for r in got} == {
        0: ("0", None), 1: ("1", None), 2: (None, "2"), 3: (None, "3"), 4: (None, "2"), 5: (None, "2")}


def test_sql_match_starts(spark):
    register(spark)
    row = spark.sql("select lw_match_starts('a1bb22c', '[0-9]+') as s").first()
    spans = spark.sql("select 'a1bb22c' as t").select(S.match_spans(F.col("t"), "[0-9]+").alias("s")).first().s
    assert row.s == [x.st for x in spans] == [1, 4]


def test_six_digits_round_the_exact_value(spark):
    import random
    from labelwise.functions.geometry import six_digits

    rnd = random.Random(9)
    ties = [(rnd.randint(0, 10**6) + rnd.randint(0, 10**6)) / 1e6 / 2 for _ in range(400)]
    values = ties + [rnd.random() for _ in range(100)] + [rnd.random() / 1e4 for _ in range(100)] + [0.0, 1.0, 5e-7]
    values += [(round(rnd.random(), 6) + round(rnd.random(), 6)) / 2.0 for _ in range(400)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in df.select("v", six_digits(F.col("v")).alias("t")).collect():
        assert r.t == f"{r.v:.6f}", r.v


def test_late_frames_are_told_and_the_rest_is_gated_in_order(spark, tmp_path):
    import datetime as dt
    from labelwise.sources.readers import FRAMES
    from labelwise.streaming import frames as T

    start = dt.datetime(2024, 1, 1)

    def frame(cam, seq, minute, error=None):
        return (cam, start + dt.timedelta(minutes=minute), seq, 200.0 + seq, 640, 480, ["a", "b", "c"], 3, error)

    batches = [
        [frame("a", 3, 30), frame("a", 1, 10), frame("b", 1, 10)],
        [frame("a", 2, 25), frame("a", 0, 5), frame("b", 2, 12), frame("a", 5, 90)],
        [frame("a", 4, 75), frame("b", 3, 50), frame("b", 4, 69), frame("a", 6, 91, "broke")],
        [frame("end", 9, 6000)],
    ]
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    for b in batches:
        spark.createDataFrame(b, FRAMES).coalesce(1).write.mode("append").parquet(path)
    T.stateful(spark)
    stream = T.ordered_status(T.read_stream(spark, path, FRAMES, 1), "20 minutes", interval_s=600, cooldown_s=1200, floor=1, min_classes=3)
    T.append_once(stream, out, mark).awaitTermination()
    rows = [r for r in spark.read.parquet(out).collect() if r.cam != "end"]
    # watermarks before the batches: none, minute 10, minute 70
    assert sorted((r.cam, r.seq, r.late_frames) for r in rows if r.late) == [("a", 0, 1), ("b", 3, 1), ("b", 4, 2)]
    gated = [r for r in rows if not r.late]
    assert sorted((r.cam, r.seq, r.frames, r.detected) for r in gated) == [
        ("a", 1, 1, True), ("a", 2, 2, True), ("a", 3, 3, False), ("a", 4, 4, True), ("a", 5, 5, True), ("a", 6, 6, False),
        ("b", 1, 1, True), ("b", 2, 2, False)]


def test_a_drain_empties_the_ring(spark, tmp_path):
    import datetime as dt
    from labelwise.streaming import frames as T

    start = dt.datetime(2024, 1, 1)
    rows = [("a", k, None) for k in range(9)] + [("a", 99, 99), ("a", 100, 100), ("a", 101, None), ("b", 5, None), ("a", 102, 102), ("a", 103, None)]
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(0, len(rows), 4):
        part = [(c, s, start + dt.timedelta(seconds=i + j), d) for j, (c, s, d) in enumerate(rows[i:i + 4])]
        spark.createDataFrame(part, T.HANDED).coalesce(1).write.mode("append").parquet(path)
    T.stateful(spark)
    T.append_once(T.handed_over(T.read_stream(spark, path, T.HANDED, 1), 6), out, mark).awaitTermination()
    got = sorted((r.cam, r.seq, r.drain) for r in spark.read.parquet(out).collect())
    assert got == [("a", k, 99) for k in range(3, 9)] + [("a", 101, 102)]


def test_a_lost_epoch_is_written_once(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    from labelwise.streaming import frames as T

    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    tried = []

    def lost(epoch):
        tried.append(epoch)
        if epoch == 1:
            raise RuntimeError("lost")

    stream = T.read_stream(spark, path, "id long", 1)
    with pytest.raises(StreamingQueryException):
        T.serve_rows(stream, out, mark, lost).awaitTermination()
    assert tried == [0, 1]
    T.serve_rows(stream, out, mark, lambda e: tried.append(e)).awaitTermination()
    assert tried == [0, 1, 1, 2, 3]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_newest_updates_leave_the_schema_alone(spark, tmp_path):
    from labelwise.streaming import frames as T

    df = spark.range(3).withColumn("v", F.lit(1))
    for e in (0, 1):
        df.withColumn("v", F.lit(e)).write.parquet(str(tmp_path / "u" / f"epoch={e}"))
    schema = df.schema
    assert sorted(r.v for r in T.newest_updates(spark, str(tmp_path / "u"), schema, ["id"]).collect()) == [1, 1, 1]
    assert schema.names == ["id", "v"]
