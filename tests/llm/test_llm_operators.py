"""Training-data operators against brute force, exact round trips and odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelwise.llm import bytetree, chat, common, ctw, ctw_model, decontam, exact_dedup, langid, mixing, quality, simhash, token_store, url_rules
from labelwise.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_ string, id string, text_sha256 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, ties, repeated rows and columns whose names clash with the operators' own."""
    words = "the quick brown fox jumps over the lazy dog and runs away".split()
    rng = random.Random(1)
    long = " ".join(rng.choice(words) for _ in range(40_000))
    rows = [
        (1, "the quick  brown\nfox", "en", "a"), (2, "the quick brown fox", "en", "a"), (2, "the quick brown fox", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, " \t\n", "fr", "b"), (None, "the quick brown fox", "en", "b"),
        (None, None, None, None), (6, long, "en", "a"), (7, long + " dog", "en", "a"), (8, "le chat noir dort ici", "fr", None),
        (9, "1234 5678", "en", "c"), (10, "éà ß İ \u2028 x", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "r", "i", "s") for r in rows], DOCS).repartition(3)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- exact copies -----------------------------------------------------------


def test_exact_copies(odd):
    got = exact_dedup.duplicates(odd).collect()
    norm = lambda t: " ".join(x for x in [t or ""]) if not t else __import__("re").sub(r"[ \t-\r]+", " ", t)
    texts = [(r.doc_id, norm(r.text)) for r in odd.collect()]
    groups = {}
    for i, t in texts:
        groups.setdefault(t, []).append(i)
    assert len(got) == len(texts)
    for r in got:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [m for m in members if m is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(members))
    assert sum(r.kept for r in got) == len(groups)


def test_a_full_filter_changes_nothing(odd, monkeypatch):
    want = sorted(rows_of(exact_dedup.duplicates(odd), "text_sha256", "group_size", "kept"))
    monkeypatch.setattr(exact_dedup, "_bits", lambda rows: exact_dedup.BLOCK_BITS)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert sorted(rows_of(exact_dedup.duplicates(odd), "text_sha256", "group_size", "kept")) == want


# --- SimHash ----------------------------------------------------------------


def test_keys_cover_all_prints_within_four_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.int64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in a]
    b = (a.view(np.uint64) ^ np.array(flips, np.uint64)).view(np.int64)
    keys = [set(zip(*map(np.ndarray.tolist, simhash.fuzzy_keys(x)))) for x in (a, b)]
    assert {place for place, _ in keys[0] & keys[1]} == set(range(len(a)))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


@pytest.mark.parametrize("long_run", [64, 2])
def test_links_join_the_same_prints_in_any_run_length(monkeypatch, long_run):
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 5, dtype=np.int64)
    prints = base[rng.integers(0, 5, 300)] ^ (1 << rng.integers(0, 60, 300)) ^ (1 << rng.integers(0, 60, 300))
    key = np.sort(rng.integers(0, 6, 300)).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(300, np.int32)), pa.array(prints)], names=["key", "tile", "print"])
    got = [x for b in simhash._comparing(4)(iter([batch])) for x in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    pairs = [(p, q) for k, p in zip(key, prints.tolist()) for j, q in zip(key, prints.tolist()) if k == j and (p ^ q).bit_count() <= 4]

    def tops(links):
        root = {p: p for p in prints.tolist()}
        for _ in range(len(root)):
            new = dict(root)
            for a, b in links:
                new[a] = new[b] = min(new[a], new[b])
            if new == root:
                return root
            root = new

    assert tops(got) == tops(pairs)


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_components_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {k: base[k % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for k in range(120)}
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in prints.items()]
    table = spark.createDataFrame(signed, "id long, print long")
    first = {}
    for k, p in signed:
        first.setdefault(p, k)
    roots = {r.node: r.root for r in common.components(simhash.linked(table.groupBy("print").agg(F.min("id").alias("least")))).collect()}
    least = {}
    for k, p in signed:
        top = roots.get(p, p)
        least[top] = min(k, least.get(top, k))
    assert {k: least[roots.get(p, p)] for k, p in signed} == brute_components(prints)


def test_simhash_of_odd_rows(odd):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.groups(odd).collect()}
    assert got[(3, "0" * 16)] == got[(4, "0" * 16)] == got[(5, "0" * 16)] == 3
    assert got[(None, "0" * 16)] == 3
    assert {c for (i, _), c in got.items() if i in (1, 2)} == {1}


def test_similar_groups_find_what_jaccard_finds(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for at in rng.sample(range(200), 3):
                other[at] = word()
            texts.append(other)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = dict(rows_of(simhash.similar_groups(docs), "doc_id", "component_id"))
    sets = [simhash.shingle_set(" ".join(t), 5) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if simhash.similarity(sets[i], sets[j]) >= 0.8:
                assert got[i] == got[j]
            elif i // 4 != j // 4:
                assert got[i] != got[j]


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_similar_groups_after_every_kind_of_edit(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    passage, texts = words(40), []
    for k in range(120):
        base = words(rng.randint(60, 250)) + (passage if k % 3 == 0 else [])
        part = int(len(base) * rng.uniform(0.04, 0.23))
        other = list(base)
        if k % 4 == 0:
            other += words(part)
        elif k % 4 == 1:
            other = other[part:] if k % 8 == 1 else other[: len(other) - part]
        elif k % 4 == 2:
            other[len(other) // 2 : len(other) // 2 + part // 2] = words(part // 2)
        else:
            for at in rng.sample(range(len(base)), max(1, part // 10)):
                other[at] = words(1)[0]
        texts += [base, other]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = dict(rows_of(simhash.similar_groups(docs), "doc_id", "component_id"))
    alike = simhash.similarities([simhash.shingle_set(" ".join(t), 5) for t in texts])
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike[i, j] >= 0.8:
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    assert got == dict(enumerate(want)) and len(set(want)) < 190
    kinds = Counter(k // 2 % 4 for k in range(1, 240, 2) if 0.8 <= alike[k, k - 1] <= 0.95)
    assert min(kinds[k] for k in range(4)) >= 5


def test_similarities_of_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 3)
    rng = random.Random(11)
    sets = [np.array(sorted(rng.sample(range(30), rng.randint(0, 12))), np.int64) for _ in range(25)]
    got = simhash.similarities(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == pytest.approx(simhash.similarity(a, b))


def test_one_of_each_group_stays(odd):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 6, 8, 9, 10, None, None])


# --- tokens -----------------------------------------------------------------


def test_tokens_come_back(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = shared_dir(spark, "tokens")
    token_store.write(odd, path, public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd.collect())
    start, want = 0, []
    for i, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = rows_of(token_store.digests(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted((-1 if g[0] is None else g[0], *g[1:]) for g in got) == want
    few = token_store.read_documents(spark, path, lambda i: i.between(8, 8)).collect()
    assert library.decode(few[0].tokens[:-1]) == "le chat noir dort ici"
    assert "tokens" not in token_store.read_counts(spark, path).columns


def test_pieces_equal_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "ab", "C", "é", "1", "²", "<|endoftext|>", "'s", "'", ",", "\u3000", "\x85", "\x1c", "_", "日本", "\xa0", "Ⅷ", "𝕏"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    monkeypatch.setattr(token_store, "MEMORY", 50)
    texts += ["a <|endoftext|> b", "x\n <|endoftext|>", "\x1c \x1c a", " lead", "trail ", "   ", "a \t b \n c", "", "日本 語 \u3000 x"]
    encoder = token_store.ChunkEncoder(path)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]
        assert encoder.encode(some) == want


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_store.ChunkEncoder(path)
    texts = ["Some words, 12 of them", "", " two  spaces ", "日本 語"]
    assert encoder.encode(texts) == [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# --- URLs -------------------------------------------------------------------


def test_rules_by_brute_force(spark):
    rules = [url_rules.site_rule("allow", "com/"), url_rules.site_rule("block", "a.com/en/"), url_rules.Rule("^spam*.", "block"),
             url_rules.Rule("*q=1|", "block"), url_rules.Rule("||x.org^", "allow")]
    rng = random.Random(4)
    parts = ["http://", "https://", "A.com", "b.a.com", "com", "x.org", "xspam.org", "spam-1.net", "/en/", "/", "?q=1", "#f", ":80", "en", ""]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, "", "://", "a://"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    import re
    for r in url_rules.judge(df, rules).collect():
        after = (urls[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", after)[0]
        rest = after[len(host) :]
        assert (r.host, r.path) == (host.lower(), re.match(r"[^?#]*", rest)[0])
        fits = [(x.rank, len(x.pattern), -k) for k, x in enumerate(rules) if re.search(url_rules.rule_regex(x.pattern), host.lower() + rest)]
        best = rules[-max(fits)[2]] if fits and host else None
        assert (r.rule, r.action) == ((best.name or best.pattern, best.action) if best else (None, None))
    assert url_rules.judge(df, []).where("rule is not null").count() == 0


def test_tokens_of_rules():
    assert url_rules.rule_tokens("||www.a.com/en/") == ["www", "a", "com", "en"]
    assert url_rules.rule_tokens("spam-farm.*bad^x") == ["farm"]


# --- mixing -----------------------------------------------------------------


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("w" * rng.randint(0, 60)), rng.choice(["a", "b", None, "z"]) if k % 3 else "hot") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(docs).collect()
    again = mixing.plan(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.taken, tuple(r.positions))
    assert sorted(map(key, plan)) == sorted(map(key, again))
    sums = Counter()
    for r in plan:
        assert r.taken <= 2 * r.size and all(0 <= p <= 1 for p in r.positions)
        sums[r.source, r.target, r.source_size] += r.taken
    total = sum(size for _, _, size in sums)
    assert abs(sum(sums.values()) - 1.5 * total) < 5
    assert all(abs(n - target) <= 1 and target <= 2 * size for (_, target, size), n in sums.items())
    first = [r.positions[0] for r in plan if r.positions]
    assert first == sorted(first)


def test_mix_of_odd_rows(odd, spark):
    plan = mixing.plan(odd).collect()
    assert len(plan) == 13 and all(r.taken == 0 for r in plan if not r.size)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.plan(odd.limit(0)).count() == 0


# --- chat -------------------------------------------------------------------


def test_chat_round_trip(spark):
    bad = "a\\b<|im_end|><|im_start|>assistant\nno\\"
    rows = [(1, 1, "assistant", bad), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "us\ner\\", ""), (2, 0, "us\ner\\", ""), (3, None, "assistant", "\ue000")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = shared_dir(spark, "chat")
    chat.write(df, path)
    got = {r.conv_id: r for r in chat.digests(spark, path).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", ""), ("assistant", bad)])
    assert got[1].loss_sha256 == hashlib.sha256(bad.encode()).hexdigest() and got[1].loss_chars == len(bad)
    assert got[2].turns_sha256 == digest([("us\ner\\", "")] * 2) and got[2].n_turns == 2
    assert got[None].turns_sha256 == digest([("", "x")]) and got[3].loss_chars == 1


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.locate(turns, chat.chat_template)[3] is None
    numbered = lambda t: f"{len(t)} turns\n" + chat.chat_template(t)
    assert chat.locate(turns, numbered)[3] == 0
    last_only = lambda t: chat.chat_template([(r, x if k == len(t) - 1 or r == "user" else "") for k, (r, x) in enumerate(t)])
    assert chat.locate(turns, last_only)[3] == 2
    dropping = lambda t: chat.chat_template([x for x in t if x[0] != "assistant"])
    assert chat.locate(turns, dropping)[3] == 1


# --- benchmark leaks --------------------------------------------------------


def test_distance_equals_the_table():
    rng = random.Random(8)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 80))) for a in (1, 0))
        row = list(range(len(p) + 1))
        best = (row[-1], 0)
        for k, c in enumerate(t):
            new = [0]
            for i in range(1, len(p) + 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p[i - 1] != c)))
            row = new
            best = min(best, (row[-1], k + 1)) if row[-1] < best[0] else best
        assert decontam.Pattern(p).best(t) == best


def test_edited_items_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, text(150)) for k in range(8)] + [(90, None), (91, "short"), (None, text(100))]
    docs, want = [], set()
    for k in range(60):
        item = list(items[k % 8][1])
        for _ in range(k % 12):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choice(letters)
        docs.append((k, text(300) + "".join(item).upper() + text(300)))
    docs += [(None, items[0][1]), (70, None), (71, "")]
    got = rows_of(decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "distance")
    for d, t in docs:
        for k, item in items[:8]:
            clean = decontam.normal(item)
            distance = decontam.Pattern(clean).best(decontam.normal(t))[0]
            if distance <= decontam.budget(len(clean)):
                want.add((d, k, distance))
    assert set(got) == want and len(got) == len(want) > 20
    none = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "日本の首都はどこですか"), (3, "cat"), (4, "?!"), (5, None), (6, "what is the capital of mali"), (None, "dog")]
    docs = [
        (10, "quiz: who  WROTE hamlet - Shakespeare"), (11, "who wrote hamlets"), (12, "次の問題、日本の首都はどこですかと聞く"), (13, "concatenate; a cat."),
        (14, "what is the capital oh mali"), (15, "what is a capital oh mali"), (16, "xcat catx"), (17, "?!"), (18, "cat"),
    ]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), items_df).collect()
    want = {(10, 1, 0, 0, 21), (12, 2, 0, 0, 16), (13, 3, 0, 0, 17), (18, 3, 0, 0, 3), (14, 6, 1, 1)}
    assert {tuple(r) if r.item_id != 6 else tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert sorted(rows_of(decontam.left_out(items_df), "item_id", "text"), key=str) == [(4, "?!"), (5, None), (None, "dog")]


# --- language, scoring, quality ---------------------------------------------


def test_windows_count_every_byte(monkeypatch):
    monkeypatch.setattr(bytetree, "BLOCK", 7)
    texts = [b"", b"abracadabra", b"xyz" * 9]
    counts = bytetree.WindowCounts(2)
    counts.add(texts)
    keys, n = counts.take()
    want = Counter()
    for t in texts:
        padded = b"\0\0" + t
        for k in range(len(t)):
            want[padded[k + 1] << 16 | padded[k] << 8 | t[k]] += 1
    assert dict(zip(keys.tolist(), n.tolist())) == dict(want)


def brute_ctw(texts, depth):
    """Weighted probabilities by the definition: every context to ``depth``, whole bytes as contexts, bits by prefix."""
    counts = Counter()
    for t in texts:
        padded = b"\0" * depth + t
        for k in range(len(t)):
            for d in range(depth + 1):
                context, prefix = padded[k + depth - d : k + depth], 1
                for bit in range(7, -1, -1):
                    counts[context, prefix, t[k] >> bit & 1] += 1
                    prefix = prefix << 1 | t[k] >> bit & 1

    def block(context, prefix):
        return float(ctw_model.log_block(np.array([counts[context, prefix, 0], counts[context, prefix, 1]], float)))

    def weighted(context, prefix, extra=None):
        """log probability of the node's bits, with one more bit ``extra = (context, bit)`` below it if given."""
        if len(context) == depth:
            return block(context, prefix)
        children = sum(weighted(bytes([c]) + context, prefix) for c in range(256) if counts[bytes([c]) + context, prefix, 0] + counts[bytes([c]) + context, prefix, 1])
        return float(np.logaddexp(block(context, prefix), children) - np.log(2))

    def cost(t):
        total, padded = 0.0, b"\0" * depth + t
        for k in range(len(t)):
            prefix = 1
            for bit in range(7, -1, -1):
                value = t[k] >> bit & 1
                contexts = [padded[k + depth - d : k + depth] for d in range(depth + 1)]
                before = weighted(b"", prefix)
                for c in contexts:
                    counts[c, prefix, value] += 1
                total -= (weighted(b"", prefix) - before) / np.log(2)
                for c in contexts:
                    counts[c, prefix, value] -= 1
                prefix = prefix << 1 | value
        return total

    return cost


def test_scores_equal_the_definition(spark):
    texts = ["abab abba", "abba baab", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(docs, lambda i: F.lit(True), depth=1, contexts=1000).collect()}
    coded = [t.encode() + b"\n" for t in texts]
    cost = brute_ctw(coded, 1)
    for k, t in enumerate(coded):
        assert got[k].score == pytest.approx(-cost(t) * np.log10(2), rel=1e-4)


def test_scores_of_odd_rows(odd):
    got = ctw.score(odd, lambda i: common.fold(i, 5) != 1, depth=3).collect()
    assert len(got) == 13 and all(r.score < 0 and r.base_score < 0 for r in got)
    taught = Counter()
    rows = odd.collect()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            taught.update([*ctw.spelled(r.text), b"\n"])
    n, v = sum(taught.values()), len(taught)
    for r in rows:
        words = [*ctw.spelled(r.text), b"\n"]
        base = sum(np.log10((taught[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert any(g.doc_id == r.doc_id and g.n_tokens == len(words) and abs(g.base_score - base) < 1e-6 * (1 - base) for g in got)
    assert ctw.score(odd.limit(0), lambda i: F.lit(True), depth=2).count() == 0


def test_byte_costs_are_probabilities(spark):
    docs = spark.createDataFrame([(k, "one two three two one " * 20) for k in range(5)], "doc_id long, text string")
    _, tree, table = ctw.learn(docs, depth=3)
    columns = np.exp2(-table.reshape(-1, tree.size).astype(float))
    unseen = int((tree.codes == 0).sum())
    # column 0 is the mean cost of the bytes never seen, so it gives a lower bound of their share
    assert (columns[:, 1:].sum(axis=1) <= 1 + 1e-5).all() and unseen > 200


def test_languages_of_odd_rows(odd, spark):
    texts = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat with the hat", "en"), ("le chat est sur la table avec un chapeau", "fr")] * 20)]
    labelled = spark.createDataFrame(texts, "id long, text string, lang string")
    got = {(r.doc_id, (r.text or "")[:9]): r.language for r in langid.predict(odd, labelled).collect()}
    assert got[8, "le chat n"].lang_pred == "fr" and got[1, "the quick"].lang_pred == "en"
    for key in ((3, ""), (4, ""), (5, " \t\n"), (9, "1234 5678"), (None, "")):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert all(0 <= x.score <= 1 for x in got.values())
    none = langid.predict(odd, labelled.limit(0)).select("language.lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_held_out_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    part = common.fold(F.col("doc_id"), 5)
    said = langid.predict(docs, docs.where(part != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    right = said.where(part == 0).agg(F.avg((F.col("lang") == F.col("language.lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_model_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("a b a c b a",), ("b c a b",), (None,), ("",)], "text string")
    held = quality._held(quality.train(docs))
    size = len(held[1])
    for u in range(size):
        for v in range(size):
            lines = [[u, v, w] for w in range(size)]
            # the scores of two-word lines end in an edge; what the third word adds is its probability
            if u == 0 or v == 0:
                continue
            with_w = quality.line_scores([[u, v, w] for w in range(1, size)], held)
            ends = [quality.line_scores([[u, v, w]], held)[0] - step(held, [u, v, w]) for w in range(1, size)]
            assert sum(10.0 ** (a - b) for a, b in zip(with_w, ends)) <= 1 + 1e-6
            assert len(lines) == size


def step(held, line):
    """log10 probability of the last word of a line after the two before it."""
    _, own1, back1, (key2, own2, ahead2), (key3, own3) = held
    size = len(own1)
    u, v, w = line
    find = lambda keys, values, key, default: values[np.searchsorted(keys, key)] if key in keys else default
    p = find(key2, own2, v * size + w, 0.0) + back1[v] * own1[w]
    return np.log10(find(key3, own3, (u * size + v) * size + w, 0.0) + find(key2, ahead2, u * size + v, 1.0) * p)


def test_quality_of_odd_rows(odd, spark):
    trusted = spark.createDataFrame([(1,), (6,), (8,), (None,)], "doc_id long")
    got = quality.judged(odd, trusted).collect()
    assert len(got) == 13
    assert not any(r.kept for r in got if r.doc_id in (3, 4, 5))
    assert quality.judged(odd, trusted.limit(0)).count() == 13
    assert quality.judged(odd.limit(0), trusted).count() == 0
