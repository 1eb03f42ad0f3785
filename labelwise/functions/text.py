"""Text repair and similarity as column expressions."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions.spans import BODY, GROUP, SPAN, let

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
_BLANK = r"(?U)[\s\x1c-\x1f]+"


def squeeze(text: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def coerce_text(*parts: Column) -> Column:
    """Any columns (strings, numbers, arrays of strings) as one tidy string."""
    return F.coalesce(squeeze(F.concat_ws(" ", *parts)), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(squeeze(text), F.lit(""))


def usable_text(text: Column) -> Column:
    """Neither empty nor a "no text detected" placeholder."""
    tidy = F.coalesce(F.trim(text), F.lit(""))
    return (tidy != "") & ~tidy.rlike(K.NO_TEXT)


def fingerprint(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def cer_normalize(text: Column) -> Column:
    return squeeze(F.upper(text))


def repair(text: Column) -> Column:
    """Ordered literal and pattern repairs that come before dictionary healing."""
    out = coerce_text(text)
    for pattern, replacement in K.REPAIRS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def finish(text: Column) -> Column:
    for pattern, replacement in K.FINISH:
        text = F.regexp_replace(text, pattern, replacement)
    return F.btrim(text, F.lit(" ,"))


# --- similarity -------------------------------------------------------------


def letter_codes(text: Column) -> Column:
    """Characters as 1-based positions in ALPHABET + 1; 1 stands for any other."""
    return F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c: F.call_function("locate", c, F.lit(ALPHABET)) + 1,
    )


def char_masks(word: str) -> list[int]:
    """Bit i of the mask of a character is set where ``word[i]`` is it."""
    return [0] + [
        sum(1 << i for i, ch in enumerate(word) if ch == letter) for letter in ALPHABET
    ]


def lcs_codes(codes: Column, masks: Column, width: Column) -> Column:
    """Longest common subsequence length by the bit-parallel recurrence.

    One integer step per character; the pattern must fit 31 characters.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1

    def step(v: Column, code: Column) -> Column:
        u = v.bitwiseAND(F.element_at(masks, code))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    return width - F.bit_count(F.aggregate(codes, full, step))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence by the bit-parallel recurrence on whole numbers of any size."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = left = (1 << len(a)) - 1
    for c in b:
        if hit := left & masks.get(c, 0):
            left = (left + hit) & full | left - hit
    return len(a) - left.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two strings of any length; null if one is."""

    def lengths(some: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(some, others)], dtype="Int32")

    return F.pandas_udf(lengths, "int")(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (len a + len b); 1.0 for two empty strings."""
    total = F.length(a) + F.length(b)
    return (
        F.when(total == 0, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(2.0 * lcs_length(a, b) / total)
    )


def phrase_window_score(text: Column, phrase: str, slack: int = 6) -> Column:
    """Best indel ratio of any letter window of about the phrase's width.

    ``text`` may be raw; only letters count.  Windows of three widths are scored
    in place with the bit-parallel LCS.
    """
    hay = letters_only(text)
    needle = "".join(ch for ch in phrase.lower() if "a" <= ch <= "z")
    n = len(needle)
    masks = literal_table(char_masks(needle), "array<bigint>")

    def ratio(window: Column, width: Column) -> Column:
        return 2.0 * lcs_codes(window, masks, F.lit(n)) / (width + n)

    def best(codes: Column) -> Column:
        size = F.size(codes)

        def best_at(width: int) -> Column:
            windows = F.transform(
                F.sequence(F.lit(1), size - width + 1),
                lambda s: ratio(F.slice(codes, s, F.lit(width)), F.lit(width)),
            )
            return F.when(size <= width, ratio(codes, size)).otherwise(F.array_max(windows))

        widths = sorted({max(4, n - slack), n, n + slack})
        return F.when(size == 0, F.lit(0.0)).otherwise(
            F.greatest(*[best_at(w) for w in widths])
        )

    return let(letter_codes(hay), best)


# --- dictionary healing -----------------------------------------------------


def heal_lookup(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit("|.")))


def needs_scoring(lookup: Column) -> Column:
    """Tokens the fuzzy dictionary may touch at all.

    The ratio bound 2*min/(a+b) rules out one-character words and anything longer
    than 21 characters for the longest keyword.
    """
    return (
        F.length(lookup).between(2, 21)
        & lookup.rlike("[a-z015|].*[a-z015|]")
        & ~lookup.isin(K.PROTECTED_TOKENS)
        & ~(lookup.rlike(r"(?U)^[\doil|.,]") & lookup.rlike(K.NUMBER_WITH_UNIT))
    )


def _keyword_packs(length: int) -> list[tuple[int, list[int], list[tuple]]]:
    """Keywords within the ratio bound of a word length, packed into long bit sets.

    Each keyword owns a run of bits with one spare bit above it, so the carry of
    the bit-parallel recurrence never reaches its neighbour and one integer
    addition advances several keywords at once.
    """
    cut = K.SHORT_CUT if length <= K.SHORT_WORD else K.LONG_CUT
    packs, used = [], 99
    for pos, word in enumerate(K.KEYWORDS):
        n = len(word)
        if 2.0 * min(n, length) / (n + length) < cut:
            continue
        if used + n + 1 > 62:
            packs.append([0, [0] * (len(ALPHABET) + 1), []])
            used = 0
        pack = packs[-1]
        seg = ((1 << n) - 1) << used
        pack[0] |= seg
        for i, m in enumerate(char_masks(word)):
            pack[1][i] |= m << used
        pack[2].append((word.upper(), seg, n, -pos))
        used += n + 1
    return packs


_PACK_TABLE = (
    "array<array<struct<full:bigint,masks:array<bigint>,"
    "words:array<struct<kw:string,seg:bigint,n:int,ord:int>>>>>"
)


def literal_table(value, ddl: str) -> Column:
    """A constant nested table, folded to one literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed dictionary, or null."""
    kind = {int: "int", float: "double", str: "string"}[type(next(iter(table.values())))]
    return F.element_at(literal_table(table, f"map<string,{kind}>"), key)


@functools.cache
def _keyword_json() -> str:
    return json.dumps(_keyword_rows())


def _keyword_table() -> Column:
    return F.from_json(F.lit(_keyword_json()), _PACK_TABLE)


def _keyword_rows() -> list:
    """Word length - 2 -> packs of keywords in reach of that length."""
    return [
        [
            {
                "full": full,
                "masks": masks,
                "words": [{"kw": kw, "seg": seg, "n": n, "ord": o} for kw, seg, n, o in words],
            }
            for full, masks, words in _keyword_packs(length)
        ]
        for length in range(2, 22)
    ]


def fuzzy_keyword(lookup: Column) -> Column:
    """Closest dictionary keyword at or above the length's cut, or null."""
    table = _keyword_table()

    def best(codes: Column) -> Column:
        size = F.size(codes)
        cut = F.when(size <= K.SHORT_WORD, K.SHORT_CUT).otherwise(K.LONG_CUT)

        def scored(pack: Column) -> Column:
            def step(v: Column, code: Column) -> Column:
                u = v.bitwiseAND(F.element_at(pack["masks"], code))
                return (v + u).bitwiseOR(v - u).bitwiseAND(pack["full"])

            def ratios(v: Column) -> Column:
                return F.transform(
                    pack["words"],
                    lambda w: F.struct(
                        (
                            2.0 * (w["n"] - F.bit_count(v.bitwiseAND(w["seg"]))) / (w["n"] + size)
                        ).alias("ratio"),
                        w["ord"].alias("ord"),
                        w["kw"].alias("kw"),
                    ),
                )

            return F.array_max(let(F.aggregate(codes, pack["full"], step), ratios))

        packs = F.get(table, size - 2)
        return let(
            F.array_max(F.transform(packs, scored)),
            lambda top: F.when(top["ratio"] >= cut, top["kw"]),
        )

    return let(letter_codes(F.translate(lookup, "015|", "oisi")), best)


def heal_word(lookup: Column, checked: bool = False) -> Column:
    """Keyword a looked-up word heals to, or null.  Pure function of the word."""
    direct = F.lit(None).cast("string")
    for word, fix in reversed(list(K.DIRECT_FIXES.items())):
        direct = F.when(lookup == word, fix).otherwise(direct)
    healed = F.coalesce(direct, fuzzy_keyword(lookup))
    return healed if checked else F.when(needs_scoring(lookup), healed)


def mark_words(text: Column) -> Column:
    """Mark every word outside an address run as SPAN word BODY."""
    pattern = rf"(?iU)({K.ADDRESS_RUN})|({K.WORD_TOKEN})"
    plain = F.regexp_replace(text, rf"(?iU)({K.WORD_TOKEN})", f"{SPAN}$1{BODY}")
    guarded = F.regexp_replace(text, pattern, f"{SPAN}$1{GROUP}$2{BODY}")
    # "" or the address run sits before GROUP; move it out of the word slot
    guarded = F.regexp_replace(guarded, f"{SPAN}([^{GROUP}{SPAN}{BODY}]+){GROUP}{BODY}", "$1")
    guarded = F.regexp_replace(guarded, f"{SPAN}{GROUP}", SPAN)
    return F.when(text.rlike(r"(?i)@|\.(?:com|in|org|net|coop)"), guarded).otherwise(plain)


def marked_words(marked: Column) -> Column:
    """Distinct looked-up words of a marked text that may need healing."""
    pieces = F.filter(F.split(marked, SPAN), lambda p: F.contains(p, F.lit(BODY)))
    words = F.array_distinct(
        F.transform(pieces, lambda p: heal_lookup(F.substring_index(p, BODY, 1)))
    )
    return F.filter(words, needs_scoring)


def rebuild(marked: Column, healed) -> Column:
    """Put a marked text back together; ``healed(lookup)`` gives a word or null."""
    def piece(p: Column) -> Column:
        word = F.substring_index(p, BODY, 1)
        rest = F.substring_index(p, BODY, -1)
        return F.when(
            F.contains(p, F.lit(BODY)),
            F.concat(F.coalesce(let(heal_lookup(word), healed), word), rest),
        ).otherwise(p)

    return F.array_join(F.transform(F.split(marked, SPAN), piece), "")


def _digits_ahead(token: Column) -> Column:
    """Look-alikes whose run ends at a digit become digits."""
    noughts = F.regexp_replace(token, r"[Oo](?=[OoIl|]*+\d)", "0")
    return F.regexp_replace(noughts, r"[Il|](?=[OoIl|]*+\d)", "1")


def heal_numbers(text: Column) -> Column:
    """Repair digit look-alikes inside tokens that hold digits."""
    mixed = (
        r"(?<![\dA-Za-z0-9|])(?=[A-Za-z0-9|]*\d)(?=[A-Za-z0-9|]*[A-Za-z|])([A-Za-z0-9|]+)"
    )
    marked = F.regexp_replace(text, mixed, f"{SPAN}$1{BODY}")

    def token(t: Column) -> Column:
        head = F.regexp_extract(t, K.NUMBER_WITH_UNIT, 1)
        unit = F.regexp_extract(t, K.NUMBER_WITH_UNIT, 2)
        digits = F.length(F.regexp_replace(t, r"(?U)\D", ""))
        # a run of look-alikes next to a digit on either side: once forward, once on the reversed token
        runs = F.reverse(_digits_ahead(F.reverse(_digits_ahead(t))))
        runs = F.when(
            digits >= F.length(t) - 1, F.translate(runs, "Ss", "55")
        ).otherwise(runs)
        return (
            F.when(head.rlike(r"\d"), F.concat(F.translate(head, "OoIl|", "00111"), unit))
            .when(digits < 2, t)
            .otherwise(runs)
        )

    def piece(p: Column) -> Column:
        return F.when(
            F.contains(p, F.lit(BODY)),
            F.concat(token(F.substring_index(p, BODY, 1)), F.substring_index(p, BODY, -1)),
        ).otherwise(p)

    healed = F.array_join(F.transform(F.split(marked, SPAN), piece), "")
    return F.when(text.rlike(mixed), healed).otherwise(text)
