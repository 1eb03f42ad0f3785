"""Typed field extraction from cleaned label text.

Every function takes a cleaned text column and returns one struct column ending
in ``is_compliant``.  Spans are found once, bound with ``let`` and related with
array functions, so a whole verdict is one narrow projection.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import spans as S
from labelwise.functions import text as X
from labelwise.functions.spans import let


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


_lookup = X.lookup


def number(text: Column) -> Column:
    """Printed number to double: "29 50" and "29,50" both mean 29.5."""
    tidy = F.translate(X.squeeze(text), "०१२३४५६७८९", "0123456789")
    split_decimal = F.regexp_replace(tidy, r"^(\d{1,4}) (\d{2})$", "$1.$2")
    return F.replace(F.replace(split_decimal, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast(
        "double"
    )


def unit_symbol(unit: Column) -> Column:
    return _lookup(K.UNIT_SYMBOL, F.lower(unit))


def _starts_role(kind: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | kind.startswith(p)
    return out


def role_type(kind: Column) -> Column:
    """Role verb to role type."""
    v = X.letters_only(kind)
    return (
        F.when(v.startswith("import"), "imported_by")
        .when(v.startswith("export"), "exported_by")
        .when(v.contains("manufactur") & v.contains("market"), "manufactured_and_marketed_by")
        .when(_starts_role(v, "market", "mkt"), "marketed_by")
        .when(_starts_role(v, "pack", "repack", "pkd", "pkg"), "packed_by")
        .when(_starts_role(v, "distribut", "dist"), "distributed_by")
        .otherwise("manufactured_by")
    )


# --- product name -----------------------------------------------------------


def product_name(clean: Column) -> Column:
    core = F.btrim(F.regexp_replace(clean, K.NAME_LABEL, ""), F.lit(" -:;,.()"))
    ok = X.usable_text(clean) & core.rlike("[A-Za-z]{2,}")
    return F.struct(F.when(X.usable_text(clean), core).alias("name"), ok.alias("is_compliant"))


# --- quantity ---------------------------------------------------------------


def quantity(clean: Column) -> Column:
    usable = X.usable_text(clean)

    def with_pack(pack: Column) -> Column:
        units, weight = number(S.group(pack, 1)), number(S.group(pack, 2))
        measure = unit_symbol(S.group(pack, 3))
        has_pack = pack.isNotNull()
        open_ = usable & (~has_pack | measure.isNotNull())
        product = units * weight

        def with_quantity(q: Column) -> Column:
            inside = F.coalesce(S.contains(pack, q), F.lit(False))
            no_value = q.isNull()
            use_pack = has_pack & (no_value | inside)
            read = number(S.group(q, 1))
            value = F.when(use_pack, product).otherwise(read)
            unit = F.when(use_pack, measure).otherwise(unit_symbol(S.group(q, 2)))
            agrees = ~has_pack | use_pack | (F.abs(read - product) <= K.PACK_TOLERANCE)
            ok = (
                open_
                & (no_value | unit_symbol(S.group(q, 2)).isNotNull())
                & agrees
                & ~clean.rlike(K.UNLAWFUL_UNIT)
                & value.isNotNull()
                & unit.isNotNull()
            )
            return F.struct(
                value.alias("value"),
                unit.alias("unit"),
                F.when(
                    has_pack,
                    F.struct(
                        units.alias("units"),
                        weight.alias("unit_weight"),
                        measure.alias("unit_measure"),
                    ),
                ).alias("multipack"),
                F.coalesce(ok, F.lit(False)).alias("is_compliant"),
            )

        found = S.first(S.match_spans(clean, K.QUANTITY, 2))
        return let(F.when(open_, found), with_quantity)

    found = S.first(S.match_spans(clean, K.MULTIPACK, 3))
    return let(F.when(usable & clean.rlike(K.MULTIPACK), found), with_pack)


# --- price ------------------------------------------------------------------


def tax_clause(text: Column) -> Column:
    """Which surviving form of the all-taxes phrase a text carries, or null."""

    def cues(letters: Column) -> Column:
        reach = K.INCL_REACH
        near_tax = F.exists(
            S.match_spans(letters, K.TAX_TOKEN),
            lambda t: F.substring(
                letters,
                F.greatest(F.lit(0), t["st"] - reach) + 1,
                t["en"] + reach - F.greatest(F.lit(0), t["st"] - reach),
            ).rlike(K.INCL_CUE),
        )
        of_all = F.exists(
            S.match_spans(letters, K.INCL_CUE),
            lambda c: F.substring(letters, c["en"] + 1, F.lit(K.OF_ALL_REACH)).rlike(K.OF_ALL_CUE),
        )
        return (
            F.when(
                X.phrase_window_score(letters, K.TAX_FULL, K.TAX_FULL_SLACK) >= K.TAX_FULL_CUT,
                "inclusive of all taxes",
            )
            .when(
                X.phrase_window_score(letters, K.TAX_CORE, K.TAX_CORE_SLACK) >= K.TAX_CORE_CUT,
                "of all taxes",
            )
            .when(near_tax, "incl. taxes")
            .when(of_all, "incl. of all")
        )

    return let(X.letters_only(text), cues)


def price(clean: Column) -> Column:
    has_marker = (
        clean.rlike(K.PRICE_MARKER) | clean.contains(K.RUPEE) | clean.contains(K.MOJIBAKE_RUPEE)
    )
    return let(has_marker, lambda marker: _price(clean, marker))


def _price(clean: Column, marker: Column) -> Column:
    def decide(a: Column) -> Column:
        amounts, pair, rate, usp = a["amounts"], a["pair"], a["rate"], a["usp"]
        pair_is_rate = F.coalesce(S.overlaps(pair, rate), F.lit(False))
        usp_later = F.coalesce(usp["st"] > pair["en"], F.lit(False))
        by_pair = pair.isNotNull() & ~pair_is_rate & ~usp_later
        by_rate = ~by_pair & pair_is_rate
        by_usp = ~by_pair & ~by_rate & usp.isNotNull()

        outside = F.filter(amounts, lambda m: (m["en"] <= rate["st"]) | (m["st"] >= rate["en"]))
        top = F.array_max(F.transform(outside, lambda m: m["val"]))
        unit_rate = number(S.group(rate, 1))
        swap = F.coalesce(unit_rate > top, F.lit(False))

        before = S.last(F.filter(amounts, lambda m: m["en"] <= usp["st"]))
        after = S.first(F.filter(amounts, lambda m: m["st"] >= usp["en"]))
        context = F.substring(clean, usp["st"] + 1, after["en"] - usp["st"])
        lost_point = (after["val"] >= 10) & (after["val"] < 100) & context.rlike(K.USP_LOST_POINT)

        mrp = (
            F.when(by_pair, number(S.group(pair, 1)))
            .when(by_rate, F.when(swap, unit_rate).otherwise(top))
            .when(by_usp, F.coalesce(before["val"], S.first(amounts)["val"]))
            .otherwise(S.first(amounts)["val"])
        )
        unit_price = (
            F.when(by_pair, number(S.group(pair, 2)))
            .when(by_rate, F.when(swap, top).otherwise(unit_rate))
            .when(by_usp, F.when(lost_point, after["val"] / 100).otherwise(after["val"]))
            .otherwise(F.get(amounts, F.lit(1))["val"])
        )
        clause = F.when(marker, tax_clause(clean))
        usp_unit = F.lower(F.nullif(F.regexp_extract(clean, K.USP_UNIT, 1), F.lit("")))

        def out(c: Column) -> Column:
            return F.struct(
                c["mrp"].alias("mrp"),
                F.when(marker, "INR").alias("currency"),
                unit_price.alias("unit_sale_price"),
                usp_unit.alias("usp_unit"),
                c["clause"].alias("tax_clause"),
                F.coalesce(marker & (c["mrp"] > 0) & c["clause"].isNotNull(), F.lit(False)).alias(
                    "is_compliant"
                ),
            )

        return let(F.struct(mrp.alias("mrp"), clause.alias("clause")), out)

    amounts = F.transform(
        S.match_spans(F.when(marker, clean).otherwise(""), K.AMOUNT, 1),
        lambda m: F.struct(
            number(S.group(m, 1)).alias("val"), m["st"].alias("st"), m["en"].alias("en")
        ),
    )
    parts = F.struct(
        amounts.alias("amounts"),
        S.first(S.match_spans(clean, K.PRICE_PAIR, 2)).alias("pair"),
        S.first(S.match_spans(clean, K.UNIT_RATE, 1)).alias("rate"),
        S.last(S.match_spans(clean, K.USP_MARKER)).alias("usp"),
    )
    return let(parts, decide)


# --- dates ------------------------------------------------------------------

DATE_SPANS = "array<struct<st:int,en:int,value:date>>"


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """Valid calendar date or null; two-digit years pivot to 1969..2068."""
    y = year.try_cast("int")
    y = F.when(y <= K.CENTURY_PIVOT, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.format_string(
        "%04d-%02d-%02d", y, month.try_cast("int"), day.try_cast("int")
    ).try_cast("date")


def _month(word: Column) -> Column:
    return F.coalesce(word.try_cast("int"), _lookup(K.MONTHS, F.lower(word)))


def dates_in(text: Column, as_of: dt.date) -> Column:
    """Plausible calendar dates of a text with offsets, overlaps removed."""
    one = F.lit("1")

    def read(pattern: str, groups: int, pick) -> Column:
        return F.transform(
            S.match_spans(text, pattern, groups),
            lambda s: F.struct(
                s["st"].alias("st"), s["en"].alias("en"), pick(s).alias("value")
            ),
        )

    def plain(s: Column) -> Column:
        full = S.group(s, 1).isNotNull()
        return F.when(
            full, calendar_date(S.group(s, 3), _month(S.group(s, 2)), S.group(s, 1))
        ).otherwise(calendar_date(S.group(s, 5), S.group(s, 4), one))

    shapes = F.concat(
        read(K.DATE_ISO, 3, lambda s: calendar_date(S.group(s, 1), S.group(s, 2), S.group(s, 3))),
        read(
            K.DATE_ALPHA,
            3,
            lambda s: calendar_date(
                S.group(s, 3), _lookup(K.MONTHS, F.lower(S.group(s, 2))), S.group(s, 1)
            ),
        ),
        read(K.DATE_PLAIN, 5, plain),
        read(
            K.DATE_WORD,
            3,
            lambda s: calendar_date(
                S.group(s, 3),
                _lookup(K.MONTHS, F.lower(S.group(s, 2))),
                F.coalesce(S.group(s, 1), one),
            ),
        ),
    )
    plausible = F.filter(
        shapes, lambda d: F.abs(F.year(d["value"]) - as_of.year) <= K.YEAR_REACH
    )
    return S.drop_overlaps(plausible)


def date_labels(text: Column) -> Column:
    """Packing and expiry labels as spans with a ``kind``."""
    return F.transform(
        S.match_spans(text, K.DATE_PREFIX, 2),
        lambda s: F.struct(
            s["st"].alias("st"),
            s["en"].alias("en"),
            F.when(S.group(s, 1).isNotNull(), "packed").otherwise("expiry").alias("kind"),
        ),
    )


def label_dates(dates: Column, labels: Column) -> Column:
    """Gives every date the kind of its closest label span, so dates fall into three arrays by kind."""

    def nearest(d: Column) -> Column:
        ranked = F.transform(
            labels, lambda p, i: F.struct(S.gap(p, d).alias("gap"), i, p["kind"].alias("kind"))
        )
        return F.array_min(F.filter(ranked, lambda r: r["gap"] <= K.PREFIX_REACH))["kind"]

    def of_kind(tagged: Column, kind: str) -> Column:
        return F.transform(
            F.filter(tagged, lambda t: t["kind"] == kind), lambda t: t["value"]
        )

    def split(values: Column) -> Column:
        kinds = F.size(F.array_distinct(F.transform(labels, lambda p: p["kind"])))
        chronological = (kinds == 2) & (F.size(values) >= 2)

        def by_label(tagged: Column) -> Column:
            return F.struct(
                of_kind(tagged, "packed").alias("packed"),
                of_kind(tagged, "expiry").alias("expiry"),
                of_kind(tagged, "none").alias("unlabelled"),
            )

        tagged = F.transform(
            dates,
            lambda d: F.struct(
                d["value"].alias("value"), F.coalesce(nearest(d), F.lit("none")).alias("kind")
            ),
        )
        ends = F.struct(
            F.slice(values, 1, 1).alias("packed"),
            F.slice(values, -1, 1).alias("expiry"),
            F.slice(values, F.lit(2), F.greatest(F.size(values) - 2, F.lit(0))).alias("unlabelled"),
        )
        return F.when(chronological, ends).otherwise(let(tagged, by_label))

    return let(
        F.array_sort(F.array_distinct(F.transform(dates, lambda d: d["value"]))), split
    )


def shelf_life(text: Column) -> Column:
    """First duration licensed by an anchor nearby or an intent anywhere."""

    def build(anchors: Column) -> Column:
        intent = text.rlike(K.SHELF_LIFE_INTENT)

        def candidate(d: Column) -> Column:
            count = F.translate(S.group(d, 1), "OoQqIl|", "0000111")
            near = S.first(F.filter(anchors, lambda a: S.gap(a, d) <= K.ANCHOR_REACH))
            st = F.least(d["st"], near["st"])
            en = F.greatest(d["en"], near["en"])
            valid = count.rlike(r"^\d+$") & count.try_cast("int").between(1, 999)
            hull = F.btrim(X.squeeze(F.substring(text, st + 1, en - st)), F.lit(" .:,-"))
            return F.when(valid & (near.isNotNull() | intent), hull)

        found = F.transform(S.match_spans(text, K.DURATION, 2), candidate)
        return F.nullif(S.first(F.filter(found, lambda f: f.isNotNull())), F.lit(""))

    return F.when(text.rlike(K.DURATION), let(S.match_spans(text, K.SHELF_LIFE_ANCHOR), build))


def dates(clean: Column, as_of: dt.date) -> Column:
    text = F.when(X.usable_text(clean), clean).otherwise("")

    def verdict(split: Column) -> Column:
        def out(c: Column) -> Column:
            ok = c["packed"].isNotNull() | c["expiry"].isNotNull() | c["life"].isNotNull()
            return F.struct(
                c["packed"].alias("packed"),
                c["expiry"].alias("expiry"),
                c["life"].alias("best_before_raw"),
                c["loose"].alias("unlabelled"),
                ok.alias("is_compliant"),
            )

        return let(
            F.struct(
                F.array_min(split["packed"]).alias("packed"),
                F.array_max(split["expiry"]).alias("expiry"),
                shelf_life(text).alias("life"),
                F.array_sort(F.array_distinct(split["unlabelled"])).alias("loose"),
            ),
            out,
        )

    parts = F.struct(dates_in(text, as_of).alias("dates"), date_labels(text).alias("labels"))
    return let(
        parts, lambda p: let(label_dates(p["dates"], p["labels"]), verdict)
    )


# --- batch ------------------------------------------------------------------


def batch(clean: Column) -> Column:
    body = F.trim(F.regexp_extract(clean, K.BATCH, 1))
    body = F.trim(S.before_match(body, K.BATCH_STOP))

    def out(b: Column) -> Column:
        clock = F.nullif(F.regexp_extract(b, K.CLOCK_TIME, 0), F.lit(""))
        rest = S.cut_match(b, K.CLOCK_TIME, " ")
        code = F.nullif(F.btrim(X.squeeze(rest), F.lit(" .,:;#/()-")), F.lit(""))
        return F.struct(
            code.alias("batch_number"),
            clock.alias("time"),
            F.coalesce(code.rlike("[A-Za-z0-9]"), F.lit(False)).alias("is_compliant"),
        )

    return let(F.when(X.usable_text(clean), body).otherwise(""), out)


# --- maker ------------------------------------------------------------------


def entity_name(text: Column) -> Column:
    name = F.btrim(X.squeeze(text), F.lit(" .,:;/-"))
    return F.when(name.rlike("[A-Za-z]{2,}"), name)


def maker(clean: Column) -> Column:
    text = F.when(X.usable_text(clean), clean).otherwise("")

    def out(p: Column) -> Column:
        role, pin = p["role"], p["pin"]
        whole = F.substring(text, role["en"] + 1, F.length(text))
        by_role, by_field = S.before_match(whole, K.ROLE_MARKER), S.before_match(whole, K.NEXT_FIELD)
        tail = F.when(F.length(by_role) <= F.length(by_field), by_role).otherwise(by_field)
        short = F.when(
            pin["st"] >= role["en"], F.substring(tail, F.lit(1), pin["st"] - role["en"])
        ).otherwise(tail)
        name = F.when(
            role.isNotNull(),
            F.coalesce(
                entity_name(short),
                entity_name(tail),
                entity_name(whole),
                entity_name(F.substring(text, F.lit(1), role["st"])),
            ),
        )
        kind = F.when(role.isNotNull(), role_type(S.group(role, 1)))
        code = F.regexp_replace(pin["txt"], r"(?U)\D", "")
        return F.struct(
            name.alias("maker_name"),
            code.alias("pincode"),
            kind.alias("maker_type"),
            (name.isNotNull() & code.isNotNull() & kind.isNotNull()).alias("is_compliant"),
        )

    return let(
        F.struct(
            S.first(S.match_spans(text, K.ROLE_MARKER, 1)).alias("role"),
            S.first(S.match_spans(text, K.PINCODE)).alias("pin"),
        ),
        out,
    )


# --- consumer care ----------------------------------------------------------


def licence_number(text: Column) -> Column:
    """Exactly 14 digits, else 14 digits of a longer run close after an anchor."""
    exact = F.nullif(F.regexp_replace(F.regexp_extract(text, K.LICENCE, 1), r"(?U)\D", ""), F.lit(""))

    def window(a: Column) -> Column:
        reach = F.substring(text, a["en"] + 1, F.lit(K.LICENCE_REACH + K.LICENCE_EXTRA))
        lead = F.length(S.before_match(reach, K.LONG_DIGIT_RUN))
        run = F.regexp_extract(reach, K.LONG_DIGIT_RUN, 0)
        return F.when(lead <= K.LICENCE_REACH, F.nullif(F.regexp_replace(run, r"(?U)\D", ""), F.lit("")))

    def pick(digits: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.length(digits) - K.LICENCE_DIGITS + 1),
            lambda i: F.substring(digits, i, F.lit(1)).isin("1", "2"),
        )
        at = F.coalesce(F.get(starts, F.lit(0)), F.lit(1))
        return F.substring(digits, at, F.lit(K.LICENCE_DIGITS))

    runs = F.filter(
        F.transform(S.match_spans(text, K.LICENCE_ANCHOR), window), lambda d: d.isNotNull()
    )
    fallback = F.when(text.rlike(K.LONG_DIGIT_RUN), let(S.first(runs), lambda d: F.when(d.isNotNull(), pick(d))))
    return F.coalesce(exact, fallback)


def contact(clean: Column, searchable: Column | None = None) -> Column:
    """Licence, help line and email; ``searchable`` may hold the whole pack's text."""
    wide = clean if searchable is None else searchable
    text = F.when(X.usable_text(wide), wide).otherwise("")
    mail_text = F.regexp_replace(text, r"(?U)\s*@\s*", "@")
    email = F.coalesce(
        F.nullif(F.regexp_extract(mail_text, K.EMAIL, 0), F.lit("")),
        F.nullif(F.regexp_extract(text, K.RUN_ON_EMAIL, 0), F.lit("")),
    )
    phone = F.coalesce(
        F.nullif(F.regexp_extract(text, K.TOLL_FREE, 1), F.lit("")),
        F.nullif(F.regexp_extract(text, K.PHONE, 1), F.lit("")),
    )

    def out(c: Column) -> Column:
        return F.struct(
            c["licence"].alias("licence"),
            c["helpline"].alias("helpline"),
            c["email"].alias("email"),
            (c["licence"].isNotNull() & c["helpline"].isNotNull() & c["email"].isNotNull()).alias(
                "is_compliant"
            ),
        )

    return let(
        F.struct(
            licence_number(text).alias("licence"),
            F.regexp_replace(phone, r"(?U)\D", "").alias("helpline"),
            email.alias("email"),
        ),
        out,
    )


# --- dietary ----------------------------------------------------------------


def dietary(status: Column) -> Column:
    """Advisory verdict for the veg / non-veg mark; it never carries a penalty."""
    s = F.upper(F.coalesce(status, F.lit("NOT_DETECTED")))
    s = F.when(s.isin(list(K.DIETARY_REASON)), s).otherwise("NOT_DETECTED")
    return F.struct(
        s.alias("dietary_status"),
        F.when(s != "NOT_DETECTED", s).alias("extracted_text"),
        _lookup(K.DIETARY_REASON, s).alias("reason"),
        F.lit(0).alias("penalty_amount"),
        F.lit(K.DIETARY_STATUTE).alias("statute"),
        s.isin("VEG", "NON_VEG").alias("is_compliant"),
    )


def envelope(is_compliant: Column) -> dict[str, Column]:
    """Penalty and reason that go with a verdict."""
    return {
        "penalty_amount": F.when(is_compliant, 0).otherwise(K.FIRST_OFFENCE_PENALTY),
        "reason": F.when(is_compliant, K.PASS_REASON).otherwise(K.FAIL_REASON),
    }
