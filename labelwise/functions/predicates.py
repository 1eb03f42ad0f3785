"""Row-level classifications: statuses, reasons, tiers, hints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwise.functions import fixed as K
from labelwise.functions import text as X


_lookup = X.lookup


def canonical_class(raw: Column) -> Column:
    """Detector class name to canonical name; null when unmapped."""
    return _lookup(K.CANONICAL_CLASS, F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_")))


def low_conf_threshold(flag: float | None, engine: Column) -> Column:
    return F.coalesce(
        F.lit(flag).cast("double"), _lookup(K.LOW_CONFIDENCE, engine), F.lit(K.DEFAULT_LOW_CONFIDENCE)
    )


def reading_status(
    canonical: Column, text: Column, conf: Column, raised: Column, threshold: Column
) -> Column:
    has_text = F.trim(F.coalesce(text, F.lit(""))) != ""
    return (
        F.when(canonical == K.DIETARY_CLASS, "not_applicable")
        .when(raised, "error")
        .when(~has_text, "empty")
        .when(conf.isNull(), "confidence_unavailable")
        .when(conf < threshold, "low_confidence")
        .otherwise("ok")
    )


def failure_reasons(
    status: Column, text: Column, conf: Column, error: Column, threshold: Column
) -> Column:
    has_text = F.trim(F.coalesce(text, F.lit(""))) != ""
    has_error = F.coalesce(error, F.lit("")) != ""
    found = F.array_compact(
        F.array(
            F.when(has_error, "ocr_error"),
            F.when(~has_text, "empty_text"),
            F.when(conf.isNull() & has_text, "confidence_unavailable"),
            F.when(conf < threshold, "low_confidence"),
        )
    )
    return F.when(status == "not_applicable", F.slice(found, 1, 0)).otherwise(found)


def class_filter(wanted: Sequence[str], known: Sequence[str]) -> Callable[[Column], Column]:
    """A condition on a class column: any of ``wanted``, every class if it is empty; names not known are refused."""
    names = [w.strip() for w in wanted if w.strip()]
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"unknown classes: {', '.join(unknown)}")
    return lambda column: column.isin(names) if names else F.lit(True)


def confidence_tier(canonical: Column, conf: Column) -> Column:
    return (
        F.when(canonical.isNull(), "unmapped")
        .when(conf >= 0.7, "high")
        .when(conf >= 0.4, "medium")
        .otherwise("low")
    )


def row_status(in_scope: Column, is_compliant: Column) -> Column:
    passed = F.coalesce(is_compliant, F.lit(False))
    return F.when(~in_scope, "NOT ASSESSED").when(passed, "PASS").otherwise("FAIL")


def csv_verdict(is_compliant: Column) -> Column:
    return F.when(is_compliant.isNull(), "").when(is_compliant, "yes").otherwise("no")


def path_list(raw: Column) -> Column:
    """JSON array or comma list of paths as a trimmed, blank-free array."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    items = F.when(text.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.split(text, ","))
    return F.filter(F.transform(items, lambda p: F.trim(p)), lambda p: p != "")


def required_classes() -> Column:
    return F.array(*[F.lit(c) for c in K.REGION_CLASSES])


def missing_classes(seen: Column) -> Column:
    """Required classes not seen, in the fixed order."""
    return F.array_except(required_classes(), seen)


def coverage(seen: Column) -> Column:
    return F.size(F.array_intersect(seen, required_classes())) / len(K.REGION_CLASSES)


def focus_gate(sharpness: Column, floor: float = K.SHARPNESS_FLOOR) -> Column:
    return (
        F.when(sharpness < floor * 0.6, "very_blurred")
        .when(sharpness < floor, "soft")
        .otherwise("sharp")
    )


def capture_hints(
    error: Column,
    frames: Column,
    sharpness: Column,
    n_det: Column,
    classes: Column,
    width: Column,
    height: Column,
    floor: float = K.SHARPNESS_FLOOR,
    min_classes: int = K.MIN_CLASSES,
) -> Column:
    """Guidance for whoever holds the camera, worst problem first."""
    seen = F.size(classes)
    side = F.least(width, height)
    hints = F.array_compact(
        F.array(
            F.when(
                sharpness < floor * 0.6,
                "Very blurred - hold the phone still and let the camera focus.",
            ).when(
                sharpness < floor,
                "Slightly soft - steady the pack or add light before capturing.",
            ),
            F.when(
                n_det == 0, "No statutory panel found - bring the printed label into frame."
            ).when(
                seen < min_classes,
                F.concat(
                    F.lit("Only "),
                    seen.cast("string"),
                    F.lit(" of 7 panels visible - move closer or rotate the pack; missing: "),
                    F.array_join(F.slice(missing_classes(classes), 1, 3), ", "),
                    F.lit("."),
                ),
            ),
            F.when(
                (side > 0) & (side < 600),
                "Camera is streaming a low resolution; small print will not be readable.",
            ),
        )
    )
    good = F.array(F.lit("Good frame - capture now."))
    return (
        F.when(error.isNotNull(), F.array(F.concat(F.lit("Detector unavailable: "), error)))
        .when(frames == 0, F.array(F.lit("Waiting for the first video frame.")))
        .when(F.size(hints) == 0, good)
        .otherwise(hints)
    )
