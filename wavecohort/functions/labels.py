"""Scalar clean-up of keys, labels and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavecohort.functions.arrays import let

# Subtype names found in the metadata and their short forms.
SUBTYPES = {
    "fibromatös": "fibro",
    "meningothelial": "meningo",
    "transitional": "trans",
    "klarzellig": "clear",
    "chordoid": "chord",
    "anaplastisch": "anap",
    "atypisch": "atyp",
    "psammomatös": "psamm",
}
# Spellings that mean "no subtype", compared in lower case.
MISSING_SUBTYPE = ("<missing>", "nan", "")
# Fixed value: session number of a file whose name carries none (sorts last).
NO_SESSION = 2147483647


def _trimmed(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def norm_grade(c: Column) -> Column:
    """Canonical 'WHO-1' / 'WHO-2' / 'WHO-3', or '' when the value is none of them.

    A trailing count such as ' (94)' is ignored; numbers and any letter case are accepted.
    """
    text = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s*\(\d+\)$", ""))
    return let(text, _grade)


def _grade(text: Column) -> Column:
    number = text.try_cast("double")
    grade = F.lit("")
    for g in (3, 2, 1):
        name = f"WHO-{g}"
        grade = F.when(number.eqNullSafe(F.lit(float(g))) | (F.upper(text) == name), F.lit(name)).otherwise(grade)
    return grade


def label_from_text(c: Column) -> Column:
    """1 when the text contains '1', else 3 when it contains '3', else NULL."""
    return F.when(c.contains("1"), F.lit(1)).when(c.contains("3"), F.lit(3)).cast("long")


def norm_sex(c: Column) -> Column:
    key = F.lower(_trimmed(c))
    return (
        F.when(key.isin("w", "female"), F.lit("Female"))
        .when(key.isin("m", "male"), F.lit("Male"))
        .otherwise(F.lit("Unknown"))
    )


def map_subtype(c: Column) -> Column:
    key = _trimmed(c)
    table = F.create_map(*[F.lit(v) for pair in SUBTYPES.items() for v in pair])
    passed = F.when(~F.lower(key).isin(*MISSING_SUBTYPE), key)
    return F.coalesce(F.try_element_at(table, key), passed, F.lit("Unknown"))


def session_number(c: Column) -> Column:
    """First '-S<digits>' of a file name as a number; files without one sort last."""
    digits = F.regexp_extract(F.coalesce(c, F.lit("")), r"-S(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(NO_SESSION).cast("long"))


def make_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.trim(p.cast("string")) for p in parts])


def fill_missing_category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def label_index(c: Column, classes: Sequence) -> Column:
    """Position 1..K of a label in the declared class order; NULL for an unknown label."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in classes]), c), F.lit(0)).cast("long")


def index_label(i: Column, classes: Sequence) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in classes]), i.cast("int"))


def interpretation_flag(confidence: Column, correct: Column, high: float = 0.85, low: float = 0.60) -> Column:
    # The four band names.
    return (
        F.when((confidence >= high) & correct, F.lit("High Confidence - Correct"))
        .when((confidence >= high) & ~correct, F.lit("High Confidence - INCORRECT (Review!)"))
        .when(confidence <= low, F.lit("Low Confidence - Ambiguous Case"))
        .otherwise(F.lit("Moderate Confidence"))
    )
