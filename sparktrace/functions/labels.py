"""Activity labels and case ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal replacements on an activity label, in this order.
LABEL_REPLACEMENTS = (("-", ""), ("0_", ""), ("(", ""), (")", ""), (" ", "_"))

# Float artefact at the end of a numeric id, and the first digit run of an id.
FLOAT_ID_SUFFIX = r"\.0$"
FIRST_DIGITS = r"[^\d]*(\d+)"


def normalize_label(label: Column) -> Column:
    for old, new in LABEL_REPLACEMENTS:
        label = F.replace(label, F.lit(old), F.lit(new))
    return label


def clean_case_id(case_id: Column) -> Column:
    """String id without the ``.0`` that a float round trip leaves behind."""
    return F.regexp_replace(case_id.cast("string"), FLOAT_ID_SUFFIX, "")


def id_order(case_id: Column) -> list[Column]:
    """Sort keys: number in the id first (ids without one last), then the id itself."""
    digits = F.regexp_extract(case_id, FIRST_DIGITS, 1)
    number = F.when(digits != "", digits.cast("double"))
    return [number.asc_nulls_last(), case_id.asc()]
