"""Decisions after corrections: only what an edit or an override touches is worked out anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FIELDS, Thresholds
from .compare import MATCH, MISMATCH, compare_long
from .store import blank_to_null, saved_headers
from .verdict import group_summary

DECIDED = ("status", "value", "source_index", "n_values", "expected", "computed_status", "manual_override")


def undecided(summary: DataFrame) -> DataFrame:
    """A summary as decisions without overrides."""
    return summary.withColumn("computed_status", F.lit(None).cast("string")).withColumn("manual_override", F.lit(False))


def edited_comparisons(comparisons: DataFrame, edits: DataFrame, keys: list[str], limits: Thresholds = Thresholds(), broad_class: bool = False) -> DataFrame:
    """The comparisons of the (keys, field_key) that ``edits`` touch, as they are after them.

    ``comparisons`` has the keys, index, field_key, extracted, expected and
    status; ``edits`` the same without status, a row at most for each photo and
    field, blank values being null. Rows of other groups or fields are left out
    before anything is shuffled or compared, and only edited rows are compared again.
    """
    row = [*keys, "field_key", "index"]
    edits = edits.select(*row, blank_to_null(F.col("extracted")).alias("extracted"), blank_to_null(F.col("expected")).alias("expected"), F.lit(broad_class).alias("broad"))
    anew = compare_long(edits, [*keys, "index"], limits)
    touched = edits.select(*keys, "field_key").distinct()
    kept = comparisons.join(touched, [*keys, "field_key"], "left_semi").join(edits.select(*row), row, "left_anti")
    columns = [*row, "extracted", "expected", "status"]
    return kept.select(*columns).unionByName(anew.select(*columns))


def redecided(comparisons: DataFrame, decided: DataFrame, edits: DataFrame, overrides: DataFrame, keys: list[str], limits: Thresholds = Thresholds(), fields: tuple[str, ...] = FIELDS, broad_class: bool = False) -> DataFrame:
    """The new decisions of the (keys, field_key) that ``edits`` or ``overrides`` touch.

    ``decided`` has the keys, field_key and ``DECIDED``; ``overrides`` the
    keys, field_key and override: match or mismatch set a status by hand,
    anything else takes it back; what isn't in the list keeps its override.
    Where only an override changes, the stored status is used and no
    comparison is read.
    """
    one = [*keys, "field_key"]
    anew = group_summary(edited_comparisons(comparisons, edits, keys, limits, broad_class), keys, limits, fields, readings=False)
    changes = overrides.select(*one, F.when(F.col("override").isin(MATCH, MISMATCH), F.col("override")).alias("override"), F.lit(True).alias("changed"))
    touched = edits.select(*one).unionByName(overrides.select(*one)).distinct()
    before = decided.join(touched, one, "left_semi").select(*one, *(F.col(c).alias(f"old_{c}") for c in DECIDED))
    summary = ["status", "value", "source_index", "n_values", "expected"]
    rows = touched.join(before, one, "left").join(anew.select(*one, *(F.col(c).alias(f"new_{c}") for c in summary), F.lit(True).alias("edited")), one, "left").join(changes, one, "left")
    edited = F.coalesce("edited", F.lit(False))
    computed = F.when(edited, F.col("new_status")).otherwise(F.coalesce("old_computed_status", "old_status"))
    override = F.when(F.coalesce("changed", F.lit(False)), F.col("override")).when(F.col("old_manual_override"), F.col("old_status"))
    others = [F.when(edited, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in summary[1:]]
    return rows.select(*one, F.coalesce(override, computed).alias("status"), *others, F.when(override.isNotNull(), computed).alias("computed_status"), override.isNotNull().alias("manual_override"))


def with_new(decided: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All decisions: those of ``new`` in place of the stored ones."""
    one = [*keys, "field_key"]
    return decided.select(*one, *DECIDED).join(new.select(*one), one, "left_anti").unionByName(new.select(*one, *DECIDED))


def headers_of(decided: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Headers (brand shown, overall status) of the groups that ``new`` touches, from all their fields."""
    touched = decided.join(new.select(*keys).distinct(), keys, "left_semi")
    return saved_headers(with_new(touched, new, keys), keys)
