"""From several photos of one product to a verdict for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FIELDS, Thresholds
from ..functions.text import is_blank
from .compare import MATCH, MISMATCH, NOT_FOUND, field_close, values_agree

DISAGREEMENT = "disagreement"


def group_key(product_id: Column, mode: Column, index: Column) -> Column:
    """A matched product makes the group, whatever the mode; else the application or the photo itself."""
    return F.when(product_id.isNotNull(), F.concat(F.lit("product:"), product_id.cast("string"))).when(mode == "cola", "cola").otherwise(F.concat(F.lit("standalone:"), index.cast("string")))


def aggregate_field(comparisons: DataFrame, field: str, keys: list[str], limits: Thresholds = Thresholds(), readings: bool = True) -> DataFrame:
    """``group_summary`` of one field, whose rows alone are in ``comparisons``; without ``field_key``."""
    return group_summary(comparisons.withColumn("field_key", F.lit(field)), keys, limits, (field,), readings).drop("field_key")


def group_summary(comparisons: DataFrame, keys: list[str], limits: Thresholds = Thresholds(), fields: tuple[str, ...] = FIELDS, readings: bool = True) -> DataFrame:
    """One row for each group and ``field_key`` from its photos' readings.

    ``comparisons`` has the keys, field_key, index, extracted, expected and
    status. A match of any photo wins, with the first such photo's value.
    Without any reading it is ``not_found``; if all readings agree with the
    first one, ``mismatch`` with that value, else ``disagreement``. Returns the
    keys, field_key, status, value, source_index, n_values, expected and, if
    asked for, ``readings``: those of a disagreement in order of index, a list
    as long as the group.

    A group's state (first match, first reading, counts) is merged before the
    shuffle, and readings are compared once for each distinct value.
    """
    keys = [*keys, "field_key"]
    matched, read = F.col("status") == MATCH, ~is_blank(F.col("extracted"))
    groups = comparisons.groupBy(*keys).agg(
        F.min(F.when(matched, F.struct("index", "extracted"))).alias("hit"),
        F.min(F.when(read, F.struct("index", "extracted"))).alias("first"),
        F.count_if(read).alias("n"),
        F.min(F.struct("index", "expected"))["expected"].alias("expected"),
    )
    found = F.col("hit").isNotNull()
    # Of the first value itself only further photos count.
    values = comparisons.where(read).groupBy(*keys, F.col("extracted").alias("e")).agg(F.count("*").alias("times"))
    others = values.join(groups.where(~found & (F.col("n") > 1)).select(*keys, F.col("first.extracted").alias("x")), keys).where((F.col("e") != F.col("x")) | (F.col("times") > 1))
    x, e, agree = F.col("x"), F.col("e"), F.lit(None)
    pairs = others.select("field_key", "x", "e").distinct().withColumn("close", _close_of_any(x, e, fields, limits))
    for f in fields:
        agree = F.when(F.col("field_key") == f, values_agree(f, x, e, F.col("close"), limits)).otherwise(agree)
    agreed = others.join(pairs.select("field_key", "x", "e", agree.alias("agree")), ["field_key", "x", "e"]).groupBy(*keys).agg(F.bool_and("agree").alias("agree"))
    out = groups.join(agreed, keys, "left")
    same = F.coalesce("agree", F.lit(True))
    status = F.when(found, MATCH).when(F.col("n") == 0, NOT_FOUND).when(same, MISMATCH).otherwise(DISAGREEMENT)
    shown = F.when(found, F.col("hit")).when(same, F.col("first"))
    out = out.select(*keys, status.alias("status"), shown["extracted"].alias("value"), shown["index"].alias("source_index"), F.when(status == DISAGREEMENT, F.col("n")).otherwise(0).cast("int").alias("n_values"), "expected")
    return with_readings(out, comparisons, keys) if readings else out


def with_readings(summary: DataFrame, comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """``summary`` with ``readings``: all that photos of a disagreeing group say, in order of index; null for others."""
    wanted = summary.where(F.col("status") == DISAGREEMENT).select(*keys)
    said = comparisons.where(~is_blank(F.col("extracted"))).join(wanted, keys, "left_semi")
    lists = said.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", "extracted"))).alias("readings"))
    return summary.join(lists, keys, "left")


def _close_of_any(x: Column, e: Column, fields: tuple[str, ...], limits: Thresholds) -> Column:
    """``field_close`` by ``field_key``; the warning's is worked out only for its rows."""
    if "health_warning_text" not in fields:
        return field_close("brand_name", x, e, limits)
    warning = F.col("field_key") == "health_warning_text"
    text = field_close("brand_name", F.when(~warning, x), F.when(~warning, e), limits)
    return F.when(warning, field_close("health_warning_text", F.when(warning, x), F.when(warning, e), limits)).otherwise(text)


def group_headers(photos: DataFrame) -> DataFrame:
    """One row for each group of a run's photos: label, place in the run, photos and both tri-states.

    ``photos`` has run_id, index, mode, product_id, product_name, caps_ok and
    bold_ok. Groups stand in the order of their first photos.
    """
    keyed = photos.withColumn("group_key", group_key(F.col("product_id"), F.col("mode"), F.col("index")))
    groups = keyed.groupBy("run_id", "group_key").agg(
        F.min("index").alias("first"),
        F.min_by("product_name", "index").alias("name"),
        F.count("*").alias("photos"),
        aggregate_tristate(F.col("caps_ok")).alias("caps_ok"),
        aggregate_tristate(F.col("bold_ok")).alias("bold_ok"),
    )
    label = (
        F.when(F.col("group_key").startswith("product:"), F.coalesce(F.nullif("name", F.lit("")), F.lit("Saved Product")))
        .when(F.col("group_key") == "cola", "COLA Application")
        .otherwise(F.concat(F.lit("Label "), (F.col("first") + 1).cast("string")))
    )
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first"))  # a run is one batch of photos
    return groups.select("run_id", "group_key", place.alias("place"), label.alias("label"), "photos", "caps_ok", "bold_ok")


def encode_tristate(value: Column) -> Column:
    return F.when(value, "true").when(~value, "false").otherwise("")


def decode_tristate(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def aggregate_tristate(value: Column) -> Column:
    """True if any is true, else false if any is false, else null."""
    return F.bool_or(value)


def overall_status(status: Column) -> Column:
    """``pass`` if all fields match (an aggregate over a group's fields)."""
    return F.when(F.coalesce(F.bool_and(status == MATCH), F.lit(False)), "pass").otherwise("needs_review")


def display_brand(value: Column, expected: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), expected)


def apply_overrides(summary: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """``overrides`` (keys, override) replace statuses; what was computed stays beside them."""
    valid = overrides.where(F.col("override").isin(MATCH, MISMATCH))
    out = summary.join(valid, keys, "left")
    return out.withColumn("computed_status", F.when(F.col("override").isNotNull(), F.col("status"))).withColumn("manual_override", F.col("override").isNotNull()).withColumn("status", F.coalesce("override", "status")).drop("override")
