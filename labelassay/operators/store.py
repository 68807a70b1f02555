"""Products and saved verifications as append-only versions with a view of the latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import REFERENCE_FIELDS
from ..storage import drop_table, kept_table
from .match import candidate_order
from .verdict import display_brand

PRODUCT = "id long, name string, " + ", ".join(f"{f} string" for f in REFERENCE_FIELDS) + ", created_at string, updated_at string, version long, deleted boolean"
VERIFICATION = "id long, source_filename string, brand_name string, overall_status string, results_json string, created_at string, updated_at string, version long, deleted boolean"
HEADER = ("id", "source_filename", "brand_name", "overall_status", "created_at", "updated_at")


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each id, without those deleted: an aggregate, so it combines before the shuffle."""
    columns = [c for c in versions.columns if c != "id"]
    newest = versions.groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("v")).select("id", "v.*")
    return newest.where("NOT coalesce(deleted, false)").select(versions.columns)


def blank_to_null(value: Column) -> Column:
    return F.when(value.rlike(r"(?U)^\s*$"), None).otherwise(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def numbered(rows: DataFrame, high_water: int, by: str = "seq") -> DataFrame:
    """``rows`` with new ids after ``high_water`` in the order of ``by``, gapless and unique; equal ``by`` in the order of input.

    Rows are written as they come, as finding the ranges runs their plan once
    more. Then two passes over one written table: rows are range-partitioned by
    ``by`` (a second key splits frequent values), sorted in their range and
    written, so that a row's place in its file is fixed. A count for each file,
    the only thing that is gathered, gives the number before its first row.
    """
    arrived = kept_table(rows.select("*", F.monotonically_increasing_id().alias("_tie")), "unnumbered")
    ranged = arrived.repartitionByRange(by, "_tie").sortWithinPartitions(by, "_tie").drop("_tie").withColumn("_range", F.spark_partition_id())
    written = kept_table(ranged, "numbered")
    drop_table(arrived)
    placed = written.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = placed.groupBy("_range", "_file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range", "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("_file", before.alias("_before"))  # a row for each file
    return placed.join(F.broadcast(starts), "_file").withColumn("id", (F.col("_place") + F.col("_before") + high_water + 1).cast("long")).drop("_file", "_range", "_place", "_before")


def next_versions(current: DataFrame, changes: DataFrame, version: int, now: str, high_water: int) -> DataFrame:
    """New version rows for ``changes`` (action insert, update or delete; seq; id; name and fields).

    An update writes all fields, so a missing one becomes null, and keeps
    created_at; a change of an id that isn't there does nothing; an insert
    needs a name. New ids follow ``high_water``, the largest id ever given, in
    order of ``seq``.
    """
    fields = ["name", *REFERENCE_FIELDS]
    changes = changes.select("action", "seq", "id", *(blank_to_null(F.col(f)).alias(f) for f in fields))
    made = numbered(changes.where("action = 'insert' AND name IS NOT NULL").select("seq", *fields), high_water)
    made = made.select("id", *fields, F.lit(now).alias("created_at"))
    known = latest(current).select("id", F.col("created_at"), *(F.col(f).alias(f"old_{f}") for f in fields))
    # Of several edits of one id in a batch the last counts.
    edited = changes.where("action IN ('update', 'delete')").groupBy("id").agg(F.max_by(F.struct("action", *fields), "seq").alias("e")).select("id", "e.*").join(known, "id")
    gone = F.col("action") == "delete"
    edited = edited.select("id", *(F.when(gone, F.col(f"old_{f}")).otherwise(F.coalesce(F.col(f), F.col("old_name")) if f == "name" else F.col(f)).alias(f) for f in fields), "created_at", gone.alias("deleted"))
    rows = made.withColumn("deleted", F.lit(False)).unionByName(edited)
    return rows.select("id", *fields, "created_at", F.lit(now).alias("updated_at"), F.lit(version).cast("long").alias("version"), "deleted")


def changes_of_run(submitted: DataFrame, current: DataFrame) -> DataFrame:
    """What a run's corrected values change in the library, a row for each row of ``submitted``.

    ``submitted`` has action, seq, product_id, name and the six fields. An
    ``update`` writes the fields to the product it names and keeps the stored
    name; any other action creates a product and needs a name that isn't blank.
    Blank values become null. Returns action, seq, id, name, the fields and
    ``outcome``: updated, created, not_found or no_name; ``next_versions`` takes
    the rows of the first two.
    """
    known = latest(current).select(F.col("id").alias("product_id"), F.col("name").alias("stored_name"), F.lit(True).alias("known"))
    update = F.coalesce(F.col("action") == "update", F.lit(False))
    name = F.when(update, F.col("stored_name")).otherwise(blank_to_null(F.col("name")))
    outcome = F.when(update, F.when(F.col("known"), "updated").otherwise("not_found")).when(name.isNull(), "no_name").otherwise("created")
    fields = [blank_to_null(F.col(f)).alias(f) for f in REFERENCE_FIELDS]
    rows = submitted.select("action", "seq", "product_id", "name", *REFERENCE_FIELDS).join(known, "product_id", "left")
    return rows.select(F.when(update, "update").otherwise("insert").alias("action"), "seq", F.when(update, F.col("product_id")).cast("long").alias("id"), name.alias("name"), *fields, outcome.alias("outcome"))


def upsert_of_run(current: DataFrame, submitted: DataFrame, version: int, now: str, high_water: int) -> DataFrame:
    """New version rows of the library for a run's ``submitted`` values."""
    changes = changes_of_run(submitted, current).where("outcome IN ('updated', 'created')")
    return next_versions(current, changes, version, now, high_water)


def empty_store(spark: SparkSession, schema: str = PRODUCT) -> DataFrame:
    """A store without rows: ``PRODUCT`` or ``VERIFICATION``."""
    return spark.createDataFrame([], schema)


def by_name(products: DataFrame) -> DataFrame:
    """Products in order of their names, only A-Z folded."""
    return products.orderBy(candidate_order(F.col("name")), "id")


def merge_extracted(typed: Column, extracted: Column) -> Column:
    """An extracted value that isn't empty replaces the typed one."""
    return F.coalesce(F.nullif(extracted, F.lit("")), typed)


def encode_results(results: Column) -> Column:
    """Results as JSON text; nulls are written."""
    return F.to_json(results, {"ignoreNullFields": "false"})


def decode_results(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


#: What a saved verification's JSON text holds.
RESULTS = (
    "field_summary map<string, struct<status: string, value: string, source_index: int, values: array<struct<value: string, source_index: int>>, "
    "expected: string, computed_status: string, manual_override: boolean>>, warning_caps_ok boolean, warning_bold_ok boolean, "
    "photos array<struct<index: int, raw_text: string, extracted: map<string, string>, expected: map<string, string>, "
    "comparisons_by_field: map<string, struct<status: string, extracted_value: string, expected_value: string, score: double>>, "
    "warning_caps_ok: boolean, warning_bold_ok: boolean>>"
)


def saved_headers(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """A header for each group from its fields (field_key, status, value, expected)."""
    brand = F.col("field_key") == "brand_name"
    shown = display_brand(F.max(F.when(brand, F.col("value"))), F.max(F.when(brand, F.col("expected"))))
    return summaries.groupBy(*keys).agg(shown.alias("brand_name"), F.when(F.bool_and(F.col("status") == "match"), "pass").otherwise("needs_review").alias("overall_status"))


def results_of(summaries: DataFrame, keys: list[str], marks: DataFrame, photos: DataFrame) -> DataFrame:
    """keys and ``results_json``: the fields' summary, both marks of the warning and the photos of each group.

    ``marks`` has the keys, caps_ok and bold_ok; ``photos`` the keys and a
    struct ``photo`` as in ``RESULTS``.
    """
    values = F.transform("readings", lambda r: F.struct(r["extracted"].alias("value"), r["index"].cast("int").alias("source_index")))
    field = F.struct("status", "value", F.col("source_index").cast("int").alias("source_index"), values.alias("values"), "expected", "computed_status", "manual_override")
    fields = summaries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_key", field.alias("field"))), lambda a, b: F.when(a["field_key"] < b["field_key"], -1).otherwise(1))).alias("field_summary"))
    shown = photos.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("photo.index").alias("index"), F.to_json("photo", {"ignoreNullFields": "false"}).alias("json")))).alias("photos"))
    out = fields.join(marks, keys, "left").join(shown, keys, "left")
    head = encode_results(F.struct("field_summary", F.col("caps_ok").alias("warning_caps_ok"), F.col("bold_ok").alias("warning_bold_ok")))
    # The photos' texts are put into the whole text as they are, not parsed and written again.
    listed = F.coalesce(F.array_join(F.transform("photos", lambda p: p["json"]), ",", "null"), F.lit(""))
    return out.withColumn("_head", head).select(
        *keys, F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"photos":['), listed, F.lit("]}")).alias("results_json")
    )


def next_verifications(current: DataFrame, changes: DataFrame, version: int, now: str, high_water: int) -> DataFrame:
    """New version rows of saved verifications for ``changes``.

    ``changes`` has action (insert, update or delete), seq, id,
    source_filename, brand_name, overall_status and results_json. An update
    keeps the file's name and created_at; a change of an id that isn't there
    does nothing. New ids follow ``high_water`` in order of ``seq``.
    """
    written = ["brand_name", "overall_status", "results_json"]
    made = numbered(changes.where("action = 'insert'").select("seq", "source_filename", *written), high_water).drop("seq")
    made = made.select("id", "source_filename", *written, F.lit(now).alias("created_at"), F.lit(False).alias("deleted"))
    known = latest(current).select("id", "source_filename", "created_at", *(F.col(c).alias(f"old_{c}") for c in written))
    edited = changes.where("action IN ('update', 'delete')").groupBy("id").agg(F.max_by(F.struct("action", *written), "seq").alias("e")).select("id", "e.*").join(known, "id")
    gone = F.col("action") == "delete"
    edited = edited.select("id", "source_filename", *(F.when(gone, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in written), "created_at", gone.alias("deleted"))
    rows = made.unionByName(edited)
    return rows.select("id", "source_filename", *written, "created_at", F.lit(now).alias("updated_at"), F.lit(version).cast("long").alias("version"), "deleted")


def by_id(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest versions of the ids in ``wanted`` (a column id); versions of others are left out first."""
    return latest(versions.join(wanted.select("id").distinct(), "id", "left_semi"))


def newest_first(saved: DataFrame) -> DataFrame:
    return saved.select(*HEADER).orderBy(F.desc("created_at"), F.desc("id"))
