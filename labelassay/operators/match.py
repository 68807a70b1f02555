"""The best product of a library for each reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import REFERENCE_FIELDS, WARNING, Thresholds
from ..storage import kept_table
from .best import best_of_kinds

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def candidate_order(name):
    """Order of products by name, only A-Z folded."""
    return F.translate(name, UPPER, LOWER)


def best_matches(readings: DataFrame, products: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """For each reading (photo_id and six fields) the product (id, name and six fields) that fits best.

    Most fields matched first, then the sum of the scores in field order, then
    the product's place in the library. Equal readings are looked up once, and
    equal sets of reference values are one candidate (its first product);
    ``best_of_kinds`` finds the best of each block of candidates, an aggregate
    the best of all. Without products nothing is matched.
    Returns photo_id, product_id (null if nothing matched), matched_count, score_sum.
    """
    fields = list(REFERENCE_FIELDS)
    place = F.struct(candidate_order(F.col("name")).alias("key"), F.col("id"))
    candidates = products.groupBy(*(F.col(f).alias(f"e_{f}") for f in fields)).agg(F.min(place).alias("place"))
    # Written, so that a kind has the same number wherever it is read.
    kinds = kept_table(readings.select(*(F.col(f).alias(f"x_{f}") for f in fields)).distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    found = best_of_kinds(kinds, candidates, limits)
    top = F.min(F.struct((-F.col("matched")).alias("m"), (-F.col("score")).alias("s"), F.struct("place_key", "place_id").alias("place"))).alias("top")
    best = kinds.join(found.groupBy("kind").agg(top), "kind", "left")
    same = reduce(lambda a, b: a & b, [readings[f].eqNullSafe(best[f"x_{f}"]) for f in fields])
    hit = F.col("top.m") < 0
    return readings.join(best, same).select(
        "photo_id",
        F.when(hit, F.col("top.place.place_id")).cast("long").alias("product_id"),
        F.when(hit, -F.col("top.m")).otherwise(0).cast("int").alias("matched_count"),
        F.when(hit, -F.col("top.s")).otherwise(0.0).alias("score_sum"),
    )


def expected_values(photos: DataFrame, best: DataFrame, products: DataFrame, applications: DataFrame) -> DataFrame:
    """``photos`` with their reference: product_id, product_name and ``expected_<field>`` of all seven fields.

    A photo's ``mode`` says where its reference comes from: ``auto`` the best
    product (``best``: photo_id, product_id), ``product`` the one chosen
    (``chosen_id``), ``cola`` its run's application (``applications``: run_id
    and fields; one row serves all photos of the run), else what was typed
    (``typed_<field>``, blank is null). A product that isn't in the library
    leaves all expected values null. The warning is the same for all.
    """
    fields = list(REFERENCE_FIELDS)
    out = photos.join(best.select("photo_id", F.col("product_id").alias("best_id")), "photo_id", "left")
    wanted = F.when(F.col("mode") == "auto", F.col("best_id")).when(F.col("mode") == "product", F.col("chosen_id"))
    out = out.withColumn("wanted", wanted).join(products.select(F.col("id").alias("wanted"), F.col("name").alias("product_name"), F.lit(True).alias("known"), *(F.col(f).alias(f"p_{f}") for f in fields)), "wanted", "left")
    out = out.join(applications.select("run_id", *(F.col(f).alias(f"a_{f}") for f in fields)), "run_id", "left")
    typed = lambda f: F.nullif(F.regexp_replace(f"typed_{f}", r"(?U)^\s+|\s+$", ""), F.lit(""))
    picked = lambda f: F.when(F.col("mode").isin("auto", "product"), F.col(f"p_{f}")).when(F.col("mode") == "cola", F.col(f"a_{f}")).otherwise(typed(f))
    return out.select(*photos.columns, F.when(F.col("known"), F.col("wanted")).alias("product_id"), "product_name", *(picked(f).alias(f"expected_{f}") for f in fields), F.lit(WARNING).alias("expected_health_warning_text"))


def match_kind(mode, product_id, matched_count):
    """exact, partial or none; null where the mode doesn't look a product up."""
    return F.when(mode.isin("adhoc", "cola"), None).when(product_id.isNull(), "none").when(matched_count == len(REFERENCE_FIELDS), "exact").otherwise("partial")


def batch_counts(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """What became of each batch's documents: saved, duplicate and failed counts, and the names of the last two.

    ``rows`` has batch_id, doc_id, filename and error (null where it was read);
    ``kept`` has the doc_ids that were saved.
    """
    marked = rows.join(kept.select("doc_id", F.lit(True).alias("saved")), "doc_id", "left")
    failed = F.col("error").isNotNull()
    double = ~failed & F.col("saved").isNull()
    names = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("filename"))))
    return marked.groupBy("batch_id").agg(F.count_if(~failed & ~double).alias("saved"), F.count_if(double).alias("duplicates"), F.count_if(failed).alias("failed"), names(double).alias("duplicate_names"), names(failed).alias("failed_names"))


def first_of_each(rows: DataFrame, key, order: list, saved_keys: DataFrame | None = None) -> DataFrame:
    """Of rows with one key (spaces trimmed, A-Z folded) the first by ``order`` (columns, least first), unless the key is saved already.

    A blank or null key is never a duplicate. ``saved_keys`` has a column ``key``.
    """
    folded = F.translate(F.trim(key), UPPER, LOWER)
    rows = rows.withColumn("_key", F.nullif(folded, F.lit("")))
    blank, named = rows.where("_key IS NULL"), rows.where("_key IS NOT NULL")
    # min_by aggregates before the shuffle, so a frequent key doesn't go whole to one task.
    first = named.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")
    if saved_keys is not None:
        known = saved_keys.select(F.translate(F.trim("key"), UPPER, LOWER).alias("_key"))
        first = first.join(known, "_key", "left_anti")
    return first.select(rows.columns).unionByName(blank).drop("_key")
