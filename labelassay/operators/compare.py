"""Comparing what a label says with what it should say, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FIELDS, Thresholds
from ..functions.similarity import partial_ratio, ratio_reaches, sorted_tokens, token_sort_ratio
from ..functions.text import abv_percent, broad_category, is_blank, normalize_text, producer_keywords, state_of, volume_ml

MATCH, MISMATCH, NOT_FOUND = "match", "mismatch", "not_found"


def result(status: Column, score: Column) -> Column:
    return F.struct(status.alias("status"), score.cast("double").alias("score"))


def _passed(ok: Column) -> Column:
    return F.when(ok, MATCH).otherwise(MISMATCH)


def text_ratio(x: Column, e: Column) -> Column:
    return token_sort_ratio(normalize_text(x), normalize_text(e))


def field_ratio(field: str, x: Column, e: Column) -> Column:
    """The ratio that a field is compared by: for the warning that of the best stretch."""
    return partial_ratio(normalize_text(x), normalize_text(e)) if field == "health_warning_text" else text_ratio(x, e)


def producer_broad_match(x: Column, e: Column) -> Column:
    """Same state, and enough producer words in common."""
    a, b = producer_keywords(x), producer_keywords(e)
    fewer = F.least(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.coalesce((state_of(x) == state_of(e)) & (fewer >= 2) & (common >= F.least(F.lit(3), fewer)), F.lit(False))


def same_category(x: Column, e: Column) -> Column:
    return F.coalesce(broad_category(x) == broad_category(e), F.lit(False))


def compare_text(x: Column, e: Column, ratio: Column, threshold: float, rescue: Column | None = None) -> Column:
    """Status and score of text; a rescue changes the status and not the score.

    Blank extracted: match only with a blank expected value. Blank expected: match.
    """
    ok = ratio >= threshold if rescue is None else (ratio >= threshold) | rescue
    blank = result(F.when(is_blank(x) & ~is_blank(e), NOT_FOUND).otherwise(MATCH), F.lit(None))
    return F.when(is_blank(x) | is_blank(e), blank).otherwise(result(_passed(ok), ratio))


def _compare_measure(x: Column, e: Column, both: Column, ok: Column, score: Column, ratio: Column, fallback: float) -> Column:
    blank = result(F.when(is_blank(x), NOT_FOUND).otherwise(MATCH), F.lit(None))
    return F.when(is_blank(x) | is_blank(e), blank).when(both, result(_passed(ok), score)).otherwise(result(_passed(ratio >= fallback), ratio))


def compare_abv(x: Column, e: Column, ratio: Column, limits: Thresholds = Thresholds()) -> Column:
    """Strengths agree within points of percent; a blank extracted one is never found."""
    a, b = abv_percent(x), abv_percent(e)
    gap = F.abs(a - b)
    return _compare_measure(x, e, gap.isNotNull(), gap <= F.lit(limits.abv_points), F.greatest(F.lit(0.0), F.lit(100.0) - gap * F.lit(10.0)), ratio, limits.fallback)


def volume_gap(a: Column, b: Column) -> Column:
    """Difference in percent of ``b``; 100 if that is 0."""
    return F.when(b == 0, F.lit(100.0)).otherwise(F.abs(a - b) / b * F.lit(100.0))


def compare_volume(x: Column, e: Column, ratio: Column, limits: Thresholds = Thresholds()) -> Column:
    gap = volume_gap(volume_ml(x), volume_ml(e))
    gap = F.when(volume_ml(x).isNotNull() & volume_ml(e).isNotNull(), gap)
    return _compare_measure(x, e, gap.isNotNull(), gap <= F.lit(limits.volume_percent), F.greatest(F.lit(0.0), F.lit(100.0) - gap), ratio, limits.fallback)


def compare_warning(x: Column, e: Column, ratio: Column, limits: Thresholds = Thresholds()) -> Column:
    """``ratio`` is the partial ratio of the normalised texts."""
    return compare_text(x, e, ratio, limits.warning)


def compare_field(field: str, x: Column, e: Column, ratio: Column, limits: Thresholds = Thresholds(), broad_class: bool = False) -> Column:
    if field == "alcohol_content":
        return compare_abv(x, e, ratio, limits)
    if field == "net_contents":
        return compare_volume(x, e, ratio, limits)
    if field == "health_warning_text":
        return compare_warning(x, e, ratio, limits)
    rescue = producer_broad_match(x, e) if field == "producer_info" else same_category(x, e) if field == "class_type" and broad_class else None
    return compare_text(x, e, ratio, limits.text, rescue)


def scored_pairs(pairs: DataFrame, field: str, limits: Thresholds = Thresholds(), broad_class: bool = False) -> DataFrame:
    """Distinct (x, e) with their comparison ``c``; the ratio is worked out once for each pair."""
    ratio = pairs.select("x", "e").distinct().withColumn("ratio", field_ratio(field, F.col("x"), F.col("e")))
    return ratio.select("x", "e", compare_field(field, F.col("x"), F.col("e"), F.col("ratio"), limits, broad_class).alias("c"))


def compare_product(rows: DataFrame, keys: list[str], limits: Thresholds = Thresholds(), broad_class: Column | None = None) -> DataFrame:
    """A row for each row of ``rows`` and field: keys, field_key, extracted, expected, status, score.

    ``rows`` has the keys, a column for each field and ``expected_<field>``.
    Where ``broad_class`` holds, broad categories of class and type may agree:
    for references that come from applications. Comparisons are made once for
    each distinct pair of values and joined back.
    """
    broad = F.coalesce(broad_class, F.lit(False)) if broad_class is not None else F.lit(False)
    fields = [F.struct(F.lit(f).alias("field_key"), F.col(f).alias("extracted"), F.col(f"expected_{f}").alias("expected")) for f in FIELDS]
    long = rows.select(*keys, broad.alias("broad"), F.explode(F.array(*fields)).alias("f")).select(*keys, "broad", "f.*")
    return compare_long(long, keys, limits)


def compare_long(long: DataFrame, keys: list[str], limits: Thresholds = Thresholds()) -> DataFrame:
    """``long`` (keys, field_key, extracted, expected and ``broad``) with status and score; each distinct pair is compared once."""
    x, e = F.col("x"), F.col("e")
    pairs = long.select(F.col("field_key").alias("of"), F.col("extracted").alias("x"), F.col("expected").alias("e"), F.col("broad").alias("wide")).distinct()
    pairs = pairs.withColumn("warning", F.col("of") == "health_warning_text")
    partial = field_ratio("health_warning_text", F.when(F.col("warning"), x), F.when(F.col("warning"), e))
    pairs = pairs.withColumn("ratio", F.when(F.col("warning"), partial).otherwise(text_ratio(x, e)))
    ratio, compared = F.col("ratio"), F.lit(None)
    for f in FIELDS:
        one = compare_field(f, x, e, ratio, limits)
        if f == "class_type":
            one = F.when(F.col("wide"), compare_field(f, x, e, ratio, limits, broad_class=True)).otherwise(one)
        compared = F.when(F.col("of") == f, one).otherwise(compared)
    scored = pairs.select("of", "x", "e", "wide", compared.alias("c"))
    same = (F.col("field_key") == F.col("of")) & (F.col("broad") == F.col("wide")) & F.col("extracted").eqNullSafe(x) & F.col("expected").eqNullSafe(e)
    return long.join(scored, same).select(*keys, "field_key", "extracted", "expected", "c.status", "c.score")


def score_shown(score: Column) -> Column:
    """A score as a whole percent, halves to the even number; null stays null."""
    return F.concat(F.bround(score, 0).cast("int").cast("string"), F.lit("%"))


def field_close(field: str, a: Column, b: Column, limits: Thresholds = Thresholds()) -> Column:
    """Whether the ratio that a field is compared by reaches its limit."""
    if field == "health_warning_text":
        return field_ratio(field, a, b) >= limits.warning
    return ratio_reaches(sorted_tokens(normalize_text(a)), sorted_tokens(normalize_text(b)), limits.text)


def values_agree(field: str, a: Column, b: Column, close: Column, limits: Thresholds = Thresholds()) -> Column:
    """Whether two readings of a field agree: no rescue, and the volume's tolerance is of ``b``; ``close`` is ``field_close``."""
    if field == "alcohol_content":
        return F.coalesce(F.abs(abv_percent(a) - abv_percent(b)) <= F.lit(limits.abv_points), close)
    if field == "net_contents":
        return F.coalesce(F.when(volume_ml(a).isNotNull() & volume_ml(b).isNotNull(), volume_gap(volume_ml(a), volume_ml(b)) <= F.lit(limits.volume_percent)), close)
    return close
