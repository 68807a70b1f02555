"""Lines and blocks of text from the places of words on a photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FIELDS, PRODUCER_ANCHORS, Thresholds
from ..functions.text import finalize_producer, looks_like_address_end, once, stripped

NOT_BRAND = r"(?iu)GOVERNMENT WARNING|PRODUCED|BOTTLED|IMPORTED|DISTILLED|VINTED|BREWED|PRODUCT OF|PROOF|ALC|VOL|%"


def confident_words(words: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Words with text and enough confidence; one that doesn't parse counts as -1."""
    conf = F.coalesce(F.expr("try_cast(conf as double)"), F.lit(-1.0))
    return words.withColumn("text", stripped(F.col("text"))).where((F.col("text") != "") & (conf >= limits.ocr_confidence))


def group_lines(words: DataFrame) -> DataFrame:
    """A row for each line: text, mean height, top, left and first_seq (the first word's place).

    Words are shuffled by photo, so what follows for each photo needs no further shuffle.
    """
    line = ["photo_id", "block_num", "par_num", "line_num"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("left", "word_seq", "text"))), lambda w: w["text"])
    lines = words.repartition("photo_id").groupBy(*line).agg(F.array_join(ordered, " ").alias("text"), F.avg("height").alias("height"), F.min("top").alias("top"), F.min("left").alias("left"), F.min("word_seq").alias("first_seq"))
    return lines.withColumn("text", stripped(F.col("text"))).where("text != ''")


def photo_lines(lines: DataFrame) -> DataFrame:
    """photo_id and ``lines``: all lines of a photo in reading order (top, left, first_seq)."""
    first = ["top", "left", "first_seq"]
    rest = [c for c in lines.columns if c not in ("photo_id", *first)]
    return lines.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("lines"))


def walk(lines: Column, at: Column, max_lines: int, gap: float, ratio: float = 0.6, down: bool = True) -> Column:
    """The lines that belong together with the one at place ``at`` (from 0), that one first.

    Going down (or up), lines are taken while each one's height is within
    ``ratio`` of the line before and the space between is at most ``gap`` times
    that line's height; the first that fails ends it, as do ``max_lines``. A null place gives null.
    """
    if down:
        near = F.slice(lines, at + 1, F.lit(max_lines))
    else:
        low = F.greatest(at + 2 - max_lines, F.lit(1))
        near = F.reverse(F.slice(lines, low, at + 2 - low))

    def step(s: Column, line: Column) -> Column:
        before = F.element_at(s["taken"], -1)
        h = before["height"]
        space = line["top"] - (before["top"] + h) if down else before["top"] - (line["top"] + line["height"])
        fits = ~s["done"] & (line["height"] >= h * ratio) & (line["height"] <= h / ratio) & (space <= h * gap)
        fits = F.coalesce(fits, F.lit(False))
        return F.struct(F.when(fits, F.array_append(s["taken"], line)).otherwise(s["taken"]).alias("taken"), (~fits).alias("done"))

    start = F.struct(F.slice(near, 1, 1).alias("taken"), F.lit(False).alias("done"))
    return F.aggregate(F.slice(near, F.lit(2), F.lit(max_lines)), start, step, lambda s: s["taken"])


def cluster(lines: DataFrame, start: DataFrame, max_lines: int, gap: float, ratio: float = 0.6, down: bool = True) -> DataFrame:
    """The lines that belong together with the start line of each photo, with ``step`` from 0.

    ``start`` has photo_id and first_seq; a start that isn't there gives no lines.
    """
    at = F.array_position(F.transform("lines", lambda x: x["first_seq"]), F.col("start_seq"))
    photos = photo_lines(lines).join(start.select("photo_id", F.col("first_seq").alias("start_seq")), "photo_id")
    photos = photos.withColumn("at", at.cast("int")).where("at > 0")
    taken = photos.select("photo_id", F.posexplode(walk(F.col("lines"), F.col("at") - 1, max_lines, gap, ratio, down)).alias("step", "line"))
    return taken.select("photo_id", "line.*", "step")


def has_anchor(text: Column) -> Column:
    return once(F.upper(text), any_anchor)


def any_anchor(upper: Column) -> Column:
    """Whether a text in capitals has a producer's phrase."""
    out = F.lit(False)
    for phrase in PRODUCER_ANCHORS:
        out = out | upper.contains(phrase)
    return out


def _texts(lines: Column) -> Column:
    return F.transform(lines, lambda x: x["text"])


def photo_fields(lines: DataFrame) -> DataFrame:
    """photo_id, brand_name and producer_info of each photo with lines, from the places of its lines; null where there is none.

    The brand is the tallest line that is no other field, with what belongs to
    it above and below. The producer goes from the first line with an anchor to
    the end of the address. A line's text is looked at once, before the lines of a photo are put
    together; all else is two folds over that list.
    """
    upper = F.upper("text")
    seen = lines.select(
        "photo_id", "top", "left", "first_seq", "text", "height",
        (~F.col("text").rlike(NOT_BRAND)).alias("free"), has_anchor(F.col("text")).alias("anchor"),
        (upper.contains("GOVERNMENT WARNING") | upper.contains("PRODUCT OF")).alias("stop"), looks_like_address_end(F.col("text")).alias("ends"),
    )
    photos = photo_lines(seen).withColumn("free", F.filter("lines", lambda x: x["free"]))
    tallest = F.array_min(F.transform("free", lambda x, i: F.struct((-x["height"]).alias("h"), x["top"], x["first_seq"], i.alias("at"))))["at"]
    anchor = F.array_min(F.transform("lines", lambda x, i: F.when(x["anchor"], i)))
    photos = photos.withColumn("tallest", tallest).withColumn("anchor", anchor)
    below, above = walk(F.col("free"), F.col("tallest"), 4, 2.5), walk(F.col("free"), F.col("tallest"), 4, 2.5, down=False)
    brand = F.concat(_texts(F.reverse(F.slice(above, 2, 4))), _texts(below))

    def step(s: Column, line: Column) -> Column:
        done = s["done"] | line["stop"] | ((F.size(s["out"]) > 0) & line["anchor"])
        return F.struct(F.when(done, s["out"]).otherwise(F.array_append(s["out"], line["text"])).alias("out"), (done | line["ends"]).alias("done"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))
    address = F.aggregate(walk(F.col("lines"), F.col("anchor"), 8, 2.2), start, step, lambda s: s["out"])
    found = photos.select("photo_id", brand.alias("brand"), address.alias("address"))
    return found.select("photo_id", F.when(F.size("brand") > 0, F.array_join("brand", " ")).alias("brand_name"), F.when(F.size("address") > 0, finalize_producer(F.array_join("address", " "))).alias("producer_info"))


def brand_names(lines: DataFrame) -> DataFrame:
    """photo_id and brand_name of the photos that have one."""
    return photo_fields(lines).select("photo_id", "brand_name").where("brand_name IS NOT NULL")


def producers(lines: DataFrame) -> DataFrame:
    """photo_id and producer_info of the photos that have one."""
    return photo_fields(lines).select("photo_id", "producer_info").where("producer_info IS NOT NULL")


def label_fields(words: DataFrame, texts: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """All seven fields of each photo: photo_id and a column for each field.

    ``words`` are word boxes and ``texts`` has photo_id and raw_text. The
    producer comes from the words' places, from the plain text where they give
    none (or an empty one).
    """
    from ..functions.extract import extract_fields
    from .documents import extract_producer

    lines = group_lines(confident_words(words, limits))
    text = F.col("raw_text")
    out = texts.select("photo_id", extract_producer(text).alias("plain_producer"), *(c.alias(k) for k, c in extract_fields(text).items()))
    out = out.join(photo_fields(lines), "photo_id", "left")
    out = out.withColumn("producer_info", F.coalesce(F.nullif("producer_info", F.lit("")), "plain_producer"))
    return out.select("photo_id", *FIELDS)
