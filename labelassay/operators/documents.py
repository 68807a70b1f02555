"""Fields of application documents: labeled lines first, then free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import extract_abv, extract_checkbox_class, extract_class_type, extract_country, extract_net_contents, strip_class_label, strip_trailing_noise
from ..functions.text import finalize_producer, looks_like_address_end, once, stripped, trim_to_address_end
from .layout import any_anchor, has_anchor

# How forms head each field, the most telling pattern first.
ROLE = r"(?:PRODUCER|BOTTLER|IMPORTER|PERMITTEE|APPLICANT)"
LABELS = {
    "brand_name": [r"BRAND\s*NAME", r"BRAND"],
    "class_type": [r"CLASS\s*(?:AND|/)?\s*TYPE", r"TYPE\s*OF\s*PRODUCT", r"CLASS"],
    "alcohol_content": [r"ALCOHOL\s*CONTENT", r"ALC(?:OHOL)?\.?\s*(?:BY|/)?\s*VOL(?:UME)?"],
    "net_contents": [r"NET\s*CONTENTS?"],
    "producer_info": [rf"NAME\s+(?:AND|&)\s+ADDRESS\s+OF\s+(?:THE\s+)?{ROLE}(?:[,/]?\s*(?:AND|OR)?\s*{ROLE})*", r"NAME\s+(?:AND|&)\s+ADDRESS"],
    "country_of_origin": [r"COUNTRY\s*OF\s*ORIGIN"],
}
PRODUCER_LABEL = rf"(?iU)^\s*NAME\s+(?:AND|&)\s+ADDRESS(?:\s+OF\s+(?:THE\s+)?{ROLE}(?:[,/]?\s*(?:AND|OR)?\s*{ROLE})*)?\s*[:\-]?\s*"
ANY_LABEL = "(?iU)" + "|".join(p for own in LABELS.values() for p in own)
NUMBERED = r"(?U)^\s*\(?\d{1,2}[A-Za-z]?[.)]\s"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

_STATE = "struct<out: array<string>, blanks: int, started: boolean, done: boolean>"


def text_lines(text: Column) -> Column:
    """Lines at any line terminator; a last one opens no further line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})$", ""), LINE_END, -1)


def all_caps(text: Column) -> Column:
    """At least one letter, and no letter that isn't upper case."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def looks_like_heading(line: Column) -> Column:
    """A numbered field, any known label, or a short line in capitals."""
    line = stripped(line)
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return line.rlike(NUMBERED) | line.rlike(ANY_LABEL) | (all_caps(line) & (letters >= 4) & (F.length(line) <= 80))


def _start(first: Column) -> Column:
    return F.struct(F.array(first).alias("out"), F.lit(0).alias("blanks"), F.lit(True).alias("started"), F.lit(False).alias("done")).cast(_STATE)


def _next(state: Column, out: Column, blanks: Column, started: Column, done: Column) -> Column:
    return F.struct(out.alias("out"), blanks.cast("int").alias("blanks"), started.alias("started"), done.alias("done")).cast(_STATE)


def _capture(lines: Column, first: Column, limit: int, stop, last) -> Column:
    """Join ``first`` and the lines under it: one blank line inside is tolerated, two end
    it; ``stop`` ends before a line and ``last`` after it."""

    def step(s: Column, raw: Column) -> Column:
        return F.when(s["done"], s).otherwise(once(stripped(raw), lambda line: after(s, line)))

    def after(s: Column, line: Column) -> Column:
        on_blank = _next(s, s["out"], F.when(s["started"], s["blanks"] + 1).otherwise(0), s["started"], s["started"] & (s["blanks"] >= 1))
        grown = F.array_append(s["out"], line)
        taken = _next(s, grown, F.lit(0), F.lit(True), last(line) | (F.size(grown) >= limit))
        ended = _next(s, s["out"], F.lit(0), F.lit(True), F.lit(True))
        return F.when(line == "", on_blank).when(stop(line), ended).otherwise(taken)

    return F.aggregate(lines, _start(first), step, lambda s: stripped(F.array_join(s["out"], " ")))


def extract_producer(text: Column) -> Column:
    """The first line with a producer's phrase and the address lines under it ('' for a bare phrase)."""
    stop = lambda x: once(F.upper(x), lambda u: any_anchor(u) | u.contains("GOVERNMENT WARNING") | u.contains("PRODUCT OF"))

    def from_line(at: Column, lines: Column) -> Column:
        long_form = _capture(F.slice(lines, at["i"] + 2, 7), at["x"], 5, stop, looks_like_address_end)
        return finalize_producer(F.when(looks_like_address_end(at["x"]), stripped(at["x"])).otherwise(long_form))

    def of_lines(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda x, i: F.struct(has_anchor(x).alias("hit"), i.alias("i"), x.alias("x"))), lambda m: m["hit"])
        return once(F.get(marked, F.lit(0)), lambda at: F.when(at.isNotNull(), from_line(at, lines)))

    return once(F.transform(text_lines(text), stripped), of_lines)


#: Of each field how many lines a value under its label may have, and whether it ends where an address does.
UNDER = {"class_type": (3, False), "producer_info": (4, True)}
MOST_LINES = 4
SAME_LINE = r"(?sU)^\s*[:\-]\s*(.+)"


def _line_table(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row for each line of each text, numbered, with what captures ask of it; the keys and the text are in the first row."""
    rows = docs.select(*keys, F.col(text).alias("_text")).withColumn("_doc", F.monotonically_increasing_id()).repartition("_doc")
    lines = rows.select("_doc", *keys, "_text", F.posexplode_outer(text_lines(F.col("_text"))).alias("_i", "_raw")).withColumn("_i", F.coalesce("_i", F.lit(0)))
    only_first = [F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in (*keys, "_text")]
    lines = lines.select("_doc", "_i", "_raw", stripped(F.col("_raw")).alias("_line"), *only_first)
    blank = F.coalesce(F.col("_line") == "", F.lit(True))
    aside = F.col("_line").startswith("(") & F.col("_line").endswith(")")
    heading = ~blank & looks_like_heading(F.col("_line"))
    return lines.select("*", blank.alias("_blank"), heading.alias("_heading"), (~blank & ~aside & ~heading).alias("_content"), F.coalesce(F.col("_raw").rlike(ANY_LABEL), F.lit(False)).alias("_label"))


def _islands(lines: DataFrame) -> DataFrame:
    """Each line with ``_next``, the content lines after it, and ``_stop``, where a capture that begins below it ends.

    Blank lines right under it are passed over. From the first other line on, a
    heading that isn't in brackets or the second of two blank lines ends the capture.
    """
    down = Window.partitionBy("_doc").orderBy("_i")
    up = Window.partitionBy("_doc").orderBy(F.desc("_i"))
    lines = lines.withColumn("_ends", (F.col("_heading") & ~(F.col("_line").startswith("(") & F.col("_line").endswith(")"))) | (F.col("_blank") & F.coalesce(F.lag("_blank").over(down), F.lit(False))))
    lines = lines.withColumn("_found", F.when(F.col("_content"), F.struct("_i", "_line")))
    following = [F.expr(f"lead(_found, {k}) IGNORE NULLS OVER (PARTITION BY _doc ORDER BY _i)") for k in range(1, MOST_LINES + 1)]
    lines = lines.withColumn("_next", F.array(*following))
    here = F.min(F.when(F.col("_ends"), F.col("_i"))).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("_stop_here", here)
    first_below = F.last(F.when(~F.col("_blank"), F.struct("_stop_here")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("_stop", first_below["_stop_here"])


def labeled_fields(docs: DataFrame, keys: list[str], text: str = "text", fields: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """The keys, the text and for each field its labeled value, null without one: a row for each row of ``docs``.

    A value stands after the label on its line, or on the lines under a label
    that stands alone. Texts are shuffled once. Each line is looked at once: whether it is a
    label, a heading, blank or an address's end; running values over a text's lines give what a
    capture takes. Of several hits of a field the first pattern's first line with a value counts.
    """
    lines = _islands(_line_table(docs, keys, text)).where("_label OR _i = 0")
    hits = [F.when(F.col("_raw").rlike(f"(?iU){p}"), F.struct(F.lit(f).alias("field"), F.lit(k).alias("pattern"), F.regexp_extract("_raw", rf"(?isU)^.*?(?:{p})(.*)$", 1).alias("after"))) for f in fields for k, p in enumerate(LABELS[f])]
    found = lines.withColumn("_hit", F.explode_outer(F.when(F.col("_label"), F.filter(F.array(*hits), lambda h: h.isNotNull()))))
    plain = F.regexp_replace("_hit.after", r"\([^)]*\)", " ")
    found = found.withColumn("_plain", plain)
    written = stripped(F.regexp_extract("_plain", SAME_LINE, 1))
    trailing = F.btrim("_plain", F.lit(" \t:-.,"))
    sentence = (trailing != "") & ~all_caps(trailing)

    def under(field: str) -> Column:
        most, address = UNDER.get(field, (1, False))
        taken = F.filter(F.slice("_next", 1, most), lambda x: x.isNotNull() & (x["_i"] < F.coalesce("_stop", F.lit(1 << 30))))
        if address:
            ends = F.transform(taken, lambda x: looks_like_address_end(x["_line"]))
            last = F.array_position(ends, True).cast("int")
            taken = F.slice(taken, F.lit(1), F.when(last > 0, last).otherwise(most))
        return stripped(F.array_join(F.transform(taken, lambda x: x["_line"]), " "))

    by_field = under("brand_name")
    for f in UNDER:
        by_field = F.when(F.col("_hit.field") == f, under(f)).otherwise(by_field)
    value = F.when(F.col("_plain").rlike(SAME_LINE), written).when(sentence, None).otherwise(by_field)
    found = found.withColumn("_value", F.nullif(value, F.lit("")))
    of = lambda f: F.min(F.when((F.col("_hit.field") == f) & F.col("_value").isNotNull(), F.struct("_hit.pattern", "_i", "_value")))["_value"]
    first = [F.first(c, ignorenulls=True).alias(c) for c in (*keys, "_text")]
    return found.groupBy("_doc").agg(*first, *(of(f).alias(f) for f in fields)).drop("_doc").withColumnRenamed("_text", "text")


def document_fields(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys and the six fields of each document: labeled values first, then what its free text says."""
    found, clean = labeled_fields(docs, keys, text), strip_trailing_noise
    whole, of = F.col("text"), F.col
    kind = F.coalesce(of("class_type"), extract_checkbox_class(whole), extract_class_type(whole))
    producer = F.coalesce(of("producer_info"), F.nullif(extract_producer(whole), F.lit("")))
    fields = {
        "brand_name": clean(of("brand_name")),
        "class_type": clean(strip_class_label(F.coalesce(extract_checkbox_class(kind), kind))),
        "alcohol_content": clean(F.coalesce(of("alcohol_content"), extract_abv(whole))),
        "net_contents": clean(F.coalesce(of("net_contents"), extract_net_contents(whole))),
        "producer_info": clean(trim_to_address_end(stripped(F.regexp_replace(producer, PRODUCER_LABEL, "")))),
        "country_of_origin": clean(F.coalesce(of("country_of_origin"), extract_country(whole))),
    }
    return found.select(*keys, *(c.alias(f) for f, c in fields.items()))
