"""Fill-in-middle: documents cut at two units and rearranged, all by relational operators.

A text is a sequence of units, the matches of a pattern from left to right.
Units are exploded as blocks of up to ``BLOCK`` in a row, so that a text gives a
row for each block and not for each unit; running sums over the blocks give
the units and code points before each, cut requests are joined to the block that
holds their unit, and what lies inside that block is measured there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import located, saved

#: Patterns of a unit; the matches cover a text without a gap.
UNITS = {
    "code_point": r"(?s:.)",
    "word": r"(?U:\s*+\S++|\s++)",
    "line": r"(?:[^\n]*+\n|[^\n]++)",
}
BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ROW = ["_file", "_row"]  # a document's place tells rows apart that share or lack a doc_id


def dice(doc_id: Column, salt: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight digits of the sha256 of ``salt`` and the decimal id (null: none)."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_blocks(rows: DataFrame, unit: str) -> DataFrame:
    """A row for each block of units of each text: ``ROW``, doc_id, block, units and code points in it; written once."""
    matches = F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{BLOCK}}}+"), F.lit(0))
    blocks = rows.select(*ROW, "doc_id", F.posexplode(matches).alias("block", "match"))
    size = F.length("match")
    units = size if unit == UNITS["code_point"] else F.regexp_count("match", F.lit(unit))
    return saved(blocks.select(*ROW, "doc_id", "block", units.cast("long").alias("units"), size.cast("long").alias("points")), "unit-blocks")


def cut_requests(blocks: DataFrame) -> DataFrame:
    """``ROW``, n (units of the text), name (lo, hi) and ``wanted``: the units before each cut."""
    counted = blocks.groupBy(*ROW).agg(F.first("doc_id").alias("doc_id"), F.sum("units").alias("n"))
    h1, h2 = dice(F.col("doc_id"))[:2]
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cuts = F.array(F.struct(F.lit("lo").alias("name"), F.least(first, second).alias("wanted")), F.struct(F.lit("hi").alias("name"), F.greatest(first, second).alias("wanted")))
    return counted.select(*ROW, "n", F.explode(cuts).alias("r")).select(*ROW, "n", "r.*")


def cut_blocks(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """``ROW``, n and ``found``: for each request the block that holds its last unit, and how many of the block's units it takes.

    A cut before the first unit is in no block, and its place is 0.
    """
    w = Window.partitionBy(*ROW).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = blocks.select(*ROW, "units", "points", (F.sum("units").over(w) - F.col("units")).alias("units_before"), (F.sum("points").over(w) - F.col("points")).alias("points_before"))
    inside = (F.col("wanted") > F.col("units_before")) & (F.col("wanted") <= F.col("units_before") + F.col("units"))
    found = requests.join(before.withColumnsRenamed({c: f"of{c}" for c in ROW}), (F.col("_file") == F.col("of_file")) & (F.col("_row") == F.col("of_row")) & inside, "left")
    hit = F.when(F.col("of_row").isNotNull(), F.struct("name", "points_before", "points", (F.col("wanted") - F.col("units_before")).cast("int").alias("rest")))
    return found.groupBy(*ROW).agg(F.first("n").alias("n"), F.collect_list(hit).alias("found"))


def with_cuts(rows: DataFrame, found: DataFrame, unit: str) -> DataFrame:
    """``rows`` with n and ``cuts``: code points before each cut, a map by its name."""

    def place(f: Column) -> Column:
        if unit == UNITS["code_point"]:
            return f["points_before"] + f["rest"]
        match = F.substr("text", (f["points_before"] + 1).cast("int"), f["points"].cast("int"))
        head = F.slice(F.regexp_extract_all(match, F.lit(unit), F.lit(0)), F.lit(1), f["rest"])
        return f["points_before"] + F.aggregate(head, F.lit(0).cast("long"), lambda n, u: n + F.length(u))

    cuts = F.map_from_entries(F.transform("found", lambda f: F.struct(f["name"], place(f).cast("int"))))
    return rows.join(found, ROW, "left").withColumn("cuts", cuts).drop("found")


def fill_in_middle(docs: DataFrame, unit: str = UNITS["code_point"], plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Every text as ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).

    Reads ``doc_id`` and ``text``; other columns are left out. h1 to h4 come
    from ``dice``; with n units, the prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text
    that is null (counts as empty), empty or holds a marker stays plain, as
    do those with h3 % 100 from 100 - ``plain_percent`` on; of the others
    h4 % 100 < ``spm_percent`` gives spm. Rows that repeat or share a doc_id
    are cut each, a null doc_id is like an empty one; an empty table gives no
    rows. ``unit`` is a pattern whose matches cover every text (see ``UNITS``).

    Returns doc_id, n (units), form, prefix_chars and middle_chars (code
    points; null if plain), ``text`` and ``output``. Texts are shuffled once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = located(docs.select("doc_id", "text"))
    # Two numbers instead of the struct: a file's path would be as long as a short text.
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("at.file").alias("_file"), F.col("at.row").alias("_row"))
    blocks = unit_blocks(rows, unit)
    placed = with_cuts(rows, cut_blocks(blocks, cut_requests(blocks)), unit)
    h3, h4 = dice(F.col("doc_id"))[2:]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    at = lambda name: F.coalesce(F.try_element_at("cuts", F.lit(name)), F.lit(0))
    placed = placed.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "text", form.alias("form"), at("lo").alias("lo"), at("hi").alias("hi"))
    cut = F.col("form") != "plain"
    prefix, middle = F.substr("text", F.lit(1), F.col("lo")), F.substr("text", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    suffix = F.substr("text", F.col("hi") + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return placed.select("doc_id", "n", "form", F.when(cut, F.col("lo")).cast("long").alias("prefix_chars"), F.when(cut, F.col("hi") - F.col("lo")).cast("long").alias("middle_chars"), "text", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its markers and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fim_digest(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` by code points with the sha256 of each output and of the text rebuilt from it."""
    made = fill_in_middle(docs)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
