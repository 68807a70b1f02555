"""The mandatory fields from a label's text: column to column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLASS_KEYWORDS, CLASS_SUFFIXES
from .text import first_by_rank, found, once, stripped, trie_pattern

# Patterns that decide what is found.
ABV_AFTER = r"(?iuU)(\d{1,3}(?:\.\d+)?)\s*%\s*ALC(?:OHOL)?\.?\s*(?:BY|/)\s*VOL\.?"
ABV_BEFORE = r"(?iuU)ALC(?:OHOL)?\.?(?:\s*(?:BY\s*)?/?\s*VOL(?:UME)?\.?)?\s*[:\-]?\s*(\d{1,3}(?:\.\d+)?)\s*%"
ABV_PROOF = r"(?iuU)(\d{2,3}(?:\.\d+)?)\s*PROOF"
NET_CONTENTS = r"(?iuU)\b(\d+(?:\.\d+)?)\s*(m\.?l\.?|liters?|litres?|l|fl\.?\s?oz\.?)\b"
COUNTRY = r"(?iU)PRODUCT\s+OF\s+([A-Za-z][A-Za-z\s]{1,40})"
WARNING = r"(?isU)GOVERNMENT\s+WARNING.{0,600}"
HEADING = r"(?iU)GOVERNMENT\s+WARNING"
CHECKBOX = r"(?U)[\[(]?\b[Xx☒☑][\])]?\s*[:\-]?\s*((?i:WINE|DISTILLED\s+SPIRITS|MALT\s+BEVERAGE))\b"
CLASS_LABEL = r"(?iU)^\s*(?:CLASS\s*(?:AND|/)?\s*TYPE(?:\s*OF\s*PRODUCT)?|TYPE\s*OF\s*PRODUCT|CLASS)\s*[:\-]?\s*"
TRAILING = r"(?iU)\s*[(\[]?\s*(?:FRONT|BACK|SIDE|NECK|MAIN)(?:\s+LABEL)?\s*[)\]]?\s*$"


def collapsed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def extract_abv(text: Column) -> Column:
    percent = F.coalesce(found(text, ABV_AFTER, 1), found(text, ABV_BEFORE, 1))
    proof = found(text, ABV_PROOF, 1)
    return F.coalesce(F.concat(percent, F.lit("% ALC/VOL ("), proof, F.lit(" PROOF)")), F.concat(percent, F.lit("% ALC/VOL")), F.concat(proof, F.lit(" PROOF")))


def extract_net_contents(text: Column) -> Column:
    return F.concat(found(text, NET_CONTENTS, 1), F.lit(" "), found(text, NET_CONTENTS, 2))


def extract_country(text: Column) -> Column:
    name = stripped(found(text, COUNTRY, 1))
    return F.nullif(F.btrim(F.get(F.split(name, r"(?U)\s{2,}|[\r\n]"), F.lit(0)), F.lit(" .,")), F.lit(""))


def extract_warning(text: Column) -> Column:
    return collapsed(found(text, WARNING))


def heading_all_caps(text: Column) -> Column:
    """Whether the warning's heading is in capitals; null without one."""
    heading = found(text, HEADING)
    return heading == F.upper(heading)


def strip_class_label(text: Column) -> Column:
    return stripped(F.regexp_replace(text, CLASS_LABEL, ""))


def strip_trailing_noise(text: Column) -> Column:
    return stripped(F.regexp_replace(text, TRAILING, ""))


# At each place the longest designation, its words parted by up to 20 white-space characters, and a base word right after it.
DESIGNATION = rf"(?iuU){trie_pattern(CLASS_KEYWORDS, r'\s{1,20}')}"
DESIGNATION_AT = rf"(?=({DESIGNATION}(?:\s+(?:{'|'.join(CLASS_SUFFIXES)})(?![A-Za-z]))?))"
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")  # letters that match these when case is ignored


def extract_class_type(text: Column) -> Column:
    """The longest designation that occurs anywhere, with a base word right after it.

    Up to 20 white-space characters may part the words of a designation. The
    text is scanned once for all designations.
    """
    word = lambda h: F.lower(F.translate(F.regexp_replace(F.regexp_extract(h, f"^{DESIGNATION}", 0), r"(?U)\s+", " "), *FOLDED))
    best = first_by_rank(F.regexp_extract_all(text, F.lit(DESIGNATION_AT), F.lit(1)), CLASS_KEYWORDS, word)
    keyword = lambda best: F.initcap(F.get(F.array(*map(F.lit, CLASS_KEYWORDS)), best["rank"]))
    clean = lambda best: strip_trailing_noise(strip_class_label(collapsed(best["hit"])))
    return once(best, lambda best: once(clean(best), lambda hit: F.when(hit != "", hit).otherwise(keyword(best))))


def extract_fields(text: Column) -> dict[str, Column]:
    """The fields that are read from a label's text alone."""
    return {
        "class_type": extract_class_type(text),
        "alcohol_content": extract_abv(text),
        "net_contents": extract_net_contents(text),
        "country_of_origin": extract_country(text),
        "health_warning_text": extract_warning(text),
    }


def extract_checkbox_class(text: Column) -> Column:
    return F.initcap(collapsed(found(text, CHECKBOX, 1)))
