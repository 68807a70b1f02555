"""Normalising text, volumes, strengths and addresses: column to column, all built-in functions.

Patterns are Java's: ``(?iu)`` ignores case beyond ASCII, ``(?U)`` makes
``\\s``, ``\\d`` and ``\\b`` know Unicode. ``regexp_extract`` gives '' for no
match, so every lookup here turns '' into null.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CATEGORY, CATEGORY_KEYWORDS, COUNTRY_NAMES, NOISE_WORDS, PRODUCER_VERBS, STATE_CODES, STATE_NAMES, STATES

# Patterns that decide what is found.
VOLUME = r"(?iU)(\d+(?:\.\d+)?)\s*(m\.?l\.?|liters?|litres?|l|fl\.?\s?oz\.?)"
PERCENT = r"(?U)(\d{1,3}(?:\.\d+)?)\s*%"
PROOF = r"(?iU)(\d{2,3}(?:\.\d+)?)\s*PROOF"
ML = {"ml": 1.0, "l": 1000.0, "oz": 29.5735}
ZIP = r"\b\d{5}(?:-\d{4})?\b"
CODE = rf"\b(?:{STATE_CODES})\b"
NAME = rf"(?iu:\b(?:{STATE_NAMES})\b)"
COUNTRY = rf"(?iu:\b(?:{COUNTRY_NAMES})\b)"
ADDRESS_END = rf"(?U)(?:{ZIP}|{CODE}|{NAME}|{COUNTRY})"
VERB = "|".join(PRODUCER_VERBS)
PRODUCED_BY = rf"\b(?:{VERB})(?:\s+AND\s+(?:{VERB}))*\s+BY\b\s*[:\-]?\s*"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that costs much: worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def normalize_text(text: Column) -> Column:
    """Lower case without ASCII punctuation, white space collapsed; null is ''."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), string.punctuation, "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def volume_unit(unit: Column) -> Column:
    key = F.lower(F.regexp_replace(unit, r"(?U)[.\s]", ""))
    return F.when(key.startswith("floz"), "oz").when(key.startswith("l"), "l").otherwise("ml")


def volume_ml(text: Column) -> Column:
    """Millilitres of the first number with a unit, else null."""
    unit = volume_unit(found(text, VOLUME, 2))
    factor = F.when(unit == "oz", ML["oz"]).when(unit == "l", ML["l"]).otherwise(ML["ml"])
    return F.try_multiply(found(text, VOLUME, 1).try_cast("double"), factor)


def abv_percent(text: Column) -> Column:
    """Percent by volume: as printed, else half of the proof."""
    return F.coalesce(found(text, PERCENT, 1).try_cast("double"), found(text, PROOF, 1).try_cast("double") / F.lit(2.0))


def abv_proof(text: Column) -> Column:
    return F.coalesce(found(text, PROOF, 1).try_cast("double"), found(text, PERCENT, 1).try_cast("double") * F.lit(2.0))


# ---- states and addresses ------------------------------------------------------------


def _state_table() -> Column:
    return F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))


def normalize_state(state: Column) -> Column:
    """Postal abbreviation of a state's name or abbreviation, else null."""
    key = F.regexp_replace(F.upper(stripped(state)), r"(?U)\s+", " ")
    return F.coalesce(F.try_element_at(_state_table(), key), F.when(key.rlike(f"^(?:{STATE_CODES})$"), key))


def find_state(text: Column) -> Column:
    """An abbreviation in capitals anywhere, else a full name in any case."""
    return F.coalesce(found(text, "(?U)" + CODE), found(text, "(?U)" + NAME))


def state_of(text: Column) -> Column:
    return normalize_state(find_state(text))


def normalize_states(text: Column) -> Column:
    """Full state names replaced by abbreviations, longer names first."""
    names = "|".join(r"\s+".join(n.split()) for n in sorted(STATES, key=lambda n: -len(n)))
    pattern = F.lit(rf"(?iuU)\b(?:{names})\b")
    between, hits = F.split(text, rf"(?iuU)\b(?:{names})\b", -1), F.regexp_extract_all(text, pattern, F.lit(0))
    return F.array_join(F.zip_with(between, hits, lambda x, hit: F.concat(x, F.coalesce(normalize_state(hit), F.lit("")))), "")


def looks_like_address_end(line: Column) -> Column:
    return line.rlike(ADDRESS_END)


def trim_to_address_end(text: Column) -> Column:
    """Up to the last ZIP code, state or country; unchanged without one."""

    def trimmed(text: Column) -> Column:
        upto = F.regexp_extract(text, rf"(?sU)^(.*(?:{ZIP}|{CODE}|{NAME}|{COUNTRY}))", 1)
        return once(upto, lambda upto: F.when(upto != "", F.btrim(upto, F.lit(" ,.-"))).otherwise(text))

    return once(text, trimmed)


def strip_producer_phrase(text: Column) -> Column:
    """Without the first phrase such as "Bottled by"."""
    return F.btrim(F.regexp_replace(text, rf"(?isuU)^(.*?){PRODUCED_BY}", "$1"), F.lit(" ,.-"))


def finalize_producer(text: Column) -> Column:
    return once(text, lambda text: F.when(text == "", text).otherwise(trim_to_address_end(strip_producer_phrase(text))))


def producer_keywords(text: Column) -> Column:
    """Distinct words that tell a producer: no filler words, numbers or single letters."""
    words = F.split(normalize_text(normalize_states(F.coalesce(text, F.lit("")))), " ")
    noise = F.array(*map(F.lit, NOISE_WORDS))
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(noise, w) & ~w.rlike(r"(?U)^\d+$") & (F.length(w) > 1)))


def trie_pattern(words: list[str], space: str = " ") -> str:
    """A pattern for any of the words, the longest that begins at a place; common beginnings are written once."""
    trie: dict = {}
    for word in words:
        node = trie
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def below(node: dict) -> str:
        ways = [(space if letter == " " else re.escape(letter)) + below(child) for letter, child in node.items() if letter]
        if not ways:
            return ""
        whole = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{whole})?" if "" in node else whole

    return below(trie)


def first_by_rank(hits: Column, words: list[str], word: Callable[[Column], Column]) -> Column:
    """Of ``hits`` the first one whose word (as in ``words``) stands first there, as ``rank`` (from 0) and ``hit``; null without any."""
    ranks = F.create_map(*(F.lit(x) for i, w in enumerate(words) for x in (w, i)))
    return F.array_min(F.transform(hits, lambda h, i: F.struct(F.coalesce(F.try_element_at(ranks, word(h)), F.lit(len(words))).alias("rank"), i.alias("at"), h.alias("hit"))))


# At each place the longest designation that is whole words there.
CATEGORY_WORDS = rf"(?U)(?=(\b{trie_pattern(CATEGORY_KEYWORDS)}\b))"


def broad_category(text: Column) -> Column:
    """Broad category of the longest designation that stands in the text as whole words."""
    best = first_by_rank(F.regexp_extract_all(normalize_text(text), F.lit(CATEGORY_WORDS), F.lit(1)), CATEGORY_KEYWORDS, lambda h: h)
    return F.get(F.array(*(F.lit(CATEGORY[k]) for k in CATEGORY_KEYWORDS)), best["rank"])
