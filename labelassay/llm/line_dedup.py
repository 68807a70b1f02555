"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one line for each group."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_all_salts, bloom_bits, by_size, done_with, hot_keys, located, maybe_in, salted, saved, texts
from .components import components
from .shingles import mix, word_hashes

_NOT_WORD = re.compile(r"[\W_]+")
_ODD = re.compile(r"[^\w\x00-\x7f]")
_SPACED = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
DISTANCE = 3  # bits; the blocks find every pair within this
MORE_BLOCKS = 2  # than ``DISTANCE``: so many blocks are a key
REACH = 10  # bits; pairs that meet under a key are compared up to this
SIMILARITY = 0.75
FEW = 32  # lines after it that a line looks at under a key
GROUPS, GROUP_WORDS = 4, 3  # a line's words are dealt into groups; one with so many words is a key, too
GROUP_REACH = 24  # bits, for pairs that meet under the words of a group


def normalise(line: str) -> str:
    """Lower case; each run of other characters than letters and digits is one space."""
    line = line.lower()
    if not line.isascii() and _ODD.search(line):
        return _NOT_WORD.sub(" ", line).strip()
    return b" ".join(line.encode().translate(_SPACED).split()).decode()  # the same, faster


#: For each byte its eight bits as the eight bytes of a number, so that sums count bits.
_BITS = np.array([sum((x >> i & 1) << 8 * i for i in range(8)) for x in range(256)], np.uint64)
_MOST = 255  # words whose bits a byte can count


def distinct_words(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of normalised lines and the line of each, in order of line and hash."""
    hashes, counts = word_hashes(lines)
    of = np.repeat(np.arange(len(lines)), counts)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return np.ascontiguousarray(hashes[new]), of[new]


def group_keys(n: int, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` lines and each group its key, and whether it has one: from ``GROUP_WORDS`` words on.

    A word's group are the leading bits of its hash, so a word that is
    replaced changes two of the four groups at most, wherever it stands; a
    line with one changed word keeps two groups and more.
    """
    keys, there = np.zeros((n, GROUPS), np.uint64), np.zeros((n, GROUPS), bool)
    if len(hashes):
        group = (hashes >> np.uint64(62)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (group[1:] != group[:-1])]))
        at = of[first], group[first]
        keys[at] = mix(np.add.reduceat(mix(hashes), first) + group[first].astype(np.uint64))
        there[at] = np.diff(first, append=len(hashes)) >= GROUP_WORDS
    return keys, there


def simhashes(lines: list[str]) -> np.ndarray:
    """64-bit SimHash of each normalised line over its distinct words; a tied bit is 0."""
    return _simhashes(len(lines), *distinct_words(lines))


def _simhashes(n: int, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    counts = np.bincount(of, minlength=n)
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        own = counts[some]
        parts = -(-own // _MOST)  # of each line
        first = np.cumsum(parts) - parts
        inside = np.arange(parts.sum()) - np.repeat(first, parts)
        starts = np.repeat(np.cumsum(own) - own, parts) + inside * _MOST
        sums = np.add.reduceat(_BITS[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > own[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _lines(text: str) -> list[tuple[int, str]]:
    """Number and normalised form of the lines that have a letter or digit."""
    return [(k, n) for k, n in enumerate(map(normalise, text.split("\n"))) if n]


def _ids(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) for n in lines], np.uint64).view(np.int64)


_LINE = "doc_id long, file long, row long, number int, line long, simhash long, " + ", ".join(f"g{k} long" for k in range(GROUPS)) + ", words string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in by_size(batch, "text"):
            found = [_lines(text) for text in texts(some)]
            lines = [n for own in found for _, n in own]
            if lines:
                of = np.repeat(np.arange(len(found)), [len(own) for own in found])
                rows = [some.column(c).take(pa.array(of)) for c in ("doc_id", "file", "row")]
                numbers = pa.array([k for own in found for k, _ in own], pa.int32())
                words = distinct_words(lines)
                keys, there = group_keys(len(lines), *words)
                groups = [pa.array(keys[:, k].view(np.int64), mask=~there[:, k]) for k in range(GROUPS)]
                yield pa.RecordBatch.from_arrays([*rows, numbers, pa.array(_ids(lines)), pa.array(_simhashes(len(lines), *words).view(np.int64)), *groups, pa.array(lines, pa.string())], names=["doc_id", "file", "row", "number", "line", "simhash", *(f"g{k}" for k in range(GROUPS)), "words"])


def _keys(simhash: Column, blocks: int, distance: int, bits: int = 64) -> Column:
    limits = [bits * i // blocks for i in range(blocks + 1)]
    masks = [((1 << limits[i + 1]) - (1 << limits[i])) for i in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(masks, blocks - distance)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(k), simhash.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _apart() -> Column:
    return F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; a column of the table is two bit vectors.

    On these lines 60,000 pairs took 277 CPU seconds with Spark's
    ``levenshtein`` and its limit, and about a tenth of that this way.
    """
    at, end = 0, min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    a, b, tail = a[at:], b[at:], 0
    end = min(len(a), len(b))
    while tail < end and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last, count = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # rows where the table grows, or falls, by one
    for x in b:
        hit = where.get(x, 0)
        level = (((hit & up) + up) ^ up) | hit
        grow, fall = (down | ~(level | up)) & full, up & level
        count += (grow & last != 0) - (fall & last != 0)
        grow, fall = grow << 1 | 1, fall << 1
        up, down = (fall | ~(hit | down | grow)) & full, grow & (hit | down) & full
    return count


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two lists of words (a row of the table is one number)."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for x in b:
        hit = state & where.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether 1 - edit distance / longer length reaches ``similarity``.

    Bounds decide first: taking out and putting in the words beside a longest
    common subsequence of words is no fewer edits, however long these are, and
    letters that one has too many of are no more.
    """
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer)
    if abs(len(a) - len(b)) > most:
        return False
    one, two = a.split(" "), b.split(" ")
    common = common_words(one, two)
    if sum(sum(sorted(map(len, w))[common:]) + len(w) - common for w in (one, two)) <= most:
        return True
    if len(a) > 200:
        left, right = Counter(a), Counter(b)
        if max((left - right).total(), (right - left).total()) > most:
            return False
    return edit_distance(a, b) <= most


def _similar(pairs: DataFrame, occurrences: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with ``linked``: 1 - edit distance / longer length reaches ``similarity``."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = maybe_in(pairs.sparkSession.sparkContext.broadcast(bloom_bits(ids, ids.count())))
    lines = occurrences.select("line", "words").where(wanted(F.xxhash64("line"))).groupBy("line").agg(F.first("words").alias("words"))
    lines = saved(lines.join(ids.withColumnRenamed("id", "line"), "line", "left_semi"), "candidate-lines")
    both = pairs.join(lines.toDF("a", "wa"), "a").join(lines.toDF("b", "wb"), "b")

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([similar(x, y, similarity) for x, y in zip(left, right)], dtype=bool)

    out = saved(both.select("a", "b", linked("wa", "wb").alias("linked")), "checked-lines")
    done_with(lines)
    return out


def line_groups(occurrences: DataFrame, per_line: DataFrame, distance: int, reach: int, similarity: float) -> DataFrame:
    """The group of each line that has a near copy (node, component)."""
    # The last bit of a key tells what kind it is, and so the bits that its pairs may differ in.
    blocks = F.transform(_keys(F.col("simhash"), distance + MORE_BLOCKS, distance), lambda k: F.shiftleft(k, 1))
    groups = F.filter(F.array(*(F.shiftleft(f"g{k}", 1).bitwiseOR(F.lit(1)) for k in range(GROUPS))), lambda k: k.isNotNull())
    keyed = per_line.select("line", "simhash", F.explode(F.concat(blocks, groups)).alias("key"))
    most = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, GROUP_REACH).otherwise(reach)
    close = lambda of: F.bit_count(F.col("simhash").bitwiseXOR(of["simhash"])) <= most
    # Under a key each line looks at the few lines after it; a key with more lines is crowded. Most lines that
    # meet are in one group, so first a line is only tried with the first line of its key and the next one within
    # reach; then, where a key still has lines of several components, with those of other components.
    after = f"collect_list(struct(*)) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN 1 FOLLOWING AND {FEW} FOLLOWING) AS after"
    met = keyed.selectExpr("*", after, "first_value(struct(line, simhash)) OVER (PARTITION BY key ORDER BY line) AS head", "count(*) OVER (PARTITION BY key) AS k").where("k > 1")
    met = met.withColumn("next", F.get(F.filter("after", close), F.lit(0))["line"]).drop("after").selectExpr("*", "count(next) OVER (PARTITION BY key) AS some")
    met = met.where((F.col("some") > 0) | (F.col("k") > FEW)).select("key", "line", "simhash", "k", "next", F.when(close(F.col("head")), F.col("head.line")).alias("head"))
    met = saved(met, "met-lines")
    first = met.select(F.col("head").alias("a"), F.col("line").alias("b")).union(met.select("line", "next")).where("a < b")
    tried = _similar(saved(first.distinct(), "line-pairs"), occurrences, similarity)
    found = saved(components(tried.where("linked").select("a", "b")), "line-components")
    mixed = _mixed(met.select("key", "line", "simhash", "k"), found)
    done_with(met)
    others = F.filter("after", lambda y: close(y) & (y["component"] != F.col("component")))
    pairs = mixed.selectExpr("*", after).select(F.col("line").alias("a"), F.explode(F.transform(others, lambda y: y["line"])).alias("b"))
    rest = _untried(pairs, tried)
    if not rest.isEmpty():
        tried = tried.unionByName(_similar(rest, occurrences, similarity))
        found = saved(components(tried.where("linked").select("a", "b")), "line-components")
    crowded = mixed.where(F.col("k") > FEW).drop("component")
    if not crowded.isEmpty():
        crowded = _mixed(crowded, found)
        parts = saved(crowded.select("key", "component").distinct(), "mixed-keys")
        across = parts.withColumnRenamed("component", "ca").join(parts.withColumnRenamed("component", "cb"), "key").where("ca < cb")
        side = lambda c, x, h: crowded.select("key", F.col("component").alias(c), F.col("line").alias(x), F.col("simhash").alias(h))
        pairs = across.join(side("ca", "x", "ha"), ["key", "ca"]).join(side("cb", "y", "hb"), ["key", "cb"]).where(_apart() <= most)
        rest = _untried(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), tried)
        done_with(crowded, parts)
        if not rest.isEmpty():
            tried = tried.unionByName(_similar(rest, occurrences, similarity))
            found = saved(components(tried.where("linked").select("a", "b")), "line-components")
    done_with(mixed)
    return found


def _mixed(met: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the keys with lines of several components, and the component of each."""
    placed = saved(met.join(found.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line")), "placed-keys")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    out = saved(placed.join(several, "key"), "mixed-lines")
    done_with(placed)
    return out


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    return saved(pairs.distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), "cross-lines")


def _kept_places(per_line: DataFrame, groups: DataFrame) -> DataFrame:
    """line and first: of each line that occurs, or whose group occurs, more than once, the place that stays."""
    lines = per_line.select("line", "k", "first").join(groups.withColumnRenamed("node", "line"), "line", "left")
    lines = lines.withColumn("component", F.coalesce("component", "line"))
    kept = saved(lines.groupBy("component").agg(F.min("first").alias("kept"), F.sum("k").alias("all"), F.count("*").alias("n")).where("all > 1"), "line-kept")
    hot = hot_keys(kept.select("component", "n"), per_line.count())
    out = salted(lines, hot, "component", "line").join(at_all_salts(kept.select("component", "kept"), hot, "component"), ["component", "salt"])
    return saved(out.select("line", "k", F.col("kept").alias("first")), "line-places")


def line_dedup(docs: DataFrame, distance: int = DISTANCE, reach: int = REACH, similarity: float = SIMILARITY) -> DataFrame:
    """Keep one occurrence of every group of equal or nearly equal lines.

    Reads ``doc_id`` and ``text``; other columns are left out. Lines end at a
    line feed. Normalised, two lines are compared when their SimHashes agree in
    two of five blocks (``DISTANCE`` + ``MORE_BLOCKS``) and differ in at most ``reach`` bits, which holds for
    all pairs within ``distance`` bits, or when a group of their words (see
    ``group_keys``) is the same and they differ in at most ``GROUP_REACH``
    bits. Neither depends on how many lines there are. They link when their edit similarity (1 - edit distance / longer length, in characters)
    is ``similarity`` or more; groups are connected by links. Of a group the
    first occurrence stays: least doc_id (null last), then the row's place,
    then the line's number. Lines without a letter or digit always stay. Null
    texts count as empty. Rows that share a doc_id are rows of their own; an
    empty table gives no rows.

    Returns a row for each row of ``docs``: doc_id, n_lines, n_dropped, dropped
    (numbers of the lines dropped, from 0) and text (the lines kept).
    """
    rows = located(docs.select("doc_id", "text"))
    rows = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.xxhash64("at.file").alias("file"),
        F.col("at.row").alias("row"),
    )
    occurrences = saved(rows.mapInArrow(_hashed, _LINE), "lines")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "file", "row", "number")
    per_line = saved(occurrences.groupBy("line").agg(F.first("simhash").alias("simhash"), *(F.first(f"g{k}").alias(f"g{k}") for k in range(GROUPS)), F.min(place).alias("first"), F.count("*").alias("k")), "distinct-lines")
    places = _kept_places(per_line, line_groups(occurrences, per_line, distance, reach, similarity))

    hot = hot_keys(places.select("line", F.col("k").alias("n")), occurrences.count())
    numbered = salted(occurrences.select("line", place.alias("place")), hot, "line", "place")
    later = numbered.join(at_all_salts(places.select("line", "first"), hot, "line"), ["line", "salt"]).where("place != first")
    dropped = saved(later.groupBy("place.file", "place.row").agg(F.array_sort(F.collect_list("place.number")).alias("dropped")), "dropped-lines")
    done_with(occurrences, per_line, places)

    # Rows that surely lose no line needn't be shuffled.
    ids = dropped.select(F.xxhash64("file", "row").alias("id"))
    maybe = maybe_in(rows.sparkSession.sparkContext.broadcast(bloom_bits(ids, ids.count())))
    marked = rows.withColumn("maybe", maybe(F.xxhash64(F.xxhash64("file", "row"))))
    whole = marked.where("NOT maybe").withColumn("dropped", F.array().cast("array<int>"))
    cut = marked.where("maybe").join(dropped, ["file", "row"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    out = whole.unionByName(cut)
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("dropped", i)), "\n")
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped", F.when(F.size("dropped") == 0, F.col("text")).otherwise(kept).alias("text"))
