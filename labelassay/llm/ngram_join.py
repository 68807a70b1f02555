"""Near-duplicate documents by an exact Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_all_salts, bloom_bits, bloom_has, by_size, done_with, forget_kept, hot_keys, maybe_in, salted, saved, texts
from .components import components
from .shingles import shingle_sets

WORDS, PERCENT = 5, 75
SKETCH = 1 << 22  # counters: 32 MB on the driver, 16 MB in a worker
CHUNK = 1 << 16
MOST_MATCHES = 4
SALT_ROWS = 4096
HEAVY = 8  # pairs for each row of an index entry from which stars are tried first
TRIES = 8  # pairs that a component tries in a round of stars
PARITY_WORDS = 8  # 64-bit words of a set's parity bits
NULL_ID = (1 << 63) - 1


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of a set of ``n`` with any set that it links with."""
    return (percent * n + 99) // 100


# ---- pass 1: set sizes, set digests, parity bits, and a count of shingles by hash ------


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``PARITY_WORDS`` words (int64) for each set: a bit is 1 if an odd number of its shingles fall on it.

    Shingles of both sets cancel out, so two sets differ by at least as many
    shingles as their bits do.
    """
    bits = 64 * PARITY_WORDS
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * bits
    own += (np.concatenate(sets) >> np.uint64(24)).astype(np.int64) & (bits - 1)
    odd = np.bincount(own, minlength=len(sets) * bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(len(sets), PARITY_WORDS)


_BITS = [f"bits{i}" for i in range(PARITY_WORDS)]


def _sizes(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), *((b, pa.int64()) for b in _BITS), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for some in by_size(batch, "text"):
                sets = shingle_sets(texts(some), words)
                at, times = np.unique(np.concatenate(sets) & np.uint64(SKETCH - 1), return_counts=True)
                counts[at] += times.astype(np.uint32)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                none = [None] * len(sets)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *map(pa.array, np.ascontiguousarray(parities(sets).T)), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
        if counts.any():
            parts = [zlib.compress(counts[i : i + CHUNK].astype("<i8").tobytes(), 1) for i in range(0, SKETCH, CHUNK)]
            none = [None] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), *(pa.array(none, pa.int64()) for _ in _BITS), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(x), "<i8")
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _sketch(parts: DataFrame) -> np.ndarray:
    """The counters of all tasks, added in two steps; ``SKETCH`` of them reach the driver.

    From each the number that falls into it by chance is taken off, so that
    what is left tells shingles that many documents have.
    """
    kind = "chunk int, counts binary"
    some = parts.groupBy("chunk", "slice").applyInArrow(_summed, kind)
    out = np.zeros(SKETCH, np.int64)
    for row in some.groupBy("chunk").applyInArrow(_summed, kind).collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    chance = out.sum() / SKETCH
    return np.clip(out - int(chance + 3 * chance**0.5), 1, (1 << 32) - 1).astype(np.uint32)


# ---- pass 2: prefixes --------------------------------------------------------------------


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT, most: int = MOST_MATCHES) -> tuple[np.ndarray, np.ndarray, int]:
    """The tokens to index, the documents expected at each, and how many must match.

    Tokens are ordered by the magnitude of their count, rare ones first, then
    by hash; the order is one for all documents, which is all that exactness
    needs. With ``m`` matches asked for, a prefix has ``n - needed(n) + m``
    tokens: any two linked sets share as many of the first tokens as the lesser
    of their two numbers. ``m`` is the one with the least estimated cost:
    index rows read, and candidates (rows read over ``m``) times the tokens
    that checking one compares.
    """
    n = len(tokens)
    expected = counts[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.int64)
    level = np.frexp(expected.astype(np.float64))[1].astype(np.uint64)
    order = np.argsort((level << np.uint64(58)) | (tokens >> np.uint64(6)), kind="stable")
    base, most = n - int(needed(n, percent)), min(most, int(needed(n, percent)))
    read = np.cumsum(expected[order] - 1)
    cost = [read[base + m - 1] * (1 + n / m) for m in range(1, most + 1)]
    m = 1 + int(np.argmin(cost))
    own = order[: base + m]
    return tokens[own], expected[own], m


def _prefixes(words: int, percent: int, counts, bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = counts.value, bits.value
        for batch in batches:
            batch = batch.filter(pa.array(bloom_has(first, batch.column("hash").to_numpy())))
            for some in by_size(batch, "text"):
                rows: list[tuple] = []
                for doc_id, s in zip(some.column("doc_id").to_pylist(), shingle_sets(texts(some), words)):
                    if len(s):
                        own, expected, m = prefix(s, table, percent)
                        salts = np.maximum(expected // SALT_ROWS, 1)
                        place = np.arange(len(own)) << 3 | (m - 1) << 1 | (salts > 1)
                        rows.append((own.view(np.int64), (doc_id % salts).astype(np.int32), np.full(len(own), doc_id), (len(s) << 34) + place))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["token", "salt", "doc", "packed"])

    return run


def _unpacked(packed: str) -> dict[str, Column]:
    """n, place, m and salted of a row of the index; in one number while it is shuffled."""
    x = F.col(packed)
    return {"n": F.shiftright(x, 34), "place": F.shiftright(x, 3).bitwiseAND((1 << 31) - 1), "m": F.shiftright(x, 1).bitwiseAND(3) + 1, "salted": x.bitwiseAND(1)}


# ---- candidates, checking ------------------------------------------------------------------


def linked(a: list[str], b: list[str], words: int, percent: int) -> list[bool]:
    """For each pair of texts whether their whole shingle sets are as similar; a text that repeats is cut up once."""
    number = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    sets: list[np.ndarray] = []
    held, size = [], 0
    for t in number:
        held.append(t)
        size += len(t)
        if size > 1 << 20:
            sets += shingle_sets(held, words)
            held, size = [], 0
    sets += shingle_sets(held, words) if held else []
    out = []
    for x, y in zip(a, b):
        one, two = sets[number[x]], sets[number[y]]
        same = len(np.intersect1d(one, two, assume_unique=True))
        out.append(100 * same >= percent * (len(one) + len(two) - same))
    return out


def _checked(rows: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: the whole texts are compared.

    Texts are moved and not their sets, which are larger and don't compress.
    """
    spark = rows.sparkSession
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bits = spark.sparkContext.broadcast(bloom_bits(ids, ids.count()))

    @F.pandas_udf("boolean")
    def are_linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(linked(a.tolist(), b.tolist(), words, percent), dtype=bool)

    some = rows.where(maybe_in(bits)("hash")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pairs.join(some.toDF("b", "of_b"), "b").join(some.toDF("a", "of_a"), "a")
    return saved(both.select("a", "b", are_linked("of_a", "of_b").alias("linked")), "checked-pairs")


def _may_link(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _bits_may_link(percent: int) -> Column:
    """Whether two sets' parity bits leave them few enough differing shingles (their sizes less twice the overlap of a link); without bits they may."""
    both = F.col("nx") + F.col("ny")
    differing = sum((F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in _BITS), F.lit(0))
    return F.coalesce(differing, F.lit(0)) <= both - 2 * F.ceil(percent * both / (100 + percent))


def _met(pairs: DataFrame, percent: int, *more: Column) -> DataFrame:
    """Pairs whose sizes fit: how often they meet in their prefixes (``met``) and must meet (``matches``).

    The sizes of two sets tell the overlap that a link needs, so for this pair
    shorter prefixes do: all but that overlap, and the matches asked for. Two
    linked sets share as many tokens of these; a token at a later place isn't
    counted.
    """
    matches = F.least("ma", "mb")
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    inside = lambda n, place: F.col(place) < F.col(n) - overlap + matches
    return pairs.where(_may_link(percent) & inside("na", "pa") & inside("nb", "pb")).groupBy("a", "b").agg(F.count("*").alias("met"), F.min(matches).alias("matches"), *more)


def _of(x: str, head: str = ""):
    """Columns of one side of a pair: its document, and n, m and place under short names."""
    return [F.col(f"{head}{k}").alias(f"{v}{x}") for k, v in (("doc", ""), ("n", "n"), ("m", "m"), ("place", "p"))]


def _reach(percent: int):
    """The largest partner for which a row's place is still inside the pair's prefix (see ``_met``)."""
    return (F.col("n") - F.col("place") + F.col("m") - 1) * (100 + percent) / percent - F.col("n")


def _members_and_parts(mixed: DataFrame, percent: int) -> DataFrame:
    """Rows of ``mixed`` (as x) with the other components of their entry that may hold a partner.

    A row's place in its prefix bounds its partners' size (``reach``): a larger
    one needs more overlap than is left behind that place. So a row goes with a
    component only if the least size there is within its reach, and its own
    size within the greatest reach there. Of two components the one with fewer
    rows at the entry gives the rows.
    """
    rows = mixed.withColumn("reach", _reach(percent))
    parts = rows.groupBy("token", "component").agg(F.min("n").alias("least"), F.max("reach").alias("reach"), F.count("*").alias("k"))
    one, two = (parts.toDF("token", f"c{x}", f"least{x}", f"reach{x}", f"k{x}") for x in "ab")
    across = one.join(two, "token").where("(ka < kb OR ka = kb AND ca < cb) AND leasta <= reachb AND leastb <= reacha").select("token", "ca", "cb", "leastb", "reachb")
    left = rows.select("token", F.col("component").alias("ca"), *_of("x"), *(F.col(b).alias(f"{b}x") for b in _BITS), F.col("reach").alias("reachx"))
    return across.join(left, ["token", "ca"]).where("nx <= reachb AND leastb <= reachx").drop("leastb", "reachb")


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of rows of an entry in different components, each in the other's reach, whose parity bits allow a link.

    Members of components that share an entry and don't link are as many pairs
    as the square of the components; the bits decide within the join, so that
    they aren't rows.
    """
    right = mixed.select("token", F.col("component").alias("cb"), *_of("y"), *(F.col(b).alias(f"{b}y") for b in _BITS), _reach(percent).alias("reachy"))
    pairs = _members_and_parts(mixed, percent).join(right, ["token", "cb"]).where(F.expr("ny <= reachx AND nx <= reachy") & _bits_may_link(percent))
    return pairs.drop(*(f"{b}{x}" for b in _BITS for x in "xy"))


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, star_rounds: int = 2) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` % or more.

    Reads ``doc_id`` and ``text``; other columns are left out. A-Z are
    lower-cased and words split at ASCII white space. Texts with fewer than
    ``words`` words are one shingle; null or empty texts have an empty set and
    link with nothing. Rows that share a doc_id count as one document that
    links where any of its rows does; rows without one count as one document
    whose component is that of what it links with, else null. An empty table
    gives no rows.

    Equal sets become one class first. Each class is indexed by its prefix.
    Instead of all pairs of an index entry, its first document is paired with
    the others; what is linked becomes one component. Where many pairs from
    different components of an entry are left, each component then tries a few
    with members of the entry's largest component, drawn anew in each round;
    at last all pairs from different components are tried. So large groups
    cost some stars and no link that joins two components is lost.

    Returns a row for each row of ``docs``: doc_id, n_shingles, component_id,
    class_id (smallest doc_id with the same set).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id"))
    first = saved(rows.drop("hash").mapInArrow(_sizes(words), f"doc_id long, n long, digest binary, {', '.join(f'{b} long' for b in _BITS)}, chunk int, counts binary").withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(16))), "shingle-sizes")
    classed = _classes(first.where("chunk IS NULL").select("doc_id", "n", "digest"))
    leaders = classed.where("n > 0").select(F.col("class_id").alias("id")).distinct()
    counts = spark.sparkContext.broadcast(_sketch(first.where("chunk IS NOT NULL").select("chunk", "counts", "slice")))
    bits = spark.sparkContext.broadcast(bloom_bits(leaders, leaders.count()))
    index = rows.mapInArrow(_prefixes(words, percent, counts, bits), "token long, salt int, doc long, packed long")

    # Entries with one document are left out here; a salted entry may have others under other salts.
    entry = "PARTITION BY token, salt"
    index = index.selectExpr("token", "doc", "packed", f"count(*) OVER ({entry}) AS entries", f"min(struct(doc, packed)) OVER ({entry}) AS head").where("entries > 1 OR packed & 1 = 1")
    of_head = {f"head_{k}": v for k, v in {"doc": F.col("head.doc"), **_unpacked("head.packed")}.items() if k != "salted"}
    index = saved(index.select("token", "doc", *(v.alias(k) for k, v in _unpacked("packed").items()), "entries", *(v.alias(k) for k, v in of_head.items())), "shared-prefixes")

    copies = classed.where("doc_id != class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    # Where two documents are alone at an entry, their star is all there is to it; how often
    # they met there is added at the end to what is found at entries with more documents.
    alone = (F.col("entries") == 2) & (F.col("salted") == 0)
    stars = index.where("doc > head_doc").select(*_of("a", "head_"), *_of("b"), alone.alias("alone"))
    stars = saved(_met(stars, percent, F.count_if("alone").alias("met_alone")).where("met >= matches OR met_alone > 0"), "star-pairs")
    tried = _checked(rows, stars.where("met >= matches").select("a", "b"), words, percent)
    begun = stars.where("met < matches").select("a", "b", F.col("met_alone").alias("met"), "matches")
    left, own = index.where("entries > 2 OR salted > 0").select("token", "doc", "n", "m", "place"), [index]
    for round_ in range(star_rounds + 1):
        found = saved(components(tried.where("linked").select("a", "b")), "components")
        placed = saved(left.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "prefix-components")
        # From here on only entries with several components are read; which they are takes two numbers a token.
        ends = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        mixed = saved(placed.join(ends.where("low != high").select("token"), "token"), "mixed-prefixes")
        done_with(placed, found, *own)
        dice = F.xxhash64("doc", "token", F.lit(round_))
        heads = mixed.groupBy("token", "component").agg(F.count("*").alias("k"), F.min(F.struct(dice.alias("dice"), "doc", "n", "m")).alias("head"))
        several = heads.groupBy("token").agg(F.max(F.struct("k", "component", "head")).alias("top"), F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("squares"))
        heavy = saved(several.where((F.col("all") * F.col("all") - F.col("squares")) / 2 > HEAVY * F.col("all")), "heavy-entries")
        left, own = mixed.drop("component"), [mixed, heavy]
        if round_ == star_rounds or heavy.isEmpty():
            break
        # Of each component some entries: its member of the dice there with one of the largest component.
        stars = heads.join(heavy.select("token", "top"), "token").where(F.col("component") != F.col("top.component"))
        lot = F.xxhash64("token", "component", F.lit(round_))
        stars = stars.groupBy("component", F.pmod(lot, F.lit(TRIES)).alias("lot")).agg(F.min(F.struct(lot.alias("by"), F.col("head").alias("x"), F.col("top.head").alias("y"))).alias("at"))
        stars = stars.select(F.least("at.x.doc", "at.y.doc").alias("a"), F.greatest("at.x.doc", "at.y.doc").alias("b"), F.col("at.x.n").alias("na"), F.col("at.y.n").alias("nb"))
        new = stars.where(_may_link(percent)).select("a", "b").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        more = _checked(rows, saved(new, "star-pairs"), words, percent)
        tried = saved(tried.unionByName(more), "tried-pairs")
        if more.where("linked").isEmpty():
            break

    # What is left: all pairs from different components of an entry.
    # A doc_id that several rows share has several sets, and no bits: all its pairs pass.
    parity = first.where("n > 0").groupBy(F.col("doc_id").alias("doc")).agg(*(F.when(F.count("*") == 1, F.min(b)).alias(b) for b in _BITS))
    pairs = _across(mixed.join(parity, "doc"), percent)
    turned = F.col("x") > F.col("y")
    pairs = pairs.select(*(F.when(turned, F.col(f"{k}{p}")).otherwise(F.col(f"{k}{q}")).alias(f"{k}{out}") for k in ("", "n", "m", "p") for p, q, out in (("y", "x", "a"), ("x", "y", "b"))))
    met = _met(pairs, percent).unionByName(begun).groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("matches").alias("matches"))
    rest = saved(met.where("met >= matches").select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti"), "cross-pairs")
    done_with(first, *own)
    if not rest.isEmpty():
        tried = tried.unionByName(_checked(rows, rest, words, percent))

    found = components(tried.where("linked").select("a", "b").unionByName(copies))
    out = classed.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    null = F.lit(NULL_ID)
    return out.select(F.nullif("doc_id", null).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "doc_id"), null).alias("component_id"), F.nullif("class_id", null).alias("class_id"))


def _classes(sizes: DataFrame) -> DataFrame:
    """doc_id, n and class_id, the least doc_id with the same set; large classes are dealt over salts for the join."""
    of = F.min(F.when(F.col("n") > 0, F.col("doc_id"))).alias("class_id")  # empty sets are no class, but may be many
    classes = saved(sizes.groupBy("digest").agg(of, F.count("*").alias("k")).where("k > 1"), "shingle-copies")
    hot = hot_keys(classes.select("digest", F.col("k").alias("n")), sizes.count())
    classed = salted(sizes, hot, "digest", "doc_id").join(at_all_salts(classes.drop("k"), hot, "digest"), ["digest", "salt"], "left")
    classed = saved(classed.select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "shingle-classes")
    done_with(classes)
    return classed
