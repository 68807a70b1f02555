"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, located, saved, scan_of, texts
from .shingles import NOT_ALNUM, word_hashes

BLOCK = 16  # words; a passage is two blocks in a row, so passages overlap by half
RUN = 3  # words in a row that make a passage a candidate at any cosine
RANK, MORE = 32, 8  # dimensions beside those of the items
ITEM_BLOCK = 256  # items searched at a time
FOUND = "doc_id long, file long, row long, item_id long, passage_start int, cosine double, lcs_share double, answer_share double"


def word_codes(texts: list[str], vocabulary: np.ndarray) -> list[np.ndarray]:
    """Each text's words as numbers, from 1, in the sorted ``vocabulary`` of hashes; 0 if not in it.

    Words are runs of letters and digits in lower case (beyond ASCII every character counts as a letter).
    """
    hashes, counts = word_hashes([t.lower() for t in texts], NOT_ALNUM)
    if not len(vocabulary):
        codes = np.zeros(len(hashes), np.uint32)
    else:
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        codes = np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)
    return np.split(codes, np.cumsum(counts)[:-1]) if len(counts) else []


def _coded(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_size(batch, "text"):
                codes = [c.astype("<u4").tobytes() for c in word_codes(texts(some), vocabulary.value)]
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("doc_id", "file", "row")] + [pa.array(codes, pa.binary())], names=["doc_id", "file", "row", "codes"])

    return run


@dataclass
class Words:
    """The words of many documents in a row; every document starts a new block."""

    codes: list[np.ndarray]
    flat: np.ndarray
    block: np.ndarray  # of each word
    first: np.ndarray  # block of each document, and the number of blocks at the end


def in_blocks(codes: list[np.ndarray]) -> Words:
    sizes = np.array([len(c) for c in codes], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    inside = np.arange(len(flat)) - np.repeat(starts, sizes)
    return Words(codes, flat, np.repeat(first[:-1], sizes) + inside // BLOCK, first)


def _parts(batch: pa.RecordBatch, limit: int = 400_000) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for some in by_size(batch, "codes", 4 * limit):
        yield some, in_blocks([np.frombuffer(x.as_buffer(), "<u4") for x in some.column("codes")])


def spread(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each row (rows sorted)."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often this task's documents have each term, and blocks of words as term -1."""
    counts, blocks = np.zeros(1, np.int64), 0
    for batch in batches:
        for _, words in _parts(batch):
            own = np.bincount(words.flat, minlength=len(counts))
            own[: len(counts)] += counts
            counts, blocks = own, blocks + int(words.first[-1])
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([blocks, *counts[at]], pa.int64())], names=["term", "n"])


@dataclass
class Latent:
    """TF-IDF weights of terms, and where each term lies in the latent space."""

    idf: np.ndarray  # 0 for terms that are too common
    axes: np.ndarray  # terms, dimensions: right singular vectors

    def entries(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Block and term of every word that has a weight."""
        at = np.flatnonzero(self.idf[words.flat] > 0)
        return words.block[at], words.flat[at]


def _range_step(model, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """This task's part of AᵀA times the current axes: a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent: Latent = model.value
        weighted = latent.axes * latent.idf[:, None].astype(np.float32)
        total = np.zeros(latent.axes.shape, np.float64)
        for batch in batches:
            for _, words in _parts(batch):
                block, term = latent.entries(words)
                row = block // 2  # passages side by side; each has length 1
                n = int(words.first[-1]) // 2 + 1
                squares = np.bincount(row, latent.idf[term] ** 2, n)
                y = spread(row, weighted[term], n) / np.maximum(squares, 1e-9)[:, None].astype(np.float32)
                order = np.argsort(term, kind="stable")
                total += spread(term[order], y[row[order]], len(total)) * latent.idf[:, None]
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(total[at, k]) for k in range(dims))], names=["term", *(f"d{k}" for k in range(dims))])

    return run


def term_weights(coded: DataFrame, terms: int, most_common: float = 0.02) -> np.ndarray:
    """Inverse document frequency of each term over all passages.

    Terms that occur more than ``most_common`` times a passage have no weight
    (unless all do).
    """
    n, blocks = np.zeros(terms + 1), 1.0
    for r in coded.select("codes").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            blocks = max(1.0, r["n"])
        else:
            n[r["term"]] = r["n"]
    idf = np.where(n <= most_common * max(50.0, blocks / 2), np.log((blocks / 2 + 1) / (n + 1)) + 1, 0.0)
    idf[0] = 0
    if not (idf > 0).any():
        idf = np.where(np.arange(terms + 1) > 0, 1.0, 0.0)
    return np.maximum(idf, 0)


def fit_latent(coded: DataFrame, idf: np.ndarray, items: list[np.ndarray], rank: int = RANK, more: int = MORE, rounds: int = 1, seed: int = 3) -> Latent:
    """A latent space by a randomised SVD of the passage-term matrix A.

    The items are passages of A too, with a weight beyond all others: the
    leading axes span them, and the rest are singular vectors of A beside
    these. So the cosine of a passage with an item is never less in the latent
    space than before, however rare the item is in the corpus. A random test
    matrix is multiplied by AᵀA ``rounds + 1`` times, each time as one sum over
    all passages by term, and made orthonormal on the driver; there everything
    has a row for each word of the items and ``rank + more`` numbers in it.
    """
    spark = coded.sparkSession
    terms = len(idf)
    own = np.zeros((terms, len(items)))
    for i, c in enumerate(items):
        np.add.at(own[:, i], c, idf[c])
    left, sizes, _ = np.linalg.svd(own, full_matrices=False)
    first = left[:, sizes > 1e-6 * max(1.0, sizes.max(initial=0))]
    beside = lambda x: x - first @ (first.T @ x)
    dims = min(rank + more, terms - first.shape[1])
    if dims <= 0:
        return Latent(idf, np.ascontiguousarray(first, np.float32))
    axes = np.linalg.qr(beside(np.random.default_rng(seed).normal(size=(terms, dims))))[0]
    before = image = axes
    for _ in range(rounds + 1):
        model = spark.sparkContext.broadcast(Latent(idf, axes.astype(np.float32)))
        kind = "term long, " + ", ".join(f"d{k} double" for k in range(dims))
        sums = coded.select("codes").mapInArrow(_range_step(model, dims), kind).groupBy("term").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(dims)))
        image = np.zeros_like(axes)
        for r in sums.collect():
            image[r["term"]] = r[1:]
        before, axes = axes, np.linalg.qr(beside(image) + 1e-9 * axes)[0]
    # Rayleigh-Ritz: (AᵀA) before = image, so beforeᵀ image is AᵀA seen from these axes.
    values, turn = np.linalg.eigh((before.T @ image + image.T @ before) / 2)
    rest = (before @ turn[:, np.argsort(-values)])[:, :rank]
    return Latent(idf, np.ascontiguousarray(np.hstack([first, rest]), np.float32))


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel; 0 matches nothing)."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        if x:
            where[x] = where.get(x, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for x in b.tolist():
        if x in where:
            hit = state & where[x]
            state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def answer_of(item: np.ndarray) -> np.ndarray:
    """The end of an item, where a question has its answer: a fifth of it, 5 words at least."""
    return item[-max(5, len(item) // 5) :]


def closest(item: np.ndarray, region: np.ndarray, least: int) -> tuple[int, np.ndarray]:
    """Longest common subsequence of an item with a stretch half as long again as the item, and the stretch.

    Scattered words of a long region so don't add up to an item. Nothing is
    looked at closely if the whole region has less than ``least`` in common.
    """
    width, step = len(item) + max(1, len(item) // 2), max(1, len(item) // 4)
    best, where = 0, region[:0]
    if lcs(item, region) >= least:
        for at in range(0, max(1, len(region) - width + step), step):
            part = region[at : at + width]
            common = lcs(item, part)
            if common > best:
                best, where = common, part
    return best, where


@dataclass
class Benchmark:
    ids: list[int]
    codes: list[np.ndarray]
    points: np.ndarray  # unit vectors of the items in the latent space
    runs: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted keys of the items' word runs, item of each


def unit(points: np.ndarray) -> np.ndarray:
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)


def locate_items(latent: Latent, codes: list[np.ndarray]) -> np.ndarray:
    weighted = latent.axes * latent.idf[:, None].astype(np.float32)
    return unit(np.stack([weighted[c].sum(axis=0) for c in codes]))


def run_keys(codes: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` words, by its first word."""
    n = max(0, len(codes) - length + 1)
    key = np.zeros(n, np.uint64)
    for k in range(length):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64)
    return key


def runs_of(codes: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Runs of ``RUN`` words of each item (of all its words if it has fewer)."""
    out = {}
    for length in {min(RUN, len(c)) for c in codes}:
        own = [(i, np.unique(run_keys(c, length))) for i, c in enumerate(codes) if min(RUN, len(c)) == length]
        keys, of = np.concatenate([k for _, k in own]), np.repeat([i for i, _ in own], [len(k) for _, k in own])
        order = np.argsort(keys, kind="stable")
        out[length] = keys[order], of[order]
    return out


def with_runs(words: Words, items: Benchmark) -> list[np.ndarray]:
    """For each item the blocks in which a run of its words begins, whatever its words weigh."""
    which, blocks = [np.zeros(0, int)], [np.zeros(0, int)]
    for length, (keys, of) in items.runs.items():
        own = run_keys(words.flat, length)
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own)
        doc = lambda x: np.searchsorted(words.first, words.block[x], "right")
        at = at[doc(at) == doc(at + length - 1)]
        low, high = np.searchsorted(keys, own[at]), np.searchsorted(keys, own[at], "right")
        many = high - low
        which.append(of[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())])
        blocks.append(np.repeat(words.block[at], many))
    n = int(words.first[-1]) + 1
    pairs = np.unique(np.concatenate(which) * n + np.concatenate(blocks))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, len(items.codes))))


def _candidates(points: np.ndarray, words: Words, latent: Latent, items: Benchmark, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first block and TF-IDF cosine of the passages that are near an item, in both spaces, or hold a run of its words.

    The latent space proposes; what it proposes is compared in the space of all
    terms, one item at a time, before anything is read word by word. Words that
    are common have no weight there, nor has a passage much of a long item; so
    passages with a run of an item's words are candidates too.
    """
    squares = latent.idf**2
    padded = np.concatenate([words.flat, np.zeros(2 * BLOCK, np.uint32)])
    n = int(words.first[-1])
    at = np.searchsorted(words.block, np.arange(n + 2))  # first word of each block
    last = np.repeat(words.first[1:], np.diff(words.first))  # of each block, the end of its document
    norm = np.add.reduceat(np.append(squares[words.flat], 0), np.minimum(at[:-1], len(words.flat))) * (np.diff(at) > 0)
    stop = at[np.minimum(np.arange(n) + 2, last)]
    weight = norm[:n] + np.where(np.arange(n) + 1 < last, norm[1 : n + 1], 0)
    own = np.zeros(len(squares))
    out = []
    which, found = np.nonzero((points @ items.points.T).T >= cosine)
    for i, (near, run) in enumerate(zip(np.split(found, np.searchsorted(which, np.arange(1, len(items.codes)))), with_runs(words, items))):
        near = np.union1d(near, run)
        if len(near):
            terms = np.unique(items.codes[i])
            own[terms] = squares[terms]
            place = at[near, None] + np.arange(2 * BLOCK)
            shared = (own[padded[place]] * (place < stop[near, None])).sum(axis=1)
            true = shared / np.maximum(np.sqrt(weight[near] * own[terms].sum()), 1e-9)
            own[terms] = 0
            keep = (true >= cosine) | np.isin(near, run)
            near, true = near[keep], true[keep]
            out.append((np.full(len(near), i), near, true))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _stretches(item: np.ndarray, block: np.ndarray, close: np.ndarray, words: Words) -> Iterator[tuple[int, int, int, int, float]]:
    """Document, item, first and last block, best cosine of each run of candidates."""
    if not len(item):
        return
    doc = np.searchsorted(words.first, block, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] > block[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(item)]]) - 1
    best = np.maximum.reduceat(close, new)
    yield from zip(doc[new].tolist(), item[new].tolist(), (block[new] - words.first[doc[new]]).tolist(), (block[last] - words.first[doc[last]]).tolist(), best.tolist())


def _search(model, bench, cosine: float, sure: float, likely: float, answer: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, items = model.value, bench.value
        weighted = latent.axes * latent.idf[:, None].astype(np.float32)
        terms = [set(c.tolist()) for c in items.codes]
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            done = 0
            for some, words in _parts(batch):
                block, term = latent.entries(words)
                n = int(words.first[-1])
                single = spread(block, weighted[term], n)
                single[:-1] += np.where(np.isin(np.arange(1, n), words.first), 0, 1)[:, None] * single[1:]
                found = _candidates(unit(single), words, latent, items, cosine)
                for doc, item, start, last, close in _stretches(*found, words):
                    size = len(items.codes[item])
                    region = words.codes[doc][max(0, start * BLOCK - size) : (last + 2) * BLOCK + size]
                    # No common subsequence is longer than the words that the item has.
                    if sum(map(terms[item].__contains__, region.tolist())) < likely * size:
                        continue
                    common, region = closest(items.codes[item], region, int(np.ceil(likely * size)))
                    share = common / size
                    if share >= likely and share > best.get((done + doc, item), (0, 0))[1]:
                        end = answer_of(items.codes[item])
                        right = lcs(end, region) / len(end)
                        if share >= sure or right >= answer:
                            best[done + doc, item] = (start * BLOCK, share, close, right)
                done += some.num_rows
            if best:
                of, item = map(list, zip(*best))
                c = [*zip(*best.values())]
                same = [batch.column(k).take(pa.array(of)) for k in ("doc_id", "file", "row")]
                rest = [pa.array([items.ids[i] for i in item], pa.int64()), pa.array(c[0], pa.int32()), pa.array(c[2], pa.float64()), pa.array(c[1], pa.float64()), pa.array(c[3], pa.float64())]
                yield pa.RecordBatch.from_arrays([*same, *rest], names=["doc_id", "file", "row", "item_id", "passage_start", "cosine", "lcs_share", "answer_share"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, sure: float = 0.75, likely: float = 0.6, answer: float = 0.8, rank: int = RANK) -> DataFrame:
    """Benchmark items that whole documents hold, word for word or paraphrased.

    Reads ``doc_id`` and ``text`` of ``docs``, ``item_id`` and ``text`` of
    ``benchmark``; other columns are left out. Words are runs of letters and
    digits in lower case. Overlapping passages of two blocks of ``BLOCK`` words of every document are placed in
    a latent space; those with a cosine of ``cosine`` or more to an item, and those with ``RUN`` of its words in a row, are candidates. An item is found where its longest common
    subsequence with a stretch of words at a candidate, half as long again, is ``sure`` of its words or
    more, or ``likely`` with ``answer`` of its answer's words in order. Items
    are the query set, searched in blocks of ``ITEM_BLOCK`` against all rows.
    Null or empty texts and items hold nothing. Rows that repeat are searched
    each; repeated items are found each; empty tables give no rows.

    Returns a row for each row and item found: doc_id, file, row (locator),
    item_id, passage_start (in words), cosine, lcs_share, answer_share.
    """
    spark = docs.sparkSession
    rows = located(docs.select("doc_id", "text"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("at.file").alias("file"), F.col("at.row").alias("row"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    found = spark.createDataFrame([], FOUND)
    block: list[tuple[int, str]] = []
    for item in [*items.toLocalIterator(), None]:
        if item is not None:
            block.append((item["item_id"], item["text"]))
        if block and (item is None or len(block) == ITEM_BLOCK):
            found = found.unionByName(_found_in_block(rows, block, cosine, sure, likely, answer, rank))
            block = []
    return found


def _found_in_block(rows: DataFrame, block: list[tuple[int, str]], cosine: float, sure: float, likely: float, answer: float, rank: int) -> DataFrame:
    share = rows.sparkSession.sparkContext.broadcast
    vocabulary = np.unique(word_hashes([t.lower() for _, t in block], NOT_ALNUM)[0])
    codes = word_codes([t for _, t in block], vocabulary)
    own = [(i, c) for (i, _), c in zip(block, codes) if len(c)]
    coded = saved(rows.mapInArrow(_coded(share(vocabulary)), "doc_id long, file long, row long, codes binary"), "coded-words")
    if not own:
        return rows.sparkSession.createDataFrame([], FOUND)
    latent = fit_latent(coded, term_weights(coded, len(vocabulary)), [c for _, c in own], rank)
    bench = Benchmark([i for i, _ in own], [c for _, c in own], locate_items(latent, [c for _, c in own]), runs_of([c for _, c in own]))
    return saved(coded.mapInArrow(_search(share(latent), share(bench), cosine, sure, likely, answer), FOUND), "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found."""
    docs = scan_of(docs)
    gone = find_leaks(docs, benchmark).select(F.col("file").alias("gone_file"), F.col("row").alias("gone_row")).distinct()
    rows = located(docs.select(F.struct("*").alias("doc")))
    return rows.join(gone, (F.xxhash64("at.file") == F.col("gone_file")) & (F.col("at.row") == F.col("gone_row")), "left_anti").select("doc.*")
