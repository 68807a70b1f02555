"""The best reference of many for each reading, without a row for each pair.

References are packed into blocks, readings into small chunks, and each chunk
meets each block in one task. There a pair's result is bounded field by field
(a ratio by letters in common); only what the bounds leave is compared, best
bound first, until no bound reaches what was found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REFERENCE_FIELDS, Thresholds
from ..functions.similarity import letter_counts, ratio_of, ratios, sorted_tokens
from ..functions.text import abv_percent, is_blank, normalize_text, producer_keywords, state_of, volume_ml
from ..storage import drop_table, kept_table

BLOCK, CHUNK = 16_384, 64  # references of a block, readings of a chunk
BROADCAST_BYTES = 64 << 20  # of all blocks; beyond that they are shuffled
MATCHED = 1000.0  # a matched field weighs more than all scores together
SLACK = 1e-6  # bounds add in another order than scores

MEASURES = {"alcohol_content": abv_percent, "net_contents": volume_ml}
PACKED = "part int, rows binary"
FOUND = "kind long, matched int, score double, place_key string, place_id long"


def _described(field: str, value: Column) -> list[Column]:
    """What comparisons read of a value: its sorted words, whether it is blank, its measure, its state and words."""
    number = MEASURES[field](value) if field in MEASURES else F.lit(None)
    producer = field == "producer_info"
    return [
        sorted_tokens(normalize_text(value)).alias(f"{field}_text"),
        is_blank(value).alias(f"{field}_blank"),
        number.cast("double").alias(f"{field}_number"),
        (state_of(value) if producer else F.lit(None).cast("string")).alias(f"{field}_state"),
        (F.array_sort(producer_keywords(value)) if producer else F.lit(None).cast("array<string>")).alias(f"{field}_words"),
    ]


def _pack(table: pa.Table) -> pa.Table:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    part = table.column("part")[0].as_py() if table.num_rows else 0
    return pa.table({"part": pa.array([part], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _packed(rows: DataFrame, n: int, size: int, by: str) -> tuple[DataFrame, int]:
    parts = max(1, -(-n // size))
    part = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")
    return rows.withColumn("part", part).groupBy("part").applyInArrow(_pack, PACKED), parts


class Values:
    """A field's distinct values in a block or chunk; ``codes`` has each row's."""

    def __init__(self, table: pa.Table, field: str) -> None:
        columns = [table.column(f"{field}_{k}").to_pylist() for k in ("text", "blank", "number", "state", "words")]
        known: dict[tuple, int] = {}
        rows = [(t, b, n, s, None if w is None else tuple(w)) for t, b, n, s, w in zip(*columns)]
        self.codes = np.array([known.setdefault(r, len(known)) for r in rows], np.int64)
        self.text, self.blank, self.number, self.state, self.words = ([*x] for x in zip(*known))
        self.blank = np.array(self.blank, bool)
        self.number = np.array([np.nan if n is None else n for n in self.number])
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        self.letters = letter_counts(self.text)
        order = np.argsort(self.codes, kind="stable")
        ends = np.cumsum(np.bincount(self.codes, minlength=len(known)))
        self.rows = np.split(order, ends[:-1])  # rows of each value
        self.sizes = np.diff(ends, prepend=0)


class Field:
    """Comparisons of one reading's value with all values of a block: bounds at once, results when they are asked for."""

    def __init__(self, field: str, x: Values, k: int, e: Values, limits: Thresholds) -> None:
        self.x, self.k, self.e = x, k, e
        n = len(e.text)
        self.match, self.score, self.open = np.zeros(n, bool), np.zeros(n), np.zeros(n, bool)
        measure = field in MEASURES
        self.least = limits.fallback if measure else limits.text
        self.producer = field == "producer_info"
        if x.blank[k]:
            self.match = np.zeros(n, bool) if measure else e.blank.copy()
        else:
            self.match[e.blank] = True
            self.open = ~e.blank
        if measure and not x.blank[k]:
            gap = np.abs(x.number[k] - e.number)
            if field == "alcohol_content":
                ok, score = gap <= limits.abv_points, np.maximum(0.0, 100.0 - gap * 10.0)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap = np.where(e.number == 0, np.where(np.isnan(gap), np.nan, 100.0), gap / e.number * 100.0)
                ok, score = gap <= limits.volume_percent, np.maximum(0.0, 100.0 - gap)
            both = self.open & ~np.isnan(gap)
            self.match[both], self.score[both] = ok[both], score[both]
            self.open &= ~both
        at = np.flatnonzero(self.open)
        common = np.minimum(x.letters[k], e.letters[at]).sum(1)
        self.score[at] = ratio_of(common, x.lengths[k] + e.lengths[at])
        self.match[at] = self.score[at] >= self.least
        if self.producer:
            self.match[at] |= np.array([e.state[i] is not None and e.state[i] == x.state[k] for i in at.tolist()], bool)
        self.bound = MATCHED * self.match + self.score

    def settle(self, codes: np.ndarray) -> None:
        """Work out what is still only bounded of these values."""
        at = np.unique(codes[self.open[codes]])
        if not len(at):
            return
        own = at.tolist()
        self.score[at] = ratios([self.x.text[self.k]] * len(own), [self.e.text[i] for i in own])
        self.match[at] = self.score[at] >= self.least
        if self.producer:
            for i in own:
                self.match[i] |= same_producer(self.x.state[self.k], self.x.words[self.k], self.e.state[i], self.e.words[i])
        self.open[at] = False


def same_producer(state_a: str | None, a: tuple, state_b: str | None, b: tuple) -> bool:
    """Same state, and enough words in common (as the columns' ``producer_broad_match``)."""
    if state_a is None or state_a != state_b:
        return False
    fewer = min(len(a), len(b))
    return fewer >= 2 and len({*a} & {*b}) >= min(3, fewer)


def best_in_block(kind: int, xs: dict[str, Values], es: dict[str, Values], limits: Thresholds) -> tuple[int, float, int]:
    """Matched fields, sum of scores and place of the best row of a block for one reading; equal ones: the first row."""
    fields = [Field(f, xs[f], int(xs[f].codes[kind]), es[f], limits) for f in REFERENCE_FIELDS]
    codes = [es[f].codes for f in REFERENCE_FIELDS]
    best = (-1, -1.0, 0)

    def compare(rows: np.ndarray) -> None:
        nonlocal best
        matched, score = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for f, c in zip(fields, codes):
            f.settle(c[rows])
            matched += f.match[c[rows]]
            score += f.score[c[rows]]
        top = np.lexsort((rows, -score, -matched))[0]
        found = (int(matched[top]), float(score[top]), int(rows[top]))
        best = max(best, found, key=lambda b: (b[0], b[1], -b[2]))

    most = [f.bound.max() for f in fields]
    compare(np.unique(np.concatenate([es[name].rows[int(np.argmax(f.bound))][:8] for name, f in zip(REFERENCE_FIELDS, fields)])))
    # A better row needs in every field a value whose bound, with the best of all others, reaches what was found.
    reached = MATCHED * best[0] + best[1] - SLACK
    wanted = [np.flatnonzero(f.bound + (sum(most) - m) >= reached) for f, m in zip(fields, most)]
    narrowest = min(range(len(fields)), key=lambda k: es[REFERENCE_FIELDS[k]].sizes[wanted[k]].sum())
    lists = es[REFERENCE_FIELDS[narrowest]].rows
    rows = np.concatenate([lists[i] for i in wanted[narrowest].tolist()] or [np.zeros(0, np.int64)])
    bound = sum(f.bound[c[rows]] for f, c in zip(fields, codes))
    rows, bound = rows[bound >= reached], bound[bound >= reached]
    order = np.argsort(-bound, kind="stable")
    at, size = 0, 64
    while at < len(order):
        some = order[at : at + size]
        some = some[bound[some] >= MATCHED * best[0] + best[1] - SLACK]
        if not len(some):
            break
        compare(rows[some])
        at, size = at + size, 2 * size
    return best


def _best_of(limits: Thresholds) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def unpack(raw: bytes) -> pa.Table:
        return pa.ipc.open_stream(raw).read_all()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, pa.Table, dict[str, Values]] | None = None
        for batch in batches:
            for readings, block in zip(batch.column("readings").to_pylist(), batch.column("rows").to_pylist()):
                if held is None or held[0] != block:
                    table = unpack(block)
                    keys, ids = table.column("place_key").to_pylist(), table.column("place_id").to_pylist()
                    order = sorted(range(len(ids)), key=lambda i: (keys[i] is not None, keys[i] or "", ids[i]))
                    table = table.take(order)
                    held = (block, table, {f: Values(table, f) for f in REFERENCE_FIELDS})
                _, table, es = held
                kinds = unpack(readings)
                xs = {f: Values(kinds, f) for f in REFERENCE_FIELDS}
                found = [best_in_block(k, xs, es, limits) for k in range(kinds.num_rows)]
                matched, score, row = (list(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [kinds.column("kind").combine_chunks(), pa.array(matched, pa.int32()), pa.array(score, pa.float64()), table.column("place_key").take(row).combine_chunks(), table.column("place_id").take(row).combine_chunks()],
                    names=["kind", "matched", "score", "place_key", "place_id"],
                )

    return best


def best_of_kinds(kinds: DataFrame, candidates: DataFrame, limits: Thresholds, block: int = BLOCK, chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``FOUND``: for each kind (kind, ``x_<field>``) its best candidate (``e_<field>``, place) of every block.

    ``candidates`` are written once, packed; a block goes to all tasks if all
    blocks together are small, else a copy to each group of sixteen chunks.
    """
    parts, chunks = candidates.count(), kinds.count()
    reduced = candidates.select(F.col("place.key").alias("place_key"), F.col("place.id").cast("long").alias("place_id"), *(c for f in REFERENCE_FIELDS for c in _described(f, F.col(f"e_{f}"))))
    packed, n_blocks = _packed(reduced, parts, block, "place_id")
    blocks = kept_table(packed, "reference-blocks")
    asked, n_chunks = _packed(kinds.select("kind", *(c for f in REFERENCE_FIELDS for c in _described(f, F.col(f"x_{f}")))), chunks, chunk, "kind")
    asked = asked.select(F.col("part").alias("chunk"), F.col("rows").alias("readings"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("part"))
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("rows")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        met = asked.repartition(n_chunks * n_blocks, "part", "chunk").join(F.broadcast(blocks), "part")
    else:
        groups = F.sequence(F.lit(0), F.lit((n_chunks - 1) // 16))
        copies = blocks.withColumn("sixteen", F.explode(groups))
        met = asked.withColumn("sixteen", F.floor(F.col("chunk") / 16).cast("int")).join(copies, ["part", "sixteen"])
    found = kept_table(met.select("readings", "rows").mapInArrow(_best_of(limits), FOUND), "best-of-blocks")
    drop_table(blocks)
    return found
