"""Near copies by SimHash: fingerprints within a few bits, found in BK-trees.

Fingerprints are dealt into buckets of those that agree on some blocks of bits,
so that any pair within the radius shares a bucket (pigeonhole). Each bucket is a
BK-tree, whose children are keyed by their integer Hamming distance to the parent and whose
searches follow only edges within the radius of the distance found. A crowded
bucket is sharded into several trees; these are broadcast if they are small
together, else sent to the tasks that search them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, at_all_salts, by_size, done_with, hot_keys, salted, saved
from .components import components

BITS, RADIUS = 64, 3
TREE = 4096  # fingerprints of a tree
BROADCAST_BYTES = 32 << 20  # of all trees of crowded buckets; beyond that they are shuffled
BUCKET = 16  # mean size of a bucket, above which keys take more blocks
NO_ID = (1 << 63) - 1  # stands for a null doc_id: after all others

PIECE = 1 << 20
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WHITE = re.compile(rb"[\x20\x09-\x0d]")

# ---- fingerprints --------------------------------------------------------------------


def word_pieces(low: bytes, shingle: int) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; each piece begins with the last words of the one before, ``shingle - 1`` at most."""
    at, carry = 0, []
    while at < len(low):
        end = at + PIECE
        if end < len(low):
            white = _WHITE.search(low, end)
            end = white.start() if white else len(low)
        words = carry + low[at:end].split()  # bytes are split at the six white-space bytes
        yield words
        carry = words[-(shingle - 1) :] if shingle > 1 else []
        at = end


def shingle_hashes(raw: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included, in arrays; of a text with fewer words that of all its words."""
    from xxhash import xxh64_intdigest

    words, any_shingle = [], False
    for words in word_pieces(raw.translate(_TO_LOWER), shingle):
        if len(words) < shingle:
            continue
        any_shingle = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    if words and not any_shingle:
        yield np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def simhashes(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """A bit is set if it is in over half of a text's hashes; without words the fingerprint is zero (int64)."""
    out = np.zeros(len(texts), np.uint64)
    held, owners, size = [], [], 0
    votes, counts = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)

    def count() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lengths = np.array([len(h) for h in held])
            sums = np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int64)
            np.add.at(votes, owners, sums)
            np.add.at(counts, owners, lengths)
            held.clear()
            owners.clear()

    for i, raw in enumerate(texts):
        for hashes in shingle_hashes(raw, shingle, seed):
            held.append(hashes)
            owners.append(i)
            size += len(hashes)
            if size >= 1 << 17:
                count()
                size = 0
    count()
    set_bits = (2 * votes > counts[:, None]).astype(np.uint8)
    out = np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0] if len(texts) else out
    return out.astype(np.uint64).view(np.int64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in by_size(batch, "text", PIECE):
            raw = [b"" if t is None else t for t in some.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(simhashes(raw))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (a long) of every row; the text's bytes go to Python, whole."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


# ---- buckets -----------------------------------------------------------------------------


def key_plan(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For each key the blocks (shift, bits) that it takes of a fingerprint.

    Of ``radius + k`` blocks, two fingerprints within the radius agree on k.
    More blocks give longer keys and more of them; whichever are taken, each
    pair within the radius shares a key, so the choice changes no result.
    """
    for agree in (1, 2, 3):
        blocks = radius + agree
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        own = [(a, b - a) for a, b in zip(edges, edges[1:])]
        plan = [list(c) for c in combinations(own, agree)]
        if n <= BUCKET << min(sum(bits for _, bits in c) for c in plan):
            break
    return plan


def keys_of(fp: Column, plan: list[list[tuple[int, int]]]) -> Column:
    """An array of all keys: the number of the plan's entry above the blocks' bits (40 at most)."""
    out = []
    for number, blocks in enumerate(plan):
        key, at = F.lit(number << 40), 0
        for shift, bits in blocks:
            key = key + F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1)), at)
            at += bits
        out.append(key.cast("long"))
    return F.array(*out)


# ---- trees -------------------------------------------------------------------------------


class BKTree:
    """Fingerprints in the order of insertion; ``children[i]`` maps a distance to the child at that distance from node i."""

    def __init__(self) -> None:
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, fp: int) -> None:
        if self.fps:
            at = 0
            while True:
                d = (self.fps[at] ^ fp).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = len(self.fps)
                    break
                at = below
        self.fps.append(fp)
        self.children.append({})

    def search(self, fp: int, radius: int) -> list[int]:
        """Nodes within the radius of one fingerprint."""
        found, open_nodes = [], [0] if self.fps else []
        while open_nodes:
            at = open_nodes.pop()
            d = (self.fps[at] ^ fp).bit_count()
            if d <= radius:
                found.append(at)
            # Below an edge of e all are e from this node, so those near fp have e within the radius of d.
            open_nodes += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found

    def search_all(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of many fingerprints (uint64) those near a node, node by node; a subtree gets only the fingerprints whose search enters it."""
        open_nodes = [(0, np.arange(len(fps)))] if self.fps else []
        while open_nodes:
            at, active = open_nodes.pop()
            d = np.bitwise_count(fps[active] ^ np.uint64(self.fps[at])).astype(np.int64)
            if (near := d <= radius).any():
                yield at, active[near]
            for e, child in self.children[at].items():
                if len(own := active[np.abs(d - e) <= radius]):
                    open_nodes.append((child, own))


def built(fps: list[int]) -> BKTree:
    tree = BKTree()
    for fp in fps:
        tree.insert(fp)
    return tree


def groups_in(fps: list[int], radius: int) -> list[int]:
    """For each fingerprint of a tree the first one of those that it is linked with inside the tree."""
    label = np.arange(len(fps))

    def join(nodes: np.ndarray) -> None:
        own = np.unique(label[nodes])
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]

    if len(fps) <= 32:
        tree = BKTree()
        for i, fp in enumerate(fps):
            if found := tree.search(fp, radius):
                join(np.array([i, *found]))
            tree.insert(fp)
    else:
        for at, near in built(fps).search_all(np.array(fps, np.uint64), radius):
            join(np.append(near, at))
    return label.tolist()


EDGES = "a struct<first: long, fp: long>, b struct<first: long, fp: long>"
TREES = f"key long, tree int, trees int, {EDGES}, fps binary, firsts binary, groups binary"
_NODE = pa.struct([("first", pa.int64()), ("fp", pa.int64())])
_UNSIGNED = (1 << 64) - 1


def _trees_of(radius: int):
    def of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (key, tree): the links inside each tree, one fewer than it joins, and the trees of crowded buckets."""
        rest: list[np.ndarray] = []

        def close(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, tree, trees, fp, first = (np.concatenate(c) for c in zip(*parts))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (tree[1:] != tree[:-1])) + 1
            a, b, whole = [], [], []
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                if e - s == 1 and trees[s] == 1:
                    continue
                own = fp[s:e].view(np.uint64).tolist()
                groups = groups_in(own, radius)
                for i, g in enumerate(groups):
                    if g != i:
                        a.append(s + g)
                        b.append(s + i)
                if trees[s] > 1:
                    whole.append((key[s], tree[s], trees[s], fp[s:e].tobytes(), first[s:e].tobytes(), np.array(groups, np.int32).tobytes()))
            node = lambda at: pa.StructArray.from_arrays([pa.array(first[at]), pa.array(fp[at])], fields=list(_NODE))
            none = lambda n, t: pa.nulls(n, t)
            names = ["key", "tree", "trees", "a", "b", "fps", "firsts", "groups"]
            if a:
                yield pa.RecordBatch.from_arrays([none(len(a), pa.int64()), none(len(a), pa.int32()), none(len(a), pa.int32()), node(a), node(b), *(none(len(a), pa.binary()) for _ in range(3))], names=names)
            if whole:
                columns = [*zip(*whole)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), none(len(whole), _NODE), none(len(whole), _NODE), *(pa.array(c, pa.binary()) for c in columns[3:])], names=names)

        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tree", "trees", "fp", "first")]
            if not len(columns[0]):
                continue
            # The last tree may go on in the next batch.
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from close([*rest, tuple(c[:cut] for c in columns)])
                rest = []
            elif rest and (rest[-1][0][-1], rest[-1][1][-1]) != (columns[0][0], columns[1][0]):
                yield from close(rest)
                rest = []
            rest.append(tuple(c[cut:] for c in columns))
        if rest:
            yield from close(rest)

    return of_sorted


def _across(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One tree's fingerprints searched in another tree of the bucket: a link for each pair of their groups at most."""
        for batch in batches:
            a, b = [], []
            for r in range(batch.num_rows):
                x = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                fps, of = np.frombuffer(x["fps"], np.uint64), np.frombuffer(x["groups"], np.int32)
                others, of_others = np.frombuffer(x["of_fps"], np.uint64), np.frombuffer(x["of_groups"], np.int32)
                linked: set[tuple[int, int]] = set()
                for at, near in built(others.tolist()).search_all(fps, radius):
                    linked.update((g, int(of_others[at])) for g in np.unique(of[near]).tolist())
                firsts, firsts_of = np.frombuffer(x["firsts"], np.int64), np.frombuffer(x["of_firsts"], np.int64)
                a += [{"first": int(firsts[g]), "fp": int(fps.view(np.int64)[g])} for g, _ in linked]
                b += [{"first": int(firsts_of[h]), "fp": int(others.view(np.int64)[h])} for _, h in linked]
            yield pa.RecordBatch.from_arrays([pa.array(a, _NODE), pa.array(b, _NODE)], names=["a", "b"])

    return search


def links(nodes: DataFrame, n: int, radius: int = RADIUS, tree_size: int = TREE, broadcast_bytes: int = BROADCAST_BYTES, plan: list[list[tuple[int, int]]] | None = None) -> DataFrame:
    """Links that connect what is within the radius; ``nodes`` has distinct ``fp`` and ``first``, ``n`` of them.

    Not every pair is a link, but each pair is connected: inside a tree all go
    to the first of their group, and between two trees a pair of groups is linked once.
    """
    keyed = nodes.select("first", "fp", F.explode(keys_of(F.col("fp"), plan or key_plan(n, radius))).alias("key"))
    crowded = keyed.groupBy("key").count().where(F.col("count") > tree_size).select("key", F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    trees = F.coalesce("trees", F.lit(1))
    dealt = keyed.join(saved(crowded, "crowded-keys"), "key", "left").select("key", F.pmod(F.xxhash64("fp"), trees).cast("int").alias("tree"), trees.alias("trees"), "fp", "first")
    made = saved(dealt.repartition("key", "tree").sortWithinPartitions("key", "tree").mapInArrow(_trees_of(radius), TREES), "bk-trees")
    inside = made.where("a IS NOT NULL").select("a", "b")
    whole = made.where("fps IS NOT NULL").select("key", "tree", "trees", "fps", "firsts", "groups")
    size = whole.agg(F.coalesce(F.sum(F.octet_length("fps") + F.octet_length("firsts") + F.octet_length("groups")), F.lit(0))).first()[0]
    if not size:
        return inside
    others = whole.select("key", F.col("tree").alias("of_tree"), *(F.col(c).alias(f"of_{c}") for c in ("fps", "firsts", "groups")))
    if size <= broadcast_bytes:
        pairs = whole.join(F.broadcast(others), (whole["key"] == others["key"]) & (F.col("tree") < F.col("of_tree"))).drop(others["key"])
    else:
        # A copy of each tree for every other tree of its bucket, so that no task holds a crowded bucket.
        left = whole.where("tree < trees - 1").withColumn("of_tree", F.explode(F.sequence(F.col("tree") + 1, F.col("trees") - 1)))
        right = others.where("of_tree > 0").withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("of_tree") - 1)))
        pairs = left.join(right, ["key", "tree", "of_tree"])
    return inside.unionByName(pairs.select("fps", "firsts", "groups", "of_fps", "of_firsts", "of_groups").mapInArrow(_across(radius), EDGES))


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Reads ``doc_id`` and ``text``; other columns are left out. Words are runs
    without ASCII white space, A-Z lower-cased; shingles are three words, and a
    shorter text is one. A null text counts as empty; texts without words have
    fingerprint zero and are linked like any others. Fingerprints with at most
    ``radius`` differing bits are linked; component_id is the smallest doc_id
    that is reachable. A row of a null doc_id links others, gets their
    component_id, and null if it reaches no doc_id. Repeated rows are returned
    each; an empty table gives no rows.
    """
    rows = saved(fingerprints(docs), "fingerprints")
    groups = saved(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"), F.count("*").alias("n")), "fingerprint-groups")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    edges = saved(links(groups.select("fp", "first"), n, radius), "links")
    linked = components(edges).select(F.col("node.fp").alias("fp"), F.col("component.first").alias("least"))
    labels = saved(groups.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "fingerprint-labels")
    hot = saved(hot_keys(groups.select("fp", "n"), total), "hot-fingerprints")
    out = salted(rows, hot, "fp", "doc_id").join(at_all_salts(labels, hot, "fp"), ["fp", "salt"])
    done_with(edges)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))
