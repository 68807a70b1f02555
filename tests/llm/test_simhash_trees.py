"""SimHash groups against plain fingerprints and all pairs."""

import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from labelassay.llm import simhash_trees as S
from labelassay.llm.components import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, radius=3):
    """The first index of each one's group."""
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [top(i) for i in range(len(fps))]


def clouds(dice, centres, around, bits):
    out = set()
    for _ in range(centres):
        c = dice.getrandbits(64)
        for _ in range(around):
            x = c
            for b in dice.sample(range(64), dice.randint(0, bits)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_fingerprints(spark, with_null_id, monkeypatch):
    got = sorted((repr(r["doc_id"]), f"{r['fp'] & (2**64 - 1):016x}") for r in S.fingerprints(with_null_id).collect())
    assert got == sorted((repr(r["doc_id"]), f"{plain_fingerprint(r['text']):016x}") for r in with_null_id.collect())
    monkeypatch.setattr(S, "PIECE", 7)  # pieces end within shingles, and words are longer than a piece
    for text in ("a bb", "one two three four five six seven", "w" * 40 + " x  y\tz " + "v" * 30, " lead and trail ", "Á b c d E"):
        assert S.simhashes([text.encode()]).view("uint64")[0] == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_trees(radius):
    dice = random.Random(radius)
    for fps in (clouds(dice, 6, 9, 5), clouds(dice, 3, 2, 4), [5], clouds(dice, 1, 300, 2), [dice.getrandbits(64) for _ in range(200)]):
        dice.shuffle(fps)
        tree = S.built(fps)
        for q in fps[:20]:
            assert sorted(tree.search(q, radius)) == [i for i, x in enumerate(fps) if (x ^ q).bit_count() <= radius]
        assert S.groups_in(fps, radius) == plain_groups(fps, radius)


@pytest.mark.parametrize("agree", [1, 2, 3])
@pytest.mark.parametrize("broadcast", [True, False])
def test_links_connect_every_pair(spark, agree, broadcast):
    """Crowded buckets (a dense cloud in trees of ten) and each plan of keys."""
    dice = random.Random(agree)
    fps = sorted({*clouds(dice, 1, 150, 3), *clouds(dice, 30, 4, 4), *(dice.getrandbits(64) for _ in range(100)), 0})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x), 1000 + i) for i, x in enumerate(fps)], "fp long, first long").repartition(3)
    plan = S.key_plan([1, 1 << 28, 1 << 40][agree - 1])
    assert len(plan[0]) == agree
    edges = S.links(nodes, len(fps), tree_size=10, broadcast_bytes=1 << 20 if broadcast else 0, plan=plan)
    found = {r["node"]["first"] - 1000: r["component"]["first"] - 1000 for r in components(edges).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == plain_groups(fps)
    for r in edges.collect():
        assert 0 < sum((r["a"]["fp"] ^ r["b"]["fp"]) >> b & 1 for b in range(64))


def test_groups_of_documents(spark, with_null_id, empty):
    rows = [(r["doc_id"], r["text"]) for r in with_null_id.collect()]
    dice = random.Random(3)
    base = [f"w{dice.randrange(300)}" for _ in range(800)]
    for k in range(12):  # long texts that differ in a word
        own = base.copy()
        own[dice.randrange(800)] = "other"
        rows.append((500 + k if k else None, " ".join(own)))
    rows.append((None, "alone with no identifier at all"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("first", F.lit(2)).repartition(4)
    got = S.simhash_groups(docs)
    fps = [plain_fingerprint(t) for _, t in rows]
    tops = plain_groups(fps)
    least = {}
    for (doc_id, _), t in zip(rows, tops):
        if doc_id is not None:
            least[t] = min(least.get(t, doc_id), doc_id)
    want = [(d, f"{fp:016x}", least.get(t)) for (d, _), fp, t in zip(rows, fps, tops)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({t for t in tops[-13:-1]}) < 12  # some are linked
    assert S.simhash_groups(empty).collect() == []
