import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelassay.llm.common import BLOOM_CHUNK, bloom_bits, bloom_has
from labelassay.llm.line_dedup import DISTANCE, GROUP_REACH, MORE_BLOCKS, REACH, _lines, distinct_words, edit_distance, group_keys, line_dedup, normalise, similar, simhashes
from labelassay.llm.ngram_join import _BITS, SKETCH, _across, needed, ngram_join, parities, prefix
from labelassay.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def joined(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, joined(sets, links)


def test_ngram_join(docs):
    rows = docs.select("doc_id", "text").collect()
    sets, component = brute(rows)
    got = ngram_join(docs).collect()
    assert len(got) == len(rows)
    assert len({(a, b) for a, b in component.items() if a != b}) >= 10
    for g in got:
        assert (g["n_shingles"], g["component_id"]) == (len(sets[g["doc_id"]]), component[g["doc_id"]])


def test_ngram_join_of_a_large_group_and_a_chain(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # near copies of one text, and of one another
        own = base.copy()
        own[i % 60] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(40):  # a chain: each links with its neighbours only
        rows.append((1000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 50))))
    rows += [(2000 + i, " ".join(base[:25]) + f" u{i} v{i} " + " ".join(f"z{i}{k}" for k in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, component = brute(df.collect())
    for rounds in (1, 3):
        got = {g["doc_id"]: g["component_id"] for g in ngram_join(df, star_rounds=rounds).collect()}
        assert got == component


def test_ngram_join_without_rows_or_ids(spark, empty):
    assert ngram_join(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (None, None), (6, "")], "doc_id long, text string")
    got = {(g["doc_id"], g["n_shingles"]): g["component_id"] for g in ngram_join(df).collect()}
    assert got == {(None, 3): 4, (4, 3): 4, (None, 0): 4, (6, 0): 6}


def test_shingle_sets_match_plain_sets(texts):
    plain = [shingles(t) for t in texts]
    hashed = [set(s.tolist()) for s in shingle_sets([t or "" for t in texts])]
    for i, j in combinations(range(len(texts)), 2):
        assert len(plain[i] & plain[j]) == len(hashed[i] & hashed[j])
    assert [len(s) for s in plain] == [len(s) for s in hashed]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 20), st.integers(0, 20), st.randoms(use_true_random=False))
def test_linked_sets_share_enough_of_their_prefixes(both, only_a, only_b, dice):
    tokens = np.array([dice.getrandbits(64) for _ in range(both + only_a + only_b)], np.uint64)
    counts = np.ones(SKETCH, np.uint32)
    counts[(tokens & np.uint64(SKETCH - 1)).astype(int)] = [dice.choice([1, 3, 900]) for _ in tokens]
    a, b = np.sort(tokens[: both + only_a]), np.sort(np.concatenate([tokens[:both], tokens[both + only_a :]]))
    if 100 * both < 75 * len(tokens) or len(set(tokens.tolist())) < len(tokens):
        return
    pa_, _, ma = prefix(a, counts)
    pb_, _, mb = prefix(b, counts)
    assert len(set(pa_.tolist()) & set(pb_.tolist())) >= min(ma, mb)
    met = len(set(pa_.tolist()) & set(pb_.tolist()))
    assert met >= -(-75 * (len(a) + len(b)) // 175) - max(needed(len(a)) - ma, needed(len(b)) - mb)
    assert len(pa_) == len(a) - needed(len(a)) + ma


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé", max_size=12), st.text(alphabet="abcé", max_size=12))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == distance(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ", max_size=14), st.text(alphabet="ab ", max_size=14))
def test_similar_is_the_edit_similarity(a, b):
    assert similar(a, b, 0.75) == (distance(a, b) <= int(0.25 * max(len(a), len(b))))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1_- .\té\u00a0\u201c\u0130\n", max_size=14))
def test_normalise_is_the_plain_one(line):
    assert normalise(line) == re.sub(r"[\W_]+", " ", line.lower()).strip()


def test_simhash_counts_bits(word):
    lines = ["", "one", " ".join(word() for _ in range(40)), " ".join(f"w{i}" for i in range(700)), "two two two one"]
    from labelassay.llm.shingles import word_hashes

    for line, got in zip(lines, simhashes(lines)):
        own = sorted(set(word_hashes([line])[0].tolist()))
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
        assert int(got) == want


def meet(x, y, groups_x, groups_y):
    """Whether two SimHashes agree in a key's blocks and are within reach, or a group of words is the same and they are within its reach."""
    blocks = DISTANCE + MORE_BLOCKS
    if groups_x & groups_y and int(x ^ y).bit_count() <= GROUP_REACH:
        return True
    limits = [64 * i // blocks for i in range(blocks + 1)]
    diff = int(x ^ y)
    same = sum(not diff >> lo & ((1 << (hi - lo)) - 1) for lo, hi in zip(limits, limits[1:]))
    return same >= blocks - DISTANCE and diff.bit_count() <= REACH


def alike(a, b):
    most = int(0.25 * max(len(a), len(b)))
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


@pytest.mark.parametrize("few", [32, 1])
def test_line_dedup(spark, word, few, monkeypatch):
    import random

    monkeypatch.setattr("labelassay.llm.line_dedup.FEW", few)

    dice = random.Random(2)
    lines = [" ".join(word(dice) for _ in range(dice.randint(12, 25))) for _ in range(12)]
    texts = []
    for i in range(40):
        own = [dice.choice(lines) for _ in range(4)]
        k = dice.randrange(4)
        cut = own[k].split(" ")
        cut[dice.randrange(len(cut))] += dice.choice(["x", "ba"])
        own[k] = " ".join(cut)
        texts.append("\n".join([*own, "", "!!"]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(60, None), (61, ""), (62, "\n"), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as file", "3 as number").coalesce(1)
    got = line_dedup(df).collect()
    assert len(got) == len(rows)
    places = [(i, n, k, s) for n, (i, t) in enumerate(rows) for k, s in _lines(t or "")]
    forms = sorted({s for *_, s in places})
    hashes = simhashes(forms)
    keys, there = group_keys(len(forms), *distinct_words(forms))
    groups = [{*k[t].tolist()} for k, t in zip(keys, there)]
    links = [(a, b) for a, b in combinations(range(len(forms)), 2) if meet(hashes[a], hashes[b], groups[a], groups[b]) and alike(forms[a], forms[b])]
    assert links
    component = joined(range(len(forms)), links)
    at = {s: component[i] for i, s in enumerate(forms)}
    seen, dropped = set(), defaultdict(list)
    for i, n, k, s in sorted(places):
        if at[s] in seen:
            dropped[i].append(k)
        seen.add(at[s])
    found = defaultdict(list)
    for g in got:
        found[g["doc_id"]] += g["dropped"]
    assert {i: sorted(v) for i, v in found.items() if v} == {i: sorted(v) for i, v in dropped.items()}
    for g in got:
        if g["doc_id"] != 5:
            whole = (dict(rows)[g["doc_id"]] or "").split("\n")
            assert g["text"] == "\n".join(x for k, x in enumerate(whole) if k not in g["dropped"])
            assert g["n_lines"] == len(whole)


def test_line_dedup_of_no_rows(empty, with_null_id):
    assert line_dedup(empty).collect() == []
    assert line_dedup(with_null_id).count() == with_null_id.count()


def test_line_dedup_of_a_very_long_line(spark, word):
    long = " ".join(word() for _ in range(6000))
    rows = [(1, long + "\nshort one"), (2, long[:-9] + "x\nother text"), (3, long)]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: [], 2: [0], 3: [0]}


def test_share_of_alike_lines_found(spark, word):
    """Against all pairs by edit similarity alone: one word in 20 to 60 replaced."""
    import random

    dice = random.Random(8)
    rows, pairs = [], 120
    for i in range(pairs):
        own = [word(dice) for _ in range(dice.randint(20, 60))]
        rows.append((2 * i, " ".join(own)))
        own[dice.randrange(len(own))] = word(dice)
        rows.append((2 * i + 1, " ".join(own)))
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    found = sum(r["n_dropped"] for r in got if r["doc_id"] % 2)
    print("found", found, "of", pairs)
    assert found >= 0.97 * pairs
    assert not any(r["n_dropped"] for r in got if r["doc_id"] % 2 == 0)


def test_normalise_and_blocks():
    assert normalise("  The--QUICK, fox_1! ") == "the quick fox 1"
    assert normalise("--- !") == ""


def test_group_keys():
    """A changed word leaves the other groups' keys; groups of fewer than three words have none."""
    dice = random.Random(1)
    lines = ["", "a b c d", " ".join(f"w{dice.randrange(10**6)}" for _ in range(40))]
    own = lines[2].split(" ")
    own[7] = "changed"
    lines += [" ".join(own), " ".join(reversed(own))]
    keys, there = group_keys(len(lines), *distinct_words(lines))
    by = [{*k[t].tolist()} for k, t in zip(keys, there)]
    assert not by[0] and len(by[1]) <= 1 and len(by[2]) == 4 and by[3] == by[4] and 2 <= len(by[2] & by[3]) <= 3


def test_share_of_all_alike_pairs_found(spark, word):
    """Recall against all pairs of edit similarity 0.75 or more: lines of 8 to 60 words with one to four changes of a word (replaced, left out, put in)."""
    dice = random.Random(12)
    lines = []
    for i in range(150):
        own = [word(dice) + str(dice.randrange(40)) for _ in range(dice.randint(8, 60))]
        lines.append(own)
        new = own.copy()
        for _ in range(dice.randint(1, max(1, min(4, len(own) // 8)))):
            at = dice.randrange(len(new))
            new[at : at + dice.choice([0, 1, 1])] = [word(dice)] * dice.choice([0, 1, 1])
        lines.append(new)
    forms = [" ".join(x) for x in lines]
    alike_pairs = {(a, b) for a, b in combinations(range(len(forms)), 2) if similar(forms[a], forms[b], 0.75)}
    got = line_dedup(spark.createDataFrame([*enumerate(forms)], "doc_id long, text string").coalesce(1)).collect()
    dropped = {r["doc_id"] for r in got if r["n_dropped"]}
    found = sum(b in dropped for _, b in alike_pairs)
    print("found", found, "of", len(alike_pairs))
    assert len(alike_pairs) > 120 and found >= 0.9 * len(alike_pairs) and dropped <= {b for _, b in alike_pairs}


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_every_number_of_blocks_finds_the_same_pairs(spark, blocks):
    import random

    from pyspark.sql import functions as F

    from labelassay.llm.line_dedup import _keys

    dice = random.Random(blocks)
    rows = []
    for i in range(40):
        h = dice.getrandbits(64)
        for _ in range(4):
            x = h
            for b in dice.sample(range(64), dice.randint(0, 4)):
                x ^= 1 << b
            rows.append((len(rows), x - (1 << 64) if x >> 63 else x))
    df = spark.createDataFrame(rows, "line int, simhash long")
    keyed = df.select("line", F.explode(_keys(F.col("simhash"), blocks, 3)).alias("key"))
    met = {(r["a"], r["b"]) for r in keyed.withColumnRenamed("line", "a").join(keyed.withColumnRenamed("line", "b"), "key").where("a < b").select("a", "b").collect()}
    near = {(a, b) for (a, x), (b, y) in combinations(rows, 2) if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3}
    assert near and near <= met


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60), st.integers(0, 15), st.integers(0, 15), st.randoms(use_true_random=False))
def test_linked_sets_meet_inside_the_prefixes_of_their_pair(both, only_a, only_b, dice):
    tokens = np.array([dice.getrandbits(64) for _ in range(both + only_a + only_b)], np.uint64)
    if 100 * both < 75 * len(tokens) or len(set(tokens.tolist())) < len(tokens):
        return
    counts = np.ones(SKETCH, np.uint32)
    counts[(tokens & np.uint64(SKETCH - 1)).astype(int)] = [dice.choice([1, 3, 900]) for _ in tokens]
    a, b = np.sort(tokens[: both + only_a]), np.sort(np.concatenate([tokens[:both], tokens[both + only_a :]]))
    (pa_, _, ma), (pb_, _, mb) = prefix(a, counts), prefix(b, counts)
    overlap, m = -(-75 * (len(a) + len(b)) // 175), min(ma, mb)
    at_a, at_b = ({t: i for i, t in enumerate(p.tolist())} for p in (pa_, pb_))
    met = [t for t in at_a if t in at_b and at_a[t] < len(a) - overlap + m and at_b[t] < len(b) - overlap + m]
    assert len(met) >= m
    reach = lambda n, place, own: (n - place + own - 1) * 175 / 75 - n
    assert all(len(b) <= reach(len(a), at_a[t], ma) + 1e-9 and len(a) <= reach(len(b), at_b[t], mb) + 1e-9 for t in met)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_sets_differ_by_at_least_their_parity_bits(both, only_a, only_b):
    a, b = both | only_a, both | only_b
    x, y = parities([np.array(sorted(s), np.uint64) for s in (a, b)])
    assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)


def test_components_of_an_entry_that_cannot_link_are_no_pairs(spark):
    """120 sets share 40 of their 100 shingles and one differs from the first by a few: of 7260 pairs a row for each link, few others."""
    dice = np.random.default_rng(5)
    new = lambda n: dice.integers(0, 1 << 64, n, np.uint64)
    shared = new(40)
    sets = [np.concatenate([shared, new(60)]) for _ in range(120)]
    sets.append(np.concatenate([sets[0][:95], new(5)]))
    rows = [(1, i, 100, 1, 0, i, *bits) for i, bits in enumerate(parities(sets).tolist())]
    mixed = spark.createDataFrame(rows, "token long, doc long, n long, m long, place long, component long, " + ", ".join(f"{b} long" for b in _BITS))
    found = {(min(r.x, r.y), max(r.x, r.y)) for r in _across(mixed, 75).collect()}
    assert (0, 120) in found and len(found) < 200
    unknown = mixed.withColumns({b: F.lit(None).cast("long") for b in _BITS})  # no bits: a doc_id with several sets
    assert _across(unknown, 75).count() == 121 * 120 // 2


def test_near_copies_of_one_line_are_few_pairs(spark, word, monkeypatch):
    """Of 150 near copies of a line each is tried with a few others, not with all or 32 of them."""
    from labelassay.llm import line_dedup as module

    dice, tried, plain = random.Random(6), [], module._similar
    monkeypatch.setattr(module, "_similar", lambda pairs, *more: tried.append(pairs.count()) or plain(pairs, *more))
    base = [word(dice) for _ in range(40)]
    rows = []
    for i in range(150):
        own = base.copy()
        own[dice.randrange(40)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sum(r["n_dropped"] for r in got) == 149
    print("tried", tried)
    assert sum(tried) < 16 * 150


def test_bloom_words_reach_the_driver_in_chunks(spark, monkeypatch):
    """The driver got a row for each word of the filter, up to four million."""
    ids, seen = spark.range(20_000), []
    hashes = np.array([r[0] for r in ids.select(F.xxhash64("id")).collect()])
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(type(ids), name, lambda self, f=getattr(type(ids), name): seen.append(len(out := f(self))) or out)
    bits = bloom_bits(ids, 20_000)
    assert bloom_has(bits, hashes).all()
    assert np.bitwise_count(bits).sum() == len(np.unique(np.mod(hashes, len(bits) * 32)))
    assert sum(seen) == len(bits) // BLOOM_CHUNK == 2
    small = bloom_bits(ids.limit(3), 3)
    assert np.bitwise_count(small).sum() == 3 and len(small) < BLOOM_CHUNK
    assert not bloom_bits(ids.limit(0), 0).any()
