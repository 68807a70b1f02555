import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelassay.llm.components import components
from labelassay.llm.sharding import shard
from labelassay.llm.stream_dedup import drop_copies, stream_dedup


def groups(rows):
    of = defaultdict(list)
    for r in rows:
        of[r["text"] or ""].append(r["doc_id"])
    return of


@pytest.mark.parametrize("digest", [None, lambda sha: F.substring(sha, 1, 1)], ids=["sha256", "colliding"])
def test_stream_dedup(with_null_id, digest):
    rows = with_null_id.select("doc_id", "text").collect()
    of = groups(rows)
    got = stream_dedup(with_null_id, batches=100, rows_per_salt=2, digest=digest).collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    for g in got:
        own = of[text[g["doc_id"]]] if g["doc_id"] is not None else next(v for t, v in of.items() if hashlib.sha256(t.encode()).hexdigest() == g["text_sha256"])
        assert g["group_size"] == len(own)
        assert g["keep_id"] == max((i for i in own if i is not None), default=None)
        if g["doc_id"] is not None:
            assert g["text_sha256"] == hashlib.sha256(text[g["doc_id"]].encode()).hexdigest()
    assert sum(g["kept"] for g in got) == len(of)
    assert all(g["doc_id"] == g["keep_id"] for g in got if g["kept"])


def test_drop_copies_keeps_columns(docs, empty):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in groups(rows).values())
    assert stream_dedup(empty).collect() == []
    assert drop_copies(empty).count() == 0


def test_sharding(with_null_id):
    rows = with_null_id.select("doc_id", "text").collect()
    got = shard(with_null_id, shards=4).collect()
    assert len(got) == len(rows)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g["slot"])
        assert g["law"] == "bytes" and g["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_even_and_keeps_groups(spark):
    rows = [(i, f"text {i} " * (1 + i % 9)) for i in range(4000)] + [(5000 + i, "a group of copies " * 3) for i in range(60)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    sizes = Counter()
    for g in got:
        sizes[g["shard"]] += g["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    assert len({g["shard"] for g in got if g["doc_id"] >= 5000}) == 1


def test_sharding_divides_a_hot_group(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(9000 + i, f"other {i}") for i in range(300)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    sizes = Counter()
    for g in got:
        sizes[g["shard"]] += g["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * mean


def test_sharding_of_no_rows(empty):
    assert shard(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (102, 101), (300, 301), (301, 300), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 100, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
