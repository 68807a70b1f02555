"""Documents that arrive in several batches: the same outcome as for all at once, across restarts too."""

import random

import pandas as pd
import pytest

from labelassay.streaming import arrivals as A

SCHEMA = "doc_id long, batch_id long, filename string, brand string, error string"


def plain(docs, known=()):
    claimed = {k.strip(" ").lower() for k in known}
    out = {}
    for doc_id, _, _, brand, error in docs:
        key = (brand or "").strip(" ").lower()
        out[doc_id] = "failed" if error else "saved" if not key or key not in claimed else "duplicate"
        if key and not error:
            claimed.add(key)
    return out


@pytest.fixture(scope="module")
def docs():
    dice = random.Random(2)
    brands = ["Oak", " oak ", "OAK", "Elm", "elm", "Pine", "", "  ", None, "Ash", "saved before", "Birch"]
    return [(i, i // 10, f"f{i}", dice.choice(brands), dice.choice([None, None, "broken"])) for i in range(80)]


def drop(spark, docs, folder):
    dice = random.Random(len(docs))
    spark.createDataFrame(dice.sample(docs, len(docs)), SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_batches_and_restarts(spark, docs, tmp_path):
    known = spark.createDataFrame([("Saved Before ",), (None,), ("other",)], "key string")
    drops, folder = str(tmp_path / "drops"), str(tmp_path / "run")
    want = plain(docs, ["saved before", "other"])
    for k, upto in ((0, 20), (1, 45)):
        drop(spark, docs[(0, 20)[k] : upto], drops)
    first = A.run_arrivals(stream(spark, drops), folder, known).collect()
    assert {r["doc_id"]: r["outcome"] for r in first} == {i: o for i, o in want.items() if i < 45}
    # A new stream goes on where the other ended; what was claimed stays claimed.
    drop(spark, docs[45:], drops)
    done = A.run_arrivals(stream(spark, drops), folder, known)
    rows = done.collect()
    assert len(rows) == len(docs) and {r["doc_id"]: r["outcome"] for r in rows} == want
    counts = {r["batch_id"]: (r["saved"], r["duplicates"], r["failed"]) for r in A.counts_of_batches(done).collect()}
    of = lambda b, o: sum(want[i] == o for i, n, *_ in docs if n == b)
    assert counts == {b: (of(b, "saved"), of(b, "duplicate"), of(b, "failed")) for b in range(8)}
    # Nothing new: nothing changes.
    assert A.run_arrivals(stream(spark, drops), folder, known).count() == len(docs)


def test_one_brand_with_most_rows(spark, tmp_path):
    docs = [(i, 0, "f", "Oak", None) for i in range(3000)]
    drop(spark, docs, str(tmp_path / "drops"))
    rows = A.run_arrivals(stream(spark, str(tmp_path / "drops")), str(tmp_path / "run")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000)) and [r["doc_id"] for r in rows if r["outcome"] == "saved"] == [0]


def test_keys_of_a_bucket_share_calls_and_frames():
    """a call and two frames for each key of a micro-batch took 3 ms a key."""

    class State(dict):
        asked = 0

        def containsKey(self, key):  # noqa: N802
            self.asked += 1
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            assert key not in self  # what is claimed stays claimed
            self[key] = value

    dice, claims, state = random.Random(3), A.FirstClaims(), State()
    claims.init(type("Handle", (), {"getMapState": lambda self, *_: state})())
    docs = [(i, 0, "f", f"k{dice.randrange(400)}", None) for i in range(3000)]
    got = {}
    for part in (docs[:1000], docs[1000:]):
        some = dice.sample(part, len(part))
        frames = [pd.DataFrame([d[:4] for d in some[i : i + 300]], columns=["doc_id", "batch_id", "filename", "key"]) for i in range(0, len(some), 300)]
        before, out = state.asked, list(claims.handleInputRows(7, iter(frames), None))
        assert state.asked - before == len({d[3] for d in part}) and len(out) <= 2 * len(frames) + 1
        got |= {r.doc_id: r.outcome for f in out for r in f.itertuples()}
    assert got == plain(docs)
