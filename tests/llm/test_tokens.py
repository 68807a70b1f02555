import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelassay.llm import id_blocks, tokens
from labelassay.llm.id_blocks import decode_segment, encode_segment, id_block_digest, segments
from labelassay.llm.packing import first_fit_decreasing, pack, pack_digest
from labelassay.llm.queries import vocabulary
from labelassay.llm.tokens import PieceTokenizer


@pytest.fixture(scope="module")
def library():
    return PieceTokenizer(vocabulary(), keep=50)


def reference(library, text, end):
    return library.library.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x1c\xa0ab'.,1é 漢😀<|endoftext|>", max_size=40), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    library = PieceTokenizer(vocabulary(), keep=3) if not hasattr(test_pieces_give_the_ids_of_whole_texts, "kept") else test_pieces_give_the_ids_of_whole_texts.kept
    test_pieces_give_the_ids_of_whole_texts.kept = library
    texts += ["a b c", "don't  stop " + "x" * 100]
    assert library.encode(texts) == [library.whole(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n'-,.sSt1\u00e9\u00df\u00d7\u2028\u2003\u4e2d\u0436\x1f\x85\t", max_size=30), max_size=6))
def test_cut_pieces_give_the_ids_of_whole_texts(texts):
    own = test_cut_pieces_give_the_ids_of_whole_texts
    own.kept = library = getattr(own, "kept", None) or PieceTokenizer(vocabulary(), keep=20)
    column = pa.array(["x", *texts, None, "", "It's (all) a-b.\nT\u00eate 12, 'tis <|endoftext|>.\n\nNo"]).slice(1)
    assert library.encode(column) == [library.whole(t or "") for t in column.to_pylist()]


def test_a_word_reaches_the_library_once_whatever_mark_follows():
    """Pieces were cut at spaces alone: a word was encoded anew with each mark or line after it."""
    library, seen = PieceTokenizer(vocabulary()), []
    spaced = library._encode_spaced
    library._encode_spaced = lambda words: seen.extend(words) or spaced(words)
    text = "so thingon, thingon. thingon; (thingon) thingon\nso thingon:\nso thingon"
    assert library.encode([text, text + "."]) == [library.whole(text), library.whole(text + ".")]
    assert seen == [b" thingon"] and b"thingon" in library.new


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=300), max_size=4))
def test_blocks_round_trip(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    raw = encode_segment(np.ones(len(docs), bool), np.arange(len(docs)), counts, ids)
    both = list(segments(memoryview(raw + raw)))
    assert len(both) == 2
    valid, doc_ids, got_counts, got = decode_segment(both[1])
    assert got.tolist() == ids.tolist() and got_counts.tolist() == counts.tolist() and valid.all() and doc_ids.tolist() == list(range(len(docs)))


def test_outliers_do_not_widen_a_block():
    ids = np.full(128 * 100, 7, np.uint32)
    ids[::128] = 2**31
    assert len(encode_segment(np.ones(1, bool), np.zeros(1), np.array([len(ids)]), ids)) < 100 * 32


def test_id_blocks_digest(spark, with_null_id, library):
    got = id_block_digest(with_null_id, vocabulary(), end=0).collect()
    rows = with_null_id.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(i := reference(library, r["text"], 0)), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows)
    assert sorted((g["doc_id"] is not None, g["doc_id"] or 0, g["n_tokens"], g["ids_crc32"]) for g in got) == want
    start = 0
    for g in sorted(got, key=lambda g: g["start"]):
        assert g["start"] == start
        start += g["n_tokens"]
    ids = [g["doc_id"] for g in sorted(got, key=lambda g: g["start"]) if g["doc_id"] is not None]
    assert ids == sorted(ids)


def test_id_blocks_of_no_rows(empty):
    assert id_block_digest(empty, vocabulary()).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_first_fit_decreasing_is_plain_first_fit(lengths):
    bins, offsets = first_fit_decreasing(np.array(lengths, np.int64), 32)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(32)
        want[i] = (at, 32 - room[at])
        room[at] -= lengths[i]
    assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [want[i] for i in range(len(lengths))]


def test_packing(with_null_id, library):
    got = pack(with_null_id, vocabulary(), group_docs=20).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for g in got:
        assert g["length"] * 4 == len(g["ids"]) and 0 < g["length"] <= 2048
        by_doc[g["doc_id"]].append(g)
        by_sequence[g["sequence_id"]].append(g)
    for pieces in by_sequence.values():
        at = 0
        for g in sorted(pieces, key=lambda g: g["offset"]):
            assert g["offset"] == at
            at += g["length"]
        assert at <= 2048
    for r in with_null_id.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").collect():
        want = np.array(reference(library, r["text"], 1), "<u4").tobytes()
        own = sorted(by_doc[r["doc_id"]], key=lambda g: g["start"])
        times = 2 if r["doc_id"] == 3 else 1
        assert b"".join(bytes(g["ids"]) for g in own) in (want, want * times)
        assert {g["doc_tokens"] for g in own} == {len(want) // 4}
    used = sum(g["length"] for g in got)
    assert used / (2048 * len(by_sequence)) > 0.9


def test_packing_digest(empty, docs):
    assert pack_digest(empty, vocabulary()).collect() == []
    assert pack_digest(docs, vocabulary()).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_id_files_are_read_a_segment_at_a_time(tmp_path, monkeypatch):
    """A file of millions of ids went whole through the JVM, beside the tokenizer's pieces that the worker kept."""
    counts = np.array([3, 0, 4])
    parts = [encode_segment(np.array([1, 0, 1]), np.array([7, 0, 9]) + k, counts, np.arange(7, dtype=np.uint32) + k) for k in range(5)]
    (tmp_path / "a.pfr").write_bytes(b"".join(parts))
    monkeypatch.setitem(tokens._loaded, "other", object())
    held, whole = [], id_blocks._whole_read
    monkeypatch.setattr(id_blocks, "_whole_read", lambda stream, n: held.append(n) or whole(stream, n))
    manifest = pa.RecordBatch.from_pylist([{"file": "a.pfr", "start": 100}])
    read = list(id_blocks._reader(f"file://{tmp_path}")(iter([manifest])))
    assert len(read) == 5 and max(held) < len(parts[0]) and not tokens._loaded
    for k, batch in enumerate(read):
        assert batch.column("doc_id").to_pylist() == [7 + k, None, 9 + k]
        assert batch.column("start").to_pylist() == [100 + 7 * k, 103 + 7 * k, 103 + 7 * k]
        assert [np.frombuffer(x, "<u4").tolist() for x in batch.column("ids").to_pylist()] == [[k, k + 1, k + 2], [], [k + 3, k + 4, k + 5, k + 6]]


def test_a_written_task_leaves_no_pieces_in_its_worker(tmp_path, monkeypatch):
    """Idle workers take tasks in turn: each of an executor's kept up to two dictionaries of pieces."""
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 0}))
    library = tokens.tokenizer(vocabulary())
    rows = pa.RecordBatch.from_pylist([{"doc_id": 3, "text": "one two, three"}, {"doc_id": None, "text": None}])
    made = list(id_blocks._writer(f"file://{tmp_path}", vocabulary(), 0, 250_000, 8_000_000)(iter([rows])))
    assert made[0].column("n_docs").to_pylist() == [2]
    assert tokens.tokenizer(vocabulary()) is library and not library.new and not library.old


def test_a_packed_task_leaves_no_pieces_in_its_worker():
    from labelassay.llm.packing import _cutter

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, more words", None], "seed": [5, 6]})
    rows = [r for b in _cutter(vocabulary(), 1, 4, 2)([batch]) for r in b.to_pylist()]
    assert {r["doc_id"] for r in rows} == {1, 2}
    kept = tokens.tokenizer(vocabulary())
    assert not kept.new and not kept.old


def test_a_state_store_takes_little_memory():
    """An executor may hold hundreds of stores; each takes an eighth of a write buffer (64 MB by default) at once."""
    from labelassay.llm.stream_dedup import STATE_ON_DISK

    assert int(STATE_ON_DISK["spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB"]) <= 8
