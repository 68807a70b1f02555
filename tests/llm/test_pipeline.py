"""Each stage against a plain version of it, on its own input."""

from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from labelassay.llm.queries import vocabulary
from labelassay.llm.tokens import PieceTokenizer

from .test_near_copies import brute


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).dropDuplicates(["doc_id"]).write.parquet(f"file://{folder}/documents.parquet")
    text = docs.where("doc_id = 40").first()["text"]
    spark.createDataFrame([(1, text), (2, None)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen.append(name)
        if name == "packing":
            library, pieces = PieceTokenizer(vocabulary()), defaultdict(bytes)
            for r in docs.orderBy("doc_id", "start").collect():
                pieces[r["doc_id"]] += bytes(r["ids"])
            want = {i: np.array(library.library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in before.items()}
            assert dict(pieces) == want
            continue
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            want = {i for i, t in before.items() if any(map(str.isalpha, t or ""))}
        elif name == "exact_dedup":
            last = {t: max(i for i, u in before.items() if u == t) for t in before.values()}
            want = set(last.values())
        elif name == "near_dedup":
            component = brute([{"doc_id": i, "text": t} for i, t in before.items()])[1]
            want = {i for i, c in component.items() if i == c}
        else:
            item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 1").first()["text"].lower().rstrip(".")
            want = {i for i, t in before.items() if item not in t.lower()}
        assert set(kept) == want and want < set(before)
        assert all(before[i] == t for i, t in kept.items())
    assert seen == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"]


def test_run(spark, with_null_id, tmp_path):
    """All stages in a row against their plain versions in a row, with a null id and a repeated row."""
    item = with_null_id.where("doc_id = 40").first()["text"]
    with_null_id.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in with_null_id.collect() if any(map(str.isalpha, r["text"] or ""))]
    last = {}
    for doc_id, text in rows:
        last[text] = max(last.get(text, -1), -1 if doc_id is None else doc_id)
    kept = {i: t for t, i in last.items()}
    assert -1 not in kept and len(kept) == len(last) < len(rows)
    component = brute([{"doc_id": i, "text": t} for i, t in kept.items()])[1]
    kept = {i: t for i, t in kept.items() if component[i] == i and item.lower().rstrip(".") not in t.lower()}
    library, pieces = PieceTokenizer(vocabulary()), defaultdict(bytes)
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").orderBy("doc_id", "start").collect():
        pieces[r["doc_id"]] += bytes(r["ids"])
    assert dict(pieces) == {i: np.array(library.library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in kept.items()}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
