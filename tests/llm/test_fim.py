"""Fill-in-middle against a plain version, for each kind of unit."""

import hashlib
import re

import duckdb
import pytest

from labelassay.llm import fim
from labelassay.llm.queries import OP13_SQL, op13_fill_in_middle

PLAIN_UNITS = {"code_point": r"(?s:.)", "word": r"\s*\S+|\s+", "line": r"[^\n]*\n|[^\n]+"}


def plain(doc_id, text, unit):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, len(units))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text, text)
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, len(units), "spm" if h4 % 100 < 20 else "psm", len(prefix), len(middle), text, out)


@pytest.fixture(scope="module")
def odd(spark, with_null_id):
    more = ["x<P>y", "<S>", "a<M", "<", "a<S" + ">" * 3, "line\n" * 700, "\n\n", "é\u00a0ü " * 600, "😀" * 1025, "ab" * 256, "<P" * 9, "tail\r\nx\u2028y"]
    return with_null_id.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))


@pytest.mark.parametrize("kind", fim.UNITS)
def test_cuts_and_forms(odd, kind):
    unit = PLAIN_UNITS[kind]
    got = [tuple(r) for r in fim.fill_in_middle(odd, fim.UNITS[kind]).collect()]
    want = [plain(r["doc_id"], r["text"], unit) for r in odd.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_digest_and_edges(odd, empty, docs):
    rows = {r["doc_id"]: r for r in fim.fim_digest(odd).collect()}
    for doc_id, text in odd.select("doc_id", "text").collect():
        if doc_id is not None:
            assert rows[doc_id]["restored_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert fim.fim_digest(empty).collect() == []
    assert fim.fim_digest(docs).count() == docs.count()  # with clashing columns and a repeated row


def test_texts_are_shuffled_once(spark, tmp_path):
    """The join that brings the cuts back is the only one that moves texts."""
    spark.createDataFrame([(1, "some text")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fim.fim_digest(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("ReadSchema" in line and "text:string" in line for line in plan.split("\n")) == 1 and "Python" not in plan and "Arrow" not in plan


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = op13_fill_in_middle(spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP13_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
