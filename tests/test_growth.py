"""What costly steps do with many rows."""

import json
import struct
import weakref

import pandas as pd
from labelassay.functions.extract import extract_class_type
from labelassay.functions.text import finalize_producer
from labelassay.operators import store as S
from labelassay.operators.documents import extract_producer
from labelassay.plans.inputs import dealt_parts, view
from labelassay.sources import files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 200, 150)


def test_photos_of_many_files_share_a_frame_up_to_some_bytes(monkeypatch):
    """a frame for each file cost ten times the reading of the file."""

    def frames(n, size):
        monkeypatch.setitem(files.IMAGES, "docx", lambda content: [PNG + bytes(size)] * 2)
        batches = (pd.DataFrame({"path": [f"{b}/{i}" for i in range(n)], "kind": "docx", "content": b""}) for b in range(3))
        return list(files._images(batches))

    assert len(small := frames(500, 0)) == 1
    assert len(small[0]) == 3000 and small[0]["path"].nunique() == 1500
    large = frames(5, 1 << 20)
    assert sum(map(len, large)) == 30
    assert max(f["image"].map(len).sum() for f in large) <= files.IMAGE_BYTES + 2 * (len(PNG) + (1 << 20))


def test_short_rows_of_a_small_file_go_to_many_tasks(spark):
    """all rows of the table were one task."""
    rows = dealt_parts(spark, SF)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_a_scan_lists_some_of_the_files_only(spark, tmp_path, monkeypatch):
    """the driver held a list of all files, and a task for 32 of them."""
    for k in range(5):
        (tmp_path / f"f{k}").mkdir()
        for i in range(3):
            (tmp_path / f"f{k}" / f"{i}.txt").write_bytes(b"x")
    (tmp_path / "f0" / "below").mkdir()
    for name in ("f0/below/b.docx", "a[1].txt", "b{x,y}.txt", "c*.TXT", "d.docx", ".hidden.txt", "_temporary.txt"):
        (tmp_path / name).write_bytes(b"x")
    want = sorted(map(tuple, files.read_documents(spark, f"file://{tmp_path}").collect()), key=str)
    asked, whole = [], files.read_documents
    monkeypatch.setattr(files, "read_documents", lambda s, paths, most: asked.append(len(paths)) or whole(s, paths, most))
    got = files.read_folders(spark, f"file://{tmp_path}", at_once=2, files_at_once=3)
    assert len(want) == 20 and sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(asked) == [1, 1, 2, 2, 3]


def test_lists_of_files_dont_stay_in_the_driver(spark, tmp_path, monkeypatch):
    """the lists of all rounds stayed in a cache, and a round listed 16 folders twice."""
    for k in range(10):
        (tmp_path / f"f{k}").mkdir()
        (tmp_path / f"f{k}" / "a.txt").write_bytes(b"x")
    asked, frames, whole, name = [], [], files.read_documents, "spark.sql.hive.filesourcePartitionFileCacheSize"

    def read(session, paths, most):
        asked.append((len(paths), session.conf.get(name)))
        out = whole(session, paths, most)
        frames.append(weakref.ref(out._jdf))
        return out

    monkeypatch.setattr(files, "read_documents", read)
    before = spark.conf.get(name)
    found = files.read_folders(spark, f"file://{tmp_path}")
    assert [f() for f in frames] == [None, None]  # else the driver keeps their lists
    assert found.count() == 10
    assert sorted(asked) == [(2, "0"), (8, "0")]
    assert spark.conf.get(name) == before != "0"


def test_a_value_is_worked_out_once(spark):
    """the lines of a text were cut and searched again for each use of them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    texts = spark.range(3).select(counted(F.concat(F.lit("Bottled by\nOak Co\nNapa, CA 94558\nx"), F.col("id").cast("string"))).alias("text"))
    assert [r[0] for r in texts.select(finalize_producer(F.col("text"))).collect()] == ["Oak Co\nNapa, CA 94558"] * 3
    assert seen.value == 3
    plan = texts.select(extract_producer(F.col("text")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1
    assert view(spark, SF, "label_text").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_producers_as_before(spark):
    """no phrase, a bare phrase, a stop, blank lines, a null text."""
    texts = [None, "", "Oak\nNapa, CA", "BOTTLED BY", "x\nBottled by\n\nOak Co\n\n\nNapa, CA", "Bottled by Oak\nGOVERNMENT WARNING\nNapa, CA", "Bottled by Oak, Napa, CA 94558, USA tel 1", "Bottled by\n" + "a\n" * 9 + "Napa, CA"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extract_producer(F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [None, None, None, "", "Oak Co", "Oak", "Oak, Napa, CA 94558, USA", "a a a a"]


def test_designations_are_looked_for_once(spark):
    """the text was scanned again for the designation's own name."""
    texts = spark.createDataFrame([(0, None), (1, "none"), (2, "x\nPale  Ale here"), (3, "Kentucky Straight Bourbon\nWhiskey")], "i int, t string")
    got = texts.select("i", extract_class_type(F.col("t")).alias("c"))
    assert [r["c"] for r in sorted(got.collect())] == [None, None, "ale Ale", "Kentucky Straight Bourbon Whiskey"]
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1


def test_rows_are_worked_out_once_before_they_are_numbered(spark):
    """finding the ranges ran the plan of the rows once more."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        seen.add(1)
        return str(x)

    rows = spark.range(0, 400, 1, 4).select((400 - F.col("id")).alias("seq"), costly("id").alias("text"))
    got = {r["id"]: (r["seq"], r["text"]) for r in S.numbered(rows, 10).collect()}
    assert got == {10 + k: (k, str(400 - k)) for k in range(1, 401)}
    assert seen.value == 400


def test_photos_stand_in_the_whole_text_as_they_are(spark):
    """each photo's text was parsed and written again."""
    kind = S.RESULTS[S.RESULTS.index("photos array<") + len("photos array<") : -1]
    none = "NULL AS extracted, NULL AS expected, NULL AS comparisons_by_field, true AS warning_caps_ok, CAST(NULL AS BOOLEAN) AS warning_bold_ok"
    photos = spark.sql(f"SELECT 1L AS k, CAST(struct(p AS index, 'a \"b\" }}' AS raw_text, {none}) AS {kind}) AS photo FROM VALUES (2), (0) AS t(p) UNION ALL SELECT 1L, CAST(NULL AS {kind})")
    fields = spark.sql("SELECT k, 'net_contents' AS field_key, 'match' AS status, '1 L' AS value, 0 AS source_index, array(named_struct('index', 0, 'extracted', '1 L')) AS readings, '1 L' AS expected, CAST(NULL AS STRING) AS computed_status, false AS manual_override FROM VALUES (1L), (2L) AS t(k)")
    marks = spark.sql("SELECT 1L AS k, true AS caps_ok, CAST(NULL AS BOOLEAN) AS bold_ok")
    whole = S.results_of(fields, ["k"], marks, photos)
    assert "jsontostructs" not in whole._jdf.queryExecution().analyzed().toString().lower() and "from_json" not in whole._jdf.queryExecution().analyzed().toString()
    got = {r["k"]: json.loads(r["results_json"]) for r in whole.collect()}
    assert [p and (p["index"], p["raw_text"], p["expected"]) for p in got[1]["photos"]] == [None, (0, 'a "b" }', None), (2, 'a "b" }', None)]
    assert got[2]["photos"] == [] and got[2]["warning_caps_ok"] is None and got[1]["warning_caps_ok"] is True
    assert got[1]["field_summary"]["net_contents"]["values"] == [{"value": "1 L", "source_index": 0}]
