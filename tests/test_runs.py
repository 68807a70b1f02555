"""Ties of designations, comparisons, groups, stores and files against values written by hand or plain versions."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from labelassay.config import FIELDS, WARNING
from labelassay.functions.extract import extract_class_type
from labelassay.functions.text import broad_category, normalize_states
from labelassay.operators import compare as C
from labelassay.operators import layout as L
from labelassay.operators import match as M
from labelassay.operators import store as S
from labelassay.operators import verdict as V
from labelassay.sources import files as X


@pytest.mark.parametrize(
    "text, kind, category",
    [
        ("Blue Agave Tequila Liqueur", "Tequila Liqueur", "distilled spirits"),
        ("Whiskey Liqueur", "Whiskey Liqueur", "distilled spirits"),
        ("Rye & Gin", "Rye", "distilled spirits"),
        ("a KENTUCKY\n straight  bourbon\twhiskey 45%", "KENTUCKY straight bourbon whiskey", "distilled spirits"),
        ("Vodka Cider", "Vodka Cider", "distilled spirits"),
        ("rum ale", "rum ale", "distilled spirits"),
        ("A\u00d1EJO Tequila", "A\u00d1EJO Tequila", "distilled spirits"),
        ("Red\nWine (Front Label)", "Red Wine", "wine"),
        ("ginger", "gin", None),
        ("lagers only", "lager", None),
        ("water", None, None),
    ],
)
def test_designations(spark, text, kind, category):
    row = spark.createDataFrame([(text,)], "t string").select(extract_class_type(F.col("t")).alias("k"), broad_category(F.col("t")).alias("c")).first()
    assert (row["k"], row["c"]) == (kind, category)


def test_states(spark):
    text = "West  Virginia, new york; VIRGINIA Washington Texasville"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(normalize_states(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == ["WV, NY; VA WA Texasville", None, ""]


def row_of(i, mode="auto", index=0, run=0, **fields):
    return (run, i, mode, index, *(fields.get(f) for f in FIELDS), *(fields.get(f"expected_{f}") for f in FIELDS))


KEYS = "run_id long, photo_id long, mode string, index int"
SCHEMA = ", ".join([KEYS, *(f"{f} string" for f in FIELDS), *(f"expected_{f} string" for f in FIELDS)])


def test_compare_product(spark):
    rows = [
        row_of(1, brand_name="Old River", expected_brand_name="OLD RIVER!", class_type="Vodka", expected_class_type="Distilled Spirits", alcohol_content="45% ALC/VOL", expected_alcohol_content="90 PROOF", net_contents=None, expected_net_contents=None, health_warning_text=WARNING[:80], expected_health_warning_text=WARNING),
        row_of(2, "cola", class_type="Vodka", expected_class_type="Distilled Spirits", net_contents="750 mL", expected_net_contents="0.75 L", health_warning_text=" ", expected_health_warning_text=WARNING),
        row_of(2, "cola", class_type="Vodka", expected_class_type="Distilled Spirits", net_contents="750 mL", expected_net_contents="0.75 L", health_warning_text=" ", expected_health_warning_text=WARNING),
    ]
    got = C.compare_product(spark.createDataFrame(rows, SCHEMA), ["photo_id"], broad_class=F.col("mode") == "cola").collect()
    assert len(got) == 21
    status = {(r["photo_id"], r["field_key"]): (r["status"], r["score"] if r["score"] is None else round(r["score"])) for r in got}
    assert status[1, "brand_name"] == ("match", 100) and status[1, "alcohol_content"] == ("match", 100)
    assert status[1, "class_type"][0] == "mismatch" and status[2, "class_type"][0] == "match"
    assert status[1, "class_type"][1] == status[2, "class_type"][1]  # the rescue leaves the score
    assert status[1, "net_contents"] == ("not_found", None) and status[2, "net_contents"] == ("match", 100)
    assert status[1, "health_warning_text"] == ("match", 100) and status[2, "health_warning_text"] == ("not_found", None)
    assert status[2, "country_of_origin"] == ("match", None)
    shown = spark.createDataFrame([(84.5,), (85.5,), (None,)], "s double").select(C.score_shown(F.col("s")).alias("s")).collect()
    assert [r["s"] for r in shown] == ["84%", "86%", None]


def test_group_summary(spark):
    rows = [
        (1, "brand_name", 0, "Oak", "Elm", "mismatch"), (1, "brand_name", 1, "OAK", "Elm", "mismatch"),
        (1, "net_contents", 0, "750 mL", "1 L", "mismatch"), (1, "net_contents", 1, "500 mL", "1 L", "mismatch"), (1, "net_contents", 2, " ", "1 L", "not_found"),
        (1, "health_warning_text", 0, WARNING[:60], "x", "mismatch"), (1, "health_warning_text", 1, WARNING, "x", "mismatch"),
        (1, "class_type", 0, None, "Gin", "not_found"), (1, "class_type", 1, "", "Gin", "not_found"),
        (2, "class_type", 4, "Gin", "Gin", "match"), (2, "class_type", 3, "Rum", "Gin", "mismatch"),
    ]
    df = spark.createDataFrame(rows, "run_id long, field_key string, index int, extracted string, expected string, status string")
    got = {(r["run_id"], r["field_key"]): r for r in V.group_summary(df, ["run_id"]).collect()}
    brief = {k: (r["status"], r["value"], r["source_index"], r["n_values"]) for k, r in got.items()}
    assert brief == {
        (1, "brand_name"): ("mismatch", "Oak", 0, 0),
        (1, "net_contents"): ("disagreement", None, None, 2),
        (1, "health_warning_text"): ("mismatch", WARNING[:60], 0, 0),  # a part of the other: the best stretch agrees
        (1, "class_type"): ("not_found", None, None, 0),
        (2, "class_type"): ("match", "Gin", 4, 0),
    }
    assert [(x["index"], x["extracted"]) for x in got[1, "net_contents"]["readings"]] == [(0, "750 mL"), (1, "500 mL")]


def test_group_headers(spark):
    rows = [(7, 0, "adhoc", None, None, None, None), (7, 1, "auto", 5, "Oak", False, None), (7, 2, "product", 5, "Oak", True, False), (7, 3, "cola", None, None, False, True), (7, 4, "cola", None, None, None, None), (8, 0, "auto", None, None, True, True), (8, 1, "auto", 6, "", None, None)]
    df = spark.createDataFrame(rows, "run_id long, index int, mode string, product_id long, product_name string, caps_ok boolean, bold_ok boolean")
    got = [(r["run_id"], r["place"], r["label"], r["photos"], r["caps_ok"], r["bold_ok"]) for r in V.group_headers(df).orderBy("run_id", "place").collect()]
    assert got == [(7, 1, "Label 1", 1, None, None), (7, 2, "Oak", 2, True, False), (7, 3, "COLA Application", 2, False, True), (8, 1, "Label 1", 1, True, True), (8, 2, "Saved Product", 1, None, None)]


def test_expected_values(spark):
    typed = ["brand_name", "class_type", "alcohol_content", "net_contents", "producer_info", "country_of_origin"]
    photos = spark.createDataFrame([(i, i % 2, m, c, " typed ", *([" "] * 5)) for i, (m, c) in enumerate([("auto", None), ("product", 9), ("product", 1), ("cola", None), ("adhoc", 1), ("auto", None)])], "photo_id long, run_id long, mode string, chosen_id long, " + ", ".join(f"typed_{f} string" for f in typed))
    products = spark.createDataFrame([(1, "One", *(["b1"] * 6)), (2, "Two", *(["b2"] * 6))], "id long, name string, " + ", ".join(f"{f} string" for f in typed))
    best = spark.createDataFrame([(0, 2), (5, None)], "photo_id long, product_id long")
    application = spark.createDataFrame([(1, *(["doc"] * 6))], "run_id long, " + ", ".join(f"{f} string" for f in typed))
    got = {r["photo_id"]: (r["product_id"], r["product_name"], r["expected_brand_name"], r["expected_class_type"]) for r in M.expected_values(photos, best, products, application).collect()}
    assert got == {0: (2, "Two", "b2", "b2"), 1: (None, None, None, None), 2: (1, "One", "b1", "b1"), 3: (None, None, "doc", "doc"), 4: (None, None, "typed", None), 5: (None, None, None, None)}


def test_numbers_and_versions(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("seq"), "id").withColumnRenamed("id", "own").repartition(7)
    got = sorted((r["id"], r["seq"]) for r in S.numbered(rows, 40).collect())
    assert [i for i, _ in got] == list(range(41, 1041)) and [s for _, s in got] == sorted(s for _, s in got)
    first = spark.createDataFrame([(1, "a.pdf", "Oak", "pass", "{}", "t1", "t1", 1, False), (2, "b.pdf", "Elm", "pass", "{}", "t1", "t1", 1, False)], "id long, source_filename string, brand_name string, overall_status string, results_json string, created_at string, updated_at string, version long, deleted boolean")
    edits = spark.createDataFrame([("update", 1, 1, None, "A", "x", "1"), ("update", 2, 1, None, "B", "y", "2"), ("delete", 3, 2, None, None, None, None), ("update", 4, 99, None, "C", "z", "3"), ("insert", 5, None, "c.pdf", "New", "pass", "4")], "action string, seq long, id long, source_filename string, brand_name string, overall_status string, results_json string")
    now = S.latest(first.unionByName(S.next_verifications(first, edits, 2, "t2", 2)))
    assert sorted((r["id"], r["source_filename"], r["brand_name"], r["results_json"], r["created_at"], r["updated_at"]) for r in now.collect()) == [(1, "a.pdf", "B", "2", "t1", "t2"), (3, "c.pdf", "New", "4", "t2", "t2")]
    assert [r["id"] for r in S.by_id(first, spark.createDataFrame([(2,), (2,), (5,)], "id long")).collect()] == [2]


def test_numbering_of_large_tables(spark):
    """More rows than a partition holds, a wide column, and one key that a third of the rows share."""
    n = 2_000_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**12))).alias("seq"), F.col("id").alias("own"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))
    kept = S.numbered(rows, 10)
    lag = kept.where("id % 100000 = 11 OR id = 10 + " + str(n)).select("id", "seq").orderBy("id").collect()
    got = kept.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("own"), F.sum(F.length("wide"))).first()
    assert tuple(got) == (n, n, 11, n + 10, n, n * 256)
    assert [r["seq"] for r in lag] == sorted(r["seq"] for r in lag)
    # Equal keys keep the order of the input.
    same = kept.where("seq = 7").agg(F.max(F.col("id")) - F.min("id") + 1, F.corr("id", "own")).first()
    assert same[0] == -(-n // 3) and same[1] > 0.999999


def test_upsert_of_run(spark):
    fields = ["brand_name", "class_type", "alcohol_content", "net_contents", "producer_info", "country_of_origin"]
    store = spark.createDataFrame([(1, "One", "b", "c", None, None, None, None, "t1", "t1", 1, False), (2, "Two", "b", "c", None, None, None, None, "t1", "t1", 1, True)], S.PRODUCT)
    given = [("update", 1, 1, "ignored", " new ", " "), ("update", 2, 2, "x", "n", "n"), ("update", 3, None, "x", "n", "n"), ("create", 4, 1, "  ", "n", "n"), (None, 5, None, " Five ", "n", ""), ("create", 6, None, None, "n", "n")]
    submitted = spark.createDataFrame([(*g, *([None] * 4)) for g in given], "action string, seq long, product_id long, name string, " + ", ".join(f"{f} string" for f in fields))
    outcomes = {r["seq"]: (r["outcome"], r["name"]) for r in S.changes_of_run(submitted, store).collect()}
    assert outcomes == {1: ("updated", "One"), 2: ("not_found", None), 3: ("not_found", None), 4: ("no_name", None), 5: ("created", "Five"), 6: ("no_name", None)}
    now = S.latest(store.unionByName(S.upsert_of_run(store, submitted, 2, "t2", 2)))
    assert sorted((r["id"], r["name"], r["brand_name"], r["class_type"], r["created_at"], r["updated_at"]) for r in now.collect()) == [(1, "One", "new", None, "t1", "t2"), (3, "Five", "n", None, "t2", "t2")]
    first = S.upsert_of_run(S.empty_store(spark), submitted, 1, "t1", 0)
    assert [(r["id"], r["name"]) for r in first.collect()] == [(1, "Five")] and first.schema.simpleString() == store.schema.simpleString()


def test_document_images():
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        kind = f'Type="{X.IMAGE_TYPE}"'
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{X.PACKAGE}"><Relationship Id="a" {kind} Target="media/b.png"/><Relationship Id="b" {kind} Target="../media/a.png"/><Relationship Id="c" {kind} Target="media/gone.png"/><Relationship Id="d" Type="http://x/styles" Target="styles.xml"/><Relationship Id="e" {kind} Target="http://x/y.png" TargetMode="External"/></Relationships>')
        z.writestr("word/media/b.png", png(300, 200))
        z.writestr("media/a.png", png(50, 50))
        z.writestr("word/media/unrelated.png", png(500, 500))
    found = X.docx_images(out.getvalue())
    assert [X.image_size(x) for x in found] == [(300, 200), (50, 50)]
    assert X.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x10\0\x20\x03") == (32, 16)
    assert X.image_size(b"GIF89a\x05\0\x06\0") == (5, 6) and X.image_size(b"none") is None


def test_broken_files_cost_their_own_row(spark):
    rows = [("a.docx", "docx", b"no file"), ("b.txt", "txt", b"x"), ("c.pdf", "pdf", b"%PDF-1.4 broken"), ("d.docx", "docx", None)]
    files = spark.createDataFrame(rows, "path string, kind string, content binary")
    assert all(r["text"] is None and r["error"] for r in X.texts_of(files).collect())
    assert X.images_of(files).collect() == []


def test_label_fields(spark):
    words = [(1, 1, "OAK", "95", 0, 10, 50, 60, 1, 1, 1), (1, 2, "RIVER", "95", 60, 10, 50, 60, 1, 1, 1), (1, 3, "Vodka", "95", 0, 90, 50, 20, 1, 1, 2), (2, 1, "??", "5", 0, 0, 9, 9, 1, 1, 1)]
    boxes = spark.createDataFrame(words, "photo_id long, word_seq int, text string, conf string, left int, top int, width int, height int, block_num int, par_num int, line_num int")
    texts = spark.createDataFrame([(1, "OAK RIVER\nVodka 40% ALC/VOL 750 mL\nBottled by Oak, Salem, OR 97301\nPRODUCT OF France"), (2, None)], "photo_id long, raw_text string")
    got = {r["photo_id"]: r.asDict() for r in L.label_fields(boxes, texts).collect()}
    assert got[1] == {"photo_id": 1, "brand_name": "OAK RIVER", "class_type": "Vodka", "alcohol_content": "40% ALC/VOL", "net_contents": "750 mL", "producer_info": "Oak, Salem, OR 97301", "country_of_origin": "France", "health_warning_text": None}
    assert set(got[2].values()) == {2, None}
