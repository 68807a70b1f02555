import io
import random
import re
import sys
import types
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelassay.operators import documents as D
from labelassay.operators import store as S
from labelassay.operators.heading import heading_bold, ink_share, word_density
from labelassay.operators.layout import brand_names, cluster, confident_words, group_lines, producers
from labelassay.sources import files
from labelassay.sources.files import docx_text, read_documents

SHEET = "Brand Name: Oak River\nClass/Type: Straight Rye (aged)\nAlcohol Content: 45% (90 PROOF)\nNet Contents - 750 mL\nName and Address of Producer: Oak River Co, Salem, OR 97301\nCountry of Origin: USA\n"
FORM = """5. BRAND NAME (Required)

Copper Hill (Front Label)
6. CLASS AND TYPE
Kentucky Straight
Bourbon Whiskey
7. NET CONTENTS:
750 mL
8. NAME AND ADDRESS OF APPLICANT AS SHOWN ON PERMIT OR NOTICE
Copper Hill LLC
(include number)
12 Long Lane

Louisville, Kentucky
extra words here
8A. MAILING ADDRESS
same
"""
BOXES = "TYPE OF PRODUCT\n[ ] WINE [X] DISTILLED SPIRITS [ ] MALT BEVERAGE\nmade by NAME AND ADDRESS in a sentence\n"


def fields_of(spark, text):
    """The fields of a text among others, with an identifier that several share."""
    rows = [(1, "x", False), (1, text, True), (None, "", False), (1, None, False)]
    got = D.document_fields(spark.createDataFrame([(i, t, own) for i, t, own in rows], "doc_id long, text string, own boolean"), ["doc_id", "own"])
    assert got.count() == 4
    return {k: v for k, v in got.where("own").first().asDict().items() if k not in ("doc_id", "own")}


def test_sheet(spark):
    got = fields_of(spark, SHEET)
    assert got == {"brand_name": "Oak River", "class_type": "Straight Rye", "alcohol_content": "45%", "net_contents": "750 mL", "producer_info": "Oak River Co, Salem, OR 97301", "country_of_origin": "USA"}


def test_form(spark):
    got = fields_of(spark, FORM)
    assert got["brand_name"] == "Copper Hill"
    assert got["class_type"] == "Kentucky Straight Bourbon Whiskey"
    assert got["net_contents"] == "750 mL"
    assert got["producer_info"] == "Copper Hill LLC 12 Long Lane Louisville, Kentucky"
    assert got["country_of_origin"] is None and got["alcohol_content"] is None


def test_boxes_and_free_text(spark):
    got = fields_of(spark, BOXES)
    assert got["class_type"] == "Distilled Spirits" and got["producer_info"] is None
    got = fields_of(spark, "A fine bourbon whiskey at 45% ALC/VOL in 750 ML. Product of Canada")
    assert (got["brand_name"], got["class_type"], got["net_contents"], got["country_of_origin"]) == (None, "bourbon whiskey", "750 ML", "Canada")
    assert set(fields_of(spark, "").values()) == {None} == set(fields_of(spark, None).values())


ADDRESS = "Birch Vale Winery\n9 Orchard Row\nYakima, WA 98901\n"


@pytest.mark.parametrize(
    "text, want",
    [
        # A sheet with all labels before their values.
        ("Brand Name: Birch Vale\nClass and Type: Dry Gin\nAlcohol Content: 41% ALC/VOL\nNet Contents: 1 L\nName and Address of Producer: Birch Vale, Yakima, WA\nCountry of Origin: Canada\n", {"brand_name": "Birch Vale", "class_type": "Dry Gin", "alcohol_content": "41% ALC/VOL", "net_contents": "1 L", "producer_info": "Birch Vale, Yakima, WA", "country_of_origin": "Canada"}),
        # No labels at all.
        ("Our bourbon whiskey has 41% ALC/VOL (82 PROOF) in 1 L bottles.\nBottled by Birch Vale, Yakima, WA.\n", {"brand_name": None, "class_type": "bourbon whiskey", "alcohol_content": "41% ALC/VOL (82 PROOF)", "net_contents": "1 L", "producer_info": "Birch Vale, Yakima, WA"}),
        # Labels on lines of their own, blanks, a remark in brackets, instructions at the end.
        ("7. BRAND NAME\n\nBirch Vale\n\n8. CLASS AND TYPE OF PRODUCT\n\nRiesling\n\n9. NAME AND ADDRESS OF PRODUCER, BOTTLER, OR IMPORTER\n(Include the number)\n\n" + ADDRESS + "\n10. COUNTRY OF ORIGIN\n\nCanada\n\nINSTRUCTIONS: If bottled by\nthe producer, say so.\n", {"brand_name": "Birch Vale", "class_type": "Riesling", "producer_info": "Birch Vale Winery 9 Orchard Row Yakima, WA 98901", "country_of_origin": "Canada"}),
        # Words of producers in a sentence only.
        ("Fill in all of it. If bottled by someone other than the\nproducer, name the bottler.\n", {"brand_name": None}),
        # Noise behind values.
        ("CLASS AND TYPE OF PRODUCT: Malbec (Back Label)\n\nNAME AND ADDRESS OF PRODUCER: Birch Vale, 9 Orchard Row, Yakima, WA 98901 Rev. 2023-11\n", {"class_type": "Malbec", "producer_info": "Birch Vale, 9 Orchard Row, Yakima, WA 98901"}),
        # A remark in brackets between label and colon.
        ("8. NAME AND ADDRESS OF PRODUCER, BOTTLER, OR IMPORTER (Include the number): Birch Vale, Yakima, WA 98901\n", {"producer_info": "Birch Vale, Yakima, WA 98901"}),
        # The short heading.
        ("NAME AND ADDRESS\n\n" + ADDRESS, {"producer_info": "Birch Vale Winery 9 Orchard Row Yakima, WA 98901"}),
        # What follows an address is no heading that is known.
        ("NAME AND ADDRESS OF PRODUCER\n\n" + ADDRESS + "\nRegistry or Permit Number given by the Office\nXY-1\n", {"producer_info": "Birch Vale Winery 9 Orchard Row Yakima, WA 98901"}),
        # A designation on two lines.
        ("CLASS AND TYPE OF PRODUCT\n\nKentucky Straight\nBourbon Whiskey\n\n9. NAME AND ADDRESS OF PRODUCER\n\nBirch Vale, Yakima, WA\n", {"class_type": "Kentucky Straight Bourbon Whiskey", "producer_info": "Birch Vale, Yakima, WA"}),
        # Boxes.
        ("7. TYPE OF PRODUCT (Check one)\n\n[ ] WINE   [X] DISTILLED SPIRITS   [ ] MALT BEVERAGE\n\n8. BRAND NAME\n\nBirch Vale\n", {"class_type": "Distilled Spirits", "brand_name": "Birch Vale"}),
        ("BRAND NAME: Birch Vale (Front Label)\n", {"brand_name": "Birch Vale"}),
        # A sub-item is the next heading.
        ("8. NAME AND ADDRESS OF APPLICANT\n\n" + ADDRESS + "\n8A. MAILING ADDRESS (Only if different)\n\nPO Box 5\nYakima, WA 98902\n", {"producer_info": "Birch Vale Winery 9 Orchard Row Yakima, WA 98901"}),
        # The heading goes on in capitals; a state's full name.
        ("8. NAME AND ADDRESS OF APPLICANT AS SHOWN ON PERMIT OR BREWER'S NOTICE\n\nBirch Vale Winery\nYakima, Washington 98901 Rev. 2023-11\n", {"producer_info": "Birch Vale Winery Yakima, Washington 98901"}),
    ],
)
def test_thirteen_forms(spark, text, want):
    got = fields_of(spark, text)
    assert {k: got[k] for k in want} == want


def plain_value(text, patterns, most, address):
    """The labeled value of one field, line by line."""
    heads = re.compile("|".join(p for own in D.LABELS.values() for p in own), re.I)
    state = re.compile(r"\b\d{5}\b|\b(?:WA|OR)\b|(?i:\bFrance\b)")
    lines = (text or "").splitlines()

    def heading(x):
        letters = [c for c in x if c.isalpha()]
        return bool(re.match(r"\(?\d{1,2}[A-Za-z]?[.)]\s", x) or heads.search(x) or (len(letters) >= 4 and "".join(letters).isupper() and len(x) <= 80))

    def under(i):
        rest, out, gap, begun = [x.strip() for x in lines[i + 1 :]], [], 0, False
        for x in rest:
            if not x:
                gap += begun
                if gap == 2:
                    break
                continue
            begun, gap = True, 0
            if x[0] == "(" and x[-1] == ")":
                continue
            if heading(x):
                break
            out.append(x)
            if len(out) == most or (address and state.search(x)):
                break
        return " ".join(out)

    for p in patterns:
        for i, line in enumerate(lines):
            if hit := re.search(p, line, re.I):
                after = re.sub(r"\([^)]*\)", " ", line[hit.end() :])
                rest = after.strip(" \t:-.,")
                value = None
                if same := re.match(r"\s*[:\-]\s*(.+)", after, re.S):
                    value = same[1].strip()
                elif not rest or (any(c.isalpha() for c in rest) and all(c.isupper() for c in rest if c.isalpha())):
                    value = under(i)
                if value:
                    return value
    return None


def test_labeled_fields_of_random_forms(spark):
    dice = random.Random(8)
    pieces = ["BRAND NAME", "Brand Name: Oak", "brand - Elm", "BRAND NAME (all of it)", "BRAND NAME: (none)", "CLASS AND TYPE", "Class: Gin", "TYPE OF PRODUCT", "NET CONTENTS", "NET CONTENTS:", "8. NAME AND ADDRESS OF APPLICANT", "NAME & ADDRESS", "Name and Address of Producer/Bottler: Oak, Salem, OR", "COUNTRY OF ORIGIN", "ALCOHOL CONTENT", "40% ALC/VOL", "(a remark)", "(8. REMARK)", "", "", "  ", "Oak River", "12 Long Lane", "Salem, OR 97301", "CAPITALS ONLY", "made in France", "750 mL", "9. NEXT", "brandy of class"]
    texts = ["\n".join(dice.choice(pieces) for _ in range(dice.randint(1, 14))) for _ in range(400)]
    got = D.labeled_fields(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5), ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        for f, patterns in D.LABELS.items():
            most, address = D.UNDER.get(f, (1, False))
            assert r[f] == plain_value(texts[r["doc_id"]], patterns, most, address), (f, texts[r["doc_id"]])
    assert sum(r["producer_info"] is not None for r in got) > 50


@pytest.mark.parametrize(
    "text, producer",
    [("x\nBottled by Oak Co, Salem, OR\nmore", "Oak Co, Salem, OR"), ("Bottled by\nOak Co\n\n12 Lane\nSalem OR 97301\nmore", "Oak Co 12 Lane Salem OR 97301"), ("Imported by Oak\n\n\nSalem OR", "Oak"), ("Brewed by: Oak\nGOVERNMENT WARNING x", "Oak"), ("Bottled by", ""), ("none", None)],
)
def test_producer_lines(spark, text, producer):
    assert spark.createDataFrame([(text,)], "t string").select(D.extract_producer(F.col("t")).alias("p")).first()["p"] == producer


@pytest.mark.parametrize("country, producer", [("PRODUCT OF Scotland", "Nobody"), ("Domestic", "Nobody Domestic GOVERNMENT WARNING: drink less {box}")])
@pytest.mark.parametrize("box", ["[ ] WINE  [X] DISTILLED  SPIRITS [ ] MALT BEVERAGE", "x: wine", "[] WINE"])
def test_producer_without_an_address_end(spark, country, producer, box):
    text = f"spring pale widget\nRed Wine\n80 PROOF\n750 mL\nProduced and Bottled By: Nobody\n{country}\nGOVERNMENT\nWARNING: drink less\n{box}"
    assert spark.createDataFrame([(text,)], "t string").select(D.extract_producer(F.col("t")).alias("p")).first()["p"] == producer.format(box=box)


def words(spark, rows):
    """(text, top, height, block) as words, one a line."""
    made = [(1, i, t, "90", 10, top, 50, h, b, 1, i) for i, (t, top, h, b) in enumerate(rows)]
    return spark.createDataFrame(made, "photo_id long, word_seq int, text string, conf string, left int, top int, width int, height int, block_num int, par_num int, line_num int")


def test_layout(spark):
    df = words(spark, [("OLD", 0, 40, 1), ("RIVER", 45, 50, 2), ("small", 100, 10, 2), ("Bottled by Oak Co", 200, 10, 3), ("Salem, OR 97301", 212, 10, 3), ("fine print", 224, 10, 3), ("  ", 300, 10, 3)])
    lines = group_lines(confident_words(df.withColumn("conf", F.when(F.col("text") == "small", "x").otherwise(F.col("conf")))))
    assert lines.count() == 5
    assert brand_names(lines).first()["brand_name"] == "OLD RIVER"
    assert producers(lines).first()["producer_info"] == "Oak Co Salem, OR 97301"
    start = lines.where("text = 'OLD'").select("photo_id", "first_seq")
    assert [r["text"] for r in cluster(lines, start, 6, 1.8).orderBy("step").collect()] == ["OLD", "RIVER"]
    assert cluster(lines, start, 1, 1.8).count() == 1


def test_docx(spark, tmp_path):
    def docx(*paragraphs):
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        return out.getvalue()

    assert docx_text(docx("one", "", "two")) == "one\n\ntwo"
    (tmp_path / "a.DOCX").write_bytes(docx("Brand Name: Oak"))
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in read_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.DOCX"] == ("Brand Name: Oak", None)
    assert got["b.txt"][1] == "Unsupported document type: .txt" and got["c.docx"][0] is None and got["c.docx"][1]


class StubPage:
    def __init__(self, text, images, broken=False):
        self.text, self.own, self.broken = text, images, broken

    def extract_text(self):
        return self.text

    @property
    def images(self):
        if self.broken:
            raise KeyError("/XObject")
        return [type("Image", (), {"data": i})() for i in self.own]


def stub_reader(**how):
    """A PDF library with the interface that the source uses."""

    class PdfReader:
        def __init__(self, stream):
            raw = stream.read()
            if raw != b"%PDF":
                raise ValueError("no PDF header")
            self.is_encrypted = how.get("locked", False)
            self.pages = how["pages"]

        def decrypt(self, password):
            assert password == ""
            return how.get("opens", 0)

    module = types.ModuleType("pypdf")
    module.PdfReader = PdfReader
    return module


def test_pdf(monkeypatch):
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    pages = [StubPage("Brand Name: Oak", [png(300, 200), png(20, 20), b"odd"]), StubPage(None, [png(9, 9)], broken=True), StubPage("end", [png(151, 150)])]
    monkeypatch.setitem(sys.modules, "pypdf", stub_reader(pages=pages))
    assert files.pdf_text(b"%PDF") == "Brand Name: Oak\n\nend"
    assert [files.image_size(i) for i in files.pdf_images(b"%PDF")] == [(300, 200), (20, 20), None, (151, 150)]
    rows = lambda kind, content: pd.DataFrame([("a", kind, content)], columns=["path", "kind", "content"])
    assert next(files._texts(iter([rows("pdf", b"%PDF")]))).values.tolist() == [["a", "Brand Name: Oak\n\nend", None]]
    assert next(files._texts(iter([rows("pdf", b"broken")]))).values.tolist() == [["a", None, "no PDF header"]]
    found = next(files._images(iter([rows("pdf", b"%PDF")])))
    assert found[["number", "width", "height"]].values.tolist() == [[0, 300, 200], [1, 20, 20], [3, 151, 150]]
    assert next(files._images(iter([rows("pdf", b"broken")]))).empty
    # An empty password may open a locked file.
    monkeypatch.setitem(sys.modules, "pypdf", stub_reader(pages=pages, locked=True, opens=1))
    assert files.pdf_text(b"%PDF").startswith("Brand Name")
    monkeypatch.setitem(sys.modules, "pypdf", stub_reader(pages=pages, locked=True))
    with pytest.raises(ValueError, match="locked"):
        files.pdf_text(b"%PDF")
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(ValueError, match="needs pypdf"):
        files.pdf_text(b"%PDF")


def test_folders(spark, tmp_path):
    """Only files of known kinds and of a size that is allowed are opened; the scan gets the limit."""
    below = tmp_path / "x.docx.d"
    below.mkdir()
    (tmp_path / "a.Docx").write_bytes(b"?" * 5)
    (below / "b.docx").write_bytes(b"?" * 50)
    (below / "c.txt").write_bytes(b"x")
    (below / "none").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in read_documents(spark, f"file://{tmp_path}", most_bytes=20).collect()}
    assert got["b.docx"] == "File is larger than 20 bytes" and got["c.txt"] == "Unsupported document type: .txt" and got["none"] == "Unsupported document type: ." and "zip" in got["a.Docx"] and len(got) == 4
    plan = files.document_files(spark, f"file://{tmp_path}", most_bytes=20)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*LessThanOrEqual\(length,20\)", plan)
    assert files.document_files(spark, f"file://{tmp_path}").count() == 2
    # Errors of what isn't opened come from a scan without contents.
    whole = read_documents(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert sum("content:binary" in line for line in whole.split("\n") if "ReadSchema" in line) == 1
    assert files.read_images(spark, f"file://{tmp_path}").collect() == []


def test_heading_bold(spark):
    px = np.full((100, 700), 255, np.uint8)
    rows, at = [], 0
    for k, text in enumerate(["GOVERNMENT", "WARNING:", *["body"] * 6]):
        px[10:20, at : at + (8 if k < 2 else 4) * 3 : 3 if k >= 2 else 1] = 0
        rows.append((1, k, text, at, 5, 40, 20, 1))
        at += 60
    df = spark.createDataFrame(rows, "photo_id long, word_seq int, text string, left int, top int, width int, height int, block_num int")
    tiles = spark.createDataFrame([(1, 700, 100, bytearray(px.tobytes()))], "photo_id long, w int, h int, px binary")
    assert heading_bold(word_density(df, tiles)).first()["bold"] is True
    assert heading_bold(word_density(df.where("word_seq < 5"), tiles)).first()["bold"] is None
    assert heading_bold(word_density(df.where("word_seq > 1"), tiles)).first()["bold"] is None
    assert ink_share(np.zeros((0, 0), np.uint8)) is None


def test_store(spark):
    empty = spark.createDataFrame([], S.PRODUCT)
    fields = ", ".join(f"{f} string" for f in S.REFERENCE_FIELDS)
    edit = lambda *rows: spark.createDataFrame([(a, q, i, n, b, *[None] * 5) for a, q, i, n, b in rows], f"action string, seq long, id long, name string, {fields}")
    one = S.next_versions(empty, edit(("insert", 1, None, " Oak ", " "), ("insert", 2, None, None, "x"), ("insert", 3, None, "ash", "b")), 1, "t1", 0)
    assert [(r["id"], r["name"], r["brand_name"]) for r in S.by_name(S.latest(one)).collect()] == [(2, "ash", "b"), (1, "Oak", None)]
    two = S.next_versions(one, edit(("update", 1, 2, None, "c"), ("delete", 2, 1, None, None), ("delete", 3, 9, None, None), ("insert", 4, None, "elm", None)), 2, "t2", 2)
    now = S.latest(one.unionByName(two)).collect()
    assert sorted((r["id"], r["name"], r["brand_name"], r["created_at"], r["updated_at"]) for r in now if r["id"] == 2) == [(2, "ash", "c", "t1", "t2")]
    assert {r["id"] for r in now} == {2, 3}
