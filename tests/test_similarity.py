"""The similarity kernel against textbook tables, and the best match against a plain scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelassay.config import REFERENCE_FIELDS, Thresholds
from labelassay.functions import similarity as S
from labelassay.operators import best as B
from labelassay.operators import compare as C
from labelassay.operators import match as M


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def table_window(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    out = 0.0
    for x, y in [(a, b), (b, a)][: 1 + (len(a) == len(b))]:
        for s in range(1 - len(x), len(y)):
            part = y[max(0, s) : s + len(x)]
            out = max(out, 200.0 * table_lcs(x, part) / (len(x) + len(part)))
    return out


@pytest.fixture(scope="module")
def words():
    dice = random.Random(5)
    made = lambda most, letters: "".join(dice.choice(letters) for _ in range(dice.randint(0, most)))
    return [made(most, letters) for most in (4, 30, 63, 64, 65, 130) for letters in ("abc de", "éİbcß😀", "\x00ab", "abcdefghijklmnop ") for _ in range(12)]


def test_subsequences_of_many_pairs(words):
    others = words[::-1]
    assert S.lcs_lengths(words, others).tolist() == [table_lcs(a, b) for a, b in zip(words, others)]
    exact = S.ratios(words, others)
    assert (S.ratio_bounds(words, others) >= exact - 1e-9).all()
    for least in (0, 40, 85, 100):
        assert (S.reach(words, others, least) == (exact >= least)).all()
    assert S.ratios([], []).tolist() == [] and S.reach([], [], 5).tolist() == []


def test_best_windows(words):
    short = [w for w in words if len(w) < 40]
    for a, b in zip(short, short[::-1]):
        assert S.best_window(a, b) == table_window(a, b)
    assert 0 < S.best_window("government warning drink", "goverment waming: do not drink") < 100
    assert round(S.best_window("brand 12", "pale ale brand"), 6) == round(table_window("brand 12", "pale ale brand"), 6)


def test_few_windows_are_tried(monkeypatch):
    tried = []
    plain = S.lcs
    monkeypatch.setattr(S, "lcs", lambda *x: tried.append(1) or plain(*x))
    text = "women should not drink alcoholic beverages during pregnancy because of the risk of birth defects " * 3
    assert S.best_window("consumption of alcoholc beverages impairs", text + "consumption of alcoholic beverages impairs your ability" + text) > 95
    assert len(tried) < 40  # of some 700


# ---- best matches ----------------------------------------------------------------------


def made_rows(dice, n, first):
    brands = [f"{a} {b}" for a in ("Oak", "Old", "Pine", "Silver") for b in ("River", "Rivers", "Hill", "Lake Co")]
    pick = {
        "brand_name": [*brands, None, " ", "", "OAK  river!"],
        "class_type": ["Vodka", "Red Wine", "Pale Ale", "Pale Ail", None, "Kentucky Straight Bourbon Whiskey"],
        "alcohol_content": ["45% ALC/VOL", "45.2%", "90 PROOF", "12.5%", "12.8%", None, "strong", "stronge", ""],
        "net_contents": ["750 mL", "0.75 L", "700 mL", "25.4 FL OZ", None, "big", "0 mL"],
        "producer_info": ["Old River Distilling Co, Frankfort, KY 40601", "Old River Distilling Company Frankfort Kentucky", "Hill Cellars, 12 Main Street, Napa, California", "Hill Cellars Napa, CA 94558", None, "Acme, CO", "Oak Hill Winery, Salem, OR"],
        "country_of_origin": ["France", "Scotland", "Scotlnd", None],
    }
    return [(first + i, dice.choice([f"n{i % 9}", f"N{i % 9}", None]), *(dice.choice(pick[f]) for f in REFERENCE_FIELDS)) for i in range(n)]


SCHEMA = "id long, name string, " + ", ".join(f"{f} string" for f in REFERENCE_FIELDS)


def plain_best(spark, readings, products):
    """Every reading with every product, by the columns of the comparison."""
    pairs = readings.select("photo_id", *(F.col(f).alias(f"x_{f}") for f in REFERENCE_FIELDS)).join(products)
    for f in REFERENCE_FIELDS:
        pairs = pairs.withColumn(f"c_{f}", C.compare_field(f, F.col(f"x_{f}"), F.col(f), C.text_ratio(F.col(f"x_{f}"), F.col(f))))
    best = {}
    for r in pairs.collect():
        matched = sum(r[f"c_{f}"]["status"] == "match" for f in REFERENCE_FIELDS)
        score = 0.0
        for f in REFERENCE_FIELDS:
            score += r[f"c_{f}"]["score"] or 0.0
        name = r["name"]
        place = (name is not None, "".join(c.lower() if "A" <= c <= "Z" else c for c in name or ""), r["id"])
        key = (-matched, -score, place)
        best[r["photo_id"]] = min(best.get(r["photo_id"], key), key)
    return {p: (k[2][2], -k[0], round(-k[1], 6)) if k[0] < 0 else (None, 0, 0.0) for p, k in best.items()}


@pytest.mark.parametrize("seed, broadcast", [(1, True), (2, False)])
def test_best_matches(spark, seed, broadcast, monkeypatch):
    """Small blocks and chunks, broadcast or shuffled; many ties."""
    monkeypatch.setattr(B, "BLOCK", 30)
    monkeypatch.setattr(M, "best_of_kinds", lambda k, c, limits: B.best_of_kinds(k, c, limits, 30, 5, 1 << 20 if broadcast else 0))
    dice = random.Random(seed)
    products = spark.createDataFrame(made_rows(dice, 90, 1), SCHEMA)
    rows = made_rows(dice, 50, 100) + [(200, None, *([None] * 6)), (201, None, *([" "] * 6)), (202, None, "nothing", "like", "it", "at", "all", "here")]
    readings = spark.createDataFrame(rows + rows[:3], SCHEMA).withColumnRenamed("id", "photo_id").drop("name").repartition(3)
    want = plain_best(spark, readings, products)
    got = M.best_matches(readings, products).collect()
    assert len(got) == len(rows) + 3
    assert {r["photo_id"]: (r["product_id"], r["matched_count"], round(r["score_sum"], 6)) for r in got} == want
    assert len({w[1] for w in want.values()}) > 3


def test_best_matches_without_products(spark):
    none = spark.createDataFrame([], SCHEMA)
    readings = spark.createDataFrame([(1, None, "Oak", *([None] * 5))], SCHEMA).withColumnRenamed("id", "photo_id")
    assert [tuple(r) for r in M.best_matches(readings, none).collect()] == [(1, None, 0, 0.0)]
    assert M.best_matches(none.withColumnRenamed("id", "photo_id"), none).collect() == []


def test_bounds_leave_most_pairs_alone(monkeypatch):
    """Of 2,000 references few have to be compared with a reading that one of them fits."""
    import pyarrow as pa

    def values(texts):
        n = len(texts)
        return B.Values(pa.table({"f_text": texts, "f_blank": [False] * n, "f_number": pa.nulls(n, pa.float64()), "f_state": pa.nulls(n, pa.string()), "f_words": pa.nulls(n, pa.list_(pa.string()))}), "f")

    dice = random.Random(7)
    names = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20)) for _ in range(2000)]
    es = {f: values(names) for f in REFERENCE_FIELDS}
    xs = {f: values([names[77]]) for f in REFERENCE_FIELDS}
    asked = []
    monkeypatch.setattr(B, "ratios", lambda a, b: asked.extend(a) or S.ratios(a, b))
    assert B.best_in_block(0, xs, es, Thresholds()) == (6, 600.0, 77)
    assert len(asked) < 200
    assert np.isfinite(es["brand_name"].letters).all()
