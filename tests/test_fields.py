import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelassay.config import WARNING
from labelassay.functions import extract as X
from labelassay.functions import text as T
from labelassay.functions.similarity import best_window, indel_ratio, partial_ratio, ratio_reaches, token_sort_ratio
from labelassay.operators import compare as C
from labelassay.operators import verdict as V


def value(spark, column, **values):
    """A column over one row of strings."""
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


def of(spark, f, text):
    return value(spark, f(F.col("x")), x=text)


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(max(row[j - 1], before[j], before[j - 1] + (x == y)))
    return row[-1]


@pytest.mark.parametrize("text, ml", [("750mL", 750), ("750 ML", 750), ("0.75 L", 750), ("25.4 FL. OZ.", 25.4 * 29.5735), ("12 lbs", 12000), ("1,750 mL", 750), ("none", None), (None, None)])
def test_volume(spark, text, ml):
    got = of(spark, T.volume_ml, text)
    assert got == ml if ml is None else abs(got - ml) < 1e-6


@pytest.mark.parametrize("text, percent, proof", [("45% ALC/VOL", 45, 90), ("90 PROOF", 45, 90), ("40% (81 proof)", 40, 81), ("1000%", 0, 0), ("strong", None, None)])
def test_strength(spark, text, percent, proof):
    assert of(spark, T.abv_percent, text) == percent
    assert of(spark, T.abv_proof, text) == proof


@pytest.mark.parametrize(
    "text, field",
    [("Alc. 12.5% by Vol", "12.5% ALC/VOL"), ("ALC./VOL. 45% (90 PROOF)", "45% ALC/VOL (90 PROOF)"), ("45% Alc/Vol", "45% ALC/VOL"), ("80 PROOF", "80 PROOF"), ("45%", None), ("", None)],
)
def test_extract_abv(spark, text, field):
    assert of(spark, X.extract_abv, text) == field


def test_other_fields(spark):
    assert of(spark, X.extract_net_contents, "net 1.75 Liters") == "1.75 Liters"
    assert of(spark, X.extract_net_contents, "12 lbs") is None
    assert of(spark, X.extract_country, "Product of France\nRed") == "France"
    assert of(spark, X.extract_country, "PRODUCT OF  New Zealand .") == "New Zealand"
    assert of(spark, X.extract_warning, "x Government\n Warning: a  b") == "Government Warning: a b"
    assert of(spark, X.heading_all_caps, WARNING) is True
    assert of(spark, X.heading_all_caps, "Government warning") is False
    assert of(spark, X.heading_all_caps, "none") is None
    assert of(spark, X.extract_class_type, "A KENTUCKY  STRAIGHT\nBourbon Whiskey of note") == "KENTUCKY STRAIGHT Bourbon Whiskey"
    assert of(spark, X.extract_class_type, "for sale") == "ale"
    assert of(spark, X.extract_class_type, "nothing") is None
    assert of(spark, X.extract_checkbox_class, "[ ] WINE [X] DISTILLED  SPIRITS") == "Distilled Spirits"
    assert of(spark, X.extract_checkbox_class, "[ X ] WINE") is None
    assert of(spark, X.strip_trailing_noise, "Old Oak (Front Label)") == "Old Oak"
    assert of(spark, X.strip_trailing_noise, "Riverside") == "River"


def test_addresses(spark):
    assert of(spark, T.state_of, "Frankfort, Kentucky") == "KY"
    assert of(spark, T.state_of, "in new   york") == "NY"
    assert of(spark, T.state_of, "Texas, OK") == "OK"
    assert of(spark, T.state_of, "nowhere") is None
    assert of(spark, T.normalize_states, "West Virginia and Virginia") == "WV and VA"
    assert of(spark, T.finalize_producer, "Distilled and Bottled by: Oak Co, Salem, OR 97301-1234, see back") == "Oak Co, Salem, OR 97301-1234"
    assert of(spark, T.finalize_producer, "no address here") == "no address here"
    assert sorted(of(spark, T.producer_keywords, "The Oak Co., 12 Main Street, Salem, Oregon")) == ["main", "oak", "or", "salem", "the"]
    assert of(spark, T.broad_category, "Bourbon Whiskey") == "distilled spirits"
    assert of(spark, T.broad_category, "Original") is None


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="abc é", max_size=8), st.text(alphabet="abc é", max_size=8))
def test_subsequences(spark, a, b):
    total = len(a) + len(b)
    want = 100.0 if not total else 200.0 * lcs_table(a, b) / total
    assert value(spark, indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_ratios(spark):
    ratio = lambda a, b: value(spark, token_sort_ratio(F.col("a"), F.col("b")), a=a, b=b)
    assert ratio("b  a", "a b") == 100
    assert ratio("", "") == 100 and ratio("a", "") == 0
    assert best_window("abc", "xxabcxx") == 100 and best_window("", "a") == 0 and best_window("", "") == 100
    assert best_window("abcd", "bcde") == pytest.approx(600 / 7)
    assert value(spark, partial_ratio(F.col("a"), F.col("b")), a="abc", b=None) == 0


def compare(spark, field, x, e, **more):
    return tuple(value(spark, C.compare_field(field, F.col("x"), F.col("e"), C.text_ratio(F.col("x"), F.col("e")), **more), x=x, e=e))


@pytest.mark.parametrize("field, blank", [("brand_name", "match"), ("alcohol_content", "not_found"), ("net_contents", "not_found")])
def test_blanks(spark, field, blank):
    assert compare(spark, field, " ", None) == (blank, None)
    assert compare(spark, field, None, "x") == ("not_found", None)
    assert compare(spark, field, "x", "") == ("match", None)


def test_comparisons(spark):
    assert compare(spark, "brand_name", "OAK  river", "Oak River") == ("match", 100.0)
    assert compare(spark, "alcohol_content", "45%", "90 PROOF") == ("match", 100.0)
    assert compare(spark, "alcohol_content", "12.8%", "12.5%")[0] == "mismatch"  # in doubles, more than 0.3
    assert compare(spark, "net_contents", "25.4 FL OZ", "750 mL")[0] == "match"
    assert compare(spark, "net_contents", "1 L", "0 mL") == ("mismatch", 0.0)
    assert compare(spark, "class_type", "Bourbon", "Distilled Spirits")[0] == "mismatch"
    assert compare(spark, "class_type", "Bourbon", "Distilled Spirits", broad_class=True)[0] == "match"
    assert compare(spark, "producer_info", "Old River Distilling, Frankfort, Kentucky", "Old River Distilling LLC, 1 Long Lane, Frankfort KY 40601")[0] == "match"
    assert compare(spark, "producer_info", "Acme, CO", "Acme Brewing, Denver, CO")[0] == "mismatch"


def test_verdicts(spark):
    rows = [
        (1, 0, "700 mL", "mismatch"), (1, 1, "750 mL", "match"),
        (2, 0, None, "not_found"), (2, 1, " ", "not_found"),
        (3, 0, "1 L", "mismatch"), (3, 1, "1000 mL", "mismatch"),
        (4, 0, "1 L", "mismatch"), (4, 1, "2 L", "mismatch"),
    ]
    df = spark.createDataFrame([(g, i, x, "750 mL", s) for g, i, x, s in rows], "g int, index int, extracted string, expected string, status string")
    got = {r["g"]: tuple(r)[1:5] for r in V.aggregate_field(df, "net_contents", ["g"]).collect()}
    assert got == {1: ("match", "750 mL", 1, 0), 2: ("not_found", None, None, 0), 3: ("mismatch", "1 L", 0, 0), 4: ("disagreement", None, None, 2)}
    over = spark.createDataFrame([(4, "match"), (1, "wrong")], "g int, override string")
    done = {r["g"]: (r["status"], r["computed_status"], r["manual_override"]) for r in V.apply_overrides(V.aggregate_field(df, "net_contents", ["g"]), over, ["g"]).collect()}
    assert done[4] == ("match", "disagreement", True) and done[1] == ("match", None, False)
