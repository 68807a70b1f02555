"""Decisions worked out where corrections touch equal those of a full run."""

import random

import pytest
from pyspark.sql import functions as F

from labelassay.config import FIELDS, WARNING
from labelassay.operators import compare as C
from labelassay.operators import redecide as R
from labelassay.operators import store as S
from labelassay.operators import verdict as V

VALUES = {
    "brand_name": ["Oak", "OAK ", "Elm", None, " "],
    "class_type": ["Gin", "Vodka", None],
    "alcohol_content": ["45%", "90 PROOF", "12%", None],
    "net_contents": ["750 mL", "0.75 L", "1 L", ""],
    "producer_info": ["Oak Co, Salem, OR", "Elm Co, Napa, CA", None],
    "country_of_origin": ["France", "Frnce", None],
    "health_warning_text": [WARNING, WARNING[:90], "drink less", None],
}
LONG = "run_id long, index int, field_key string, extracted string, expected string"
DECIDED = ["run_id", "field_key", *R.DECIDED]


@pytest.fixture(scope="module")
def run(spark):
    dice = random.Random(4)
    rows = [(r, i, f, dice.choice(v), dice.choice(v)) for r in range(30) for i in range(dice.randint(1, 4)) for f, v in VALUES.items()]
    edits = [(r, i, f, dice.choice(VALUES[f]), x) for r, i, f, _, x in rows if r < 8 and dice.random() < 0.3]
    changes = [(r, f, dice.choice(["match", "mismatch", "", None])) for r in range(4, 12) for f in FIELDS if dice.random() < 0.4]
    return rows, edits, changes


def compared(spark, rows):
    long = spark.createDataFrame(rows, LONG).withColumn("broad", F.lit(False))
    return C.compare_long(long, ["run_id", "index"])


def full(spark, rows, overrides):
    """Every group anew; ``overrides``: those in force."""
    summary = V.group_summary(compared(spark, rows), ["run_id"], readings=False)
    over = spark.createDataFrame([(*k, v) for k, v in overrides.items()], "run_id long, field_key string, override string")
    return sorted(map(tuple, V.apply_overrides(summary, over, ["run_id", "field_key"]).select(DECIDED).collect()), key=repr)


def test_equal_to_a_full_run(spark, run):
    rows, edits, changes = run
    stored = compared(spark, rows)
    first = {(5, "brand_name"): "match", (20, "class_type"): "mismatch", (1, "net_contents"): "match"}
    decided = V.apply_overrides(V.group_summary(stored, ["run_id"], readings=False), spark.createDataFrame([(*k, v) for k, v in first.items()], "run_id long, field_key string, override string"), ["run_id", "field_key"]).select(DECIDED)
    edited = spark.createDataFrame(edits, LONG)
    new = R.redecided(stored, decided, edited, spark.createDataFrame(changes, "run_id long, field_key string, override string"), ["run_id"])
    got = sorted(map(tuple, R.with_new(decided, new, ["run_id"]).select(DECIDED).collect()), key=repr)

    blank = lambda v: None if v is None or not v.strip() else v.strip()
    after = {(r, i, f): (blank(x), blank(e)) for r, i, f, x, e in edits}
    rows_after = [(r, i, f, *after.get((r, i, f), (x, e))) for r, i, f, x, e in rows]
    force = dict(first)
    for r, f, o in changes:
        force.pop((r, f), None)
        if o:
            force[r, f] = o
    assert got == full(spark, rows_after, force)
    touched = {(r, f) for r, _, f, _, _ in edits} | {(r, f) for r, f, _ in changes}
    assert {(r["run_id"], r["field_key"]) for r in new.collect()} == touched

    headers = {r["run_id"]: tuple(r) for r in R.headers_of(decided, new, ["run_id"]).collect()}
    want = {r["run_id"]: tuple(r) for r in S.saved_headers(R.with_new(decided, new, ["run_id"]), ["run_id"]).collect()}
    assert headers == {r: want[r] for r in {r for r, _ in touched}}


def test_no_changes(spark, run):
    stored = compared(spark, run[0])
    decided = R.undecided(V.group_summary(stored, ["run_id"], readings=False))
    none = spark.createDataFrame([], LONG), spark.createDataFrame([], "run_id long, field_key string, override string")
    assert R.redecided(stored, decided, *none, ["run_id"]).collect() == []


def test_groups_that_nothing_touches_are_left_out_first(spark, run):
    """The stored comparisons meet the list of changes before any other operator."""
    rows, edits, _ = run
    stored = compared(spark, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    plan = R.edited_comparisons(stored, spark.createDataFrame(edits, LONG), ["run_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.index("LeftAnti") < plan.index("LeftSemi")
