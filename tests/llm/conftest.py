import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = "at long, key long, digest string, component long, shard int, line long, score double, kept boolean, file string, row long"


@pytest.fixture(scope="session")
def word():
    dice = random.Random(4)
    made = ["".join(dice.choice(["ba", "re", "ti", "on", "es", "lu", "mo"]) for _ in range(dice.randint(1, 4))) for _ in range(400)]
    return lambda r=dice: r.choice(made)


@pytest.fixture(scope="session")
def texts(word):
    """Prose of many lengths with exact copies, near copies, blank and odd texts."""
    dice = random.Random(9)
    out = [" ".join(word(dice) for _ in range(dice.choice([3, 8, 40, 120]))) + "." for _ in range(60)]
    out += [out[3], out[3], out[7], out[30].upper()]
    for i in (10, 11, 12, 13, 14):
        own = out[i].split(" ")
        for k in range(3):
            new = own.copy()
            new[dice.randrange(len(new))] = word(dice)
            out.append(" ".join(new) + ("\n" + out[i] if k == 2 else ""))
    out += [None, None, "", "", " ", "\n\n", "1234 !!", "one", "one  two\tthree \n four", "<|endoftext|> x <|endoftext|>", "é ü ñ 漢字 😀 " * 5, " ".join(word(dice) for _ in range(30_000))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Whole ids from 0, a repeated row, a null id and columns with clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 5 == 0 else "s", None) for i, t in enumerate(texts)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as `{name}`")
    return df.repartition(3, "doc_id")


@pytest.fixture(scope="session")
def with_null_id(spark, docs):
    return docs.unionByName(spark.createDataFrame([(None, "one", None, None, None), (None, None, None, None, None)], SCHEMA), allowMissingColumns=True)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
