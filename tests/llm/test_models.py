import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelassay.llm.common import bloom_bits, hash_of_longs
from labelassay.llm.decontaminate import BLOCK, answer_of, drop_leaks, find_leaks, lcs, word_codes
from labelassay.llm.language_id import family, features, fit_svm, identify, keep_identified
from labelassay.llm.queries import URL_RULES
from labelassay.llm.quality_cnn import CHUNK, FILTERS, PAD, STEP, WIDTH, QualityModel, chunks, fit, score_quality, slopes_of
from labelassay.llm.shingles import NOT_ALNUM, whole_hashes, word_hashes
from labelassay.llm.url_filter import SEED_WORDS, best_split, judge_urls, known_parts, segment


# ---- urls ---------------------------------------------------------------------------------


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def plain_rule(host, path, rules):
    fits = [(len(h) + len(p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = [
        "https://Blog.Example.ORG/es/1?x=http://a.com/de/", "http://example.org/en/17.html", "http://a.example.org/en/2", "https://x.com/fr/9#t", "http://x.com/de/", "http://notcom/de/",
        "http://casino-win.net/en/1", "http://freecasino.net/", "http://oakriver.net/en/2", "http://oak.net", "ftp://h?x/y", "http://#a", "no scheme", "", None, "a://b://c/d", "http://é.net/ü\n/x", "http://" + "long" * 5000 + ".net/",
    ]
    html = "<html><script>var casino=1;</script><p>oak river oak river free water</p></html>"
    urls += [f"http://oak{i % 7}.org/en/{i}" for i in range(40)] + [f"http://casino-win{i}.com/de/{i}" for i in range(30)] + ["http://casino-win.net/en/3"]
    rows = [(i, u, html if i % 2 else None) for i, u in enumerate(urls)] + [(3, urls[3], html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as score", "3 as rule")
    got = judge_urls(pages.drop("host", "score", "rule").join(pages.select("page_id", "host").distinct(), "page_id"), URL_RULES).collect()
    assert len(got) == len(rows)
    for g in got:
        host, path = plain_host_path(urls[g["page_id"]])
        rule, action = plain_rule(host, path, URL_RULES)
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule)
        assert g["verdict"] == action if action else g["verdict"] in ("allow", "block")
        assert 0 <= g["score"] <= 1
    verdict = {urls[g["page_id"]]: g["verdict"] for g in got}
    assert verdict["http://casino-win.net/en/1"] == verdict["http://freecasino.net/"] == "block"
    assert verdict["http://oakriver.net/en/2"] == verdict["http://oak.net"] == "allow"
    assert judge_urls(pages.limit(0), URL_RULES).collect() == []
    assert {g["rule"] for g in judge_urls(pages, []).collect()} == {None}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=9))
def test_segmenting_is_the_best_of_all_splits(name):
    counts = {"a": 50, "ab": 20, "bc": 10, "abc": 4, "cd": 9, "dab": 2}
    total = sum(counts.values())
    costs = {w: np.log(total / n) for w, n in counts.items()}

    def cost(word):
        return costs.get(word, np.log(total / 10) + 2.302585 * len(word))

    def best(text):
        return min((cost(text[:i]) + (best(text[i:]) if text[i:] else 0) for i in range(1, len(text) + 1)), default=0)

    got = best_split(name, costs, np.log(total / 10), 3)
    assert "".join(got) == name
    assert sum(map(cost, got)) <= best(name) + 1e-9


def test_parts_of_names_are_those_that_words_may_be(spark):
    """Against all substrings; a name and a page word of 20,000 letters cost no more than their lengths."""
    dice = random.Random(3)
    words = ["oak", "river", "ü", "éa", "a", *("".join(dice.choice("aorkév") for _ in range(dice.randint(1, 9))) for _ in range(60)), "v" * 20_000]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    ids = spark.createDataFrame([(int(h),) for h in whole_hashes(words).view(np.int64)], "id long")
    assert [r[0] for r in ids.select(F.xxhash64("id")).collect()] == hash_of_longs(whole_hashes(words).view(np.int64)).tolist()
    bits, lengths = bloom_bits(ids, len(words)), np.array(sorted({len(w.encode()) for w in words}))
    for name in ["oakriver", "x", "aüéa", *("".join(dice.choice("aorkév") for _ in range(60)) for _ in range(5))]:
        found = known_parts(name, lengths, bits)
        inside = {name[i:j] for i in range(len(name)) for j in range(i + 1, len(name) + 1)}
        assert inside & {*words} <= {*found} <= inside and len(found) == len({*found})
    long = "v" * 19_990 + "oak" + "river" * 4
    began = time.monotonic()
    assert "oak" in known_parts(long, lengths, bits) and "v" * 20_000 in known_parts("v" * 20_001, lengths, bits)
    names = spark.createDataFrame([(long,), ("v" * 20_001,), ("oakriver",)], "name string")
    got = {r["name"]: r["parts"] for r in segment(names, frame.groupBy("word").count().withColumnRenamed("count", "n")).collect()}
    assert got["oakriver"] == ["oak", "river"] and "".join(got[long]) == long and got[long][-4:] == ["river"] * 4
    assert time.monotonic() - began < 60


def test_url_scores_are_naive_bayes(spark):
    """Against plain counting; names are split by the words of the pages."""
    rows = [(0, "http://oakriver.org/good/7", "oak river good oak river"), (1, "http://example.org/es/pill", "pill"), (2, "http://oak.net/good", None), (3, "http://pillriver.net/es/9", "river"), (4, "http://zz.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    tokens = [["h:oak", "h:river", "h:org", "p:good", "p:<num>"], ["h:example", "h:org", "p:es", "p:pill"], ["h:oak", "h:net", "p:good"], ["h:pill", "h:river", "h:net", "p:es", "p:<num>"], ["h:zz", "h:net"]]
    block = {m + w: 1 for w in SEED_WORDS for m in ("h:", "p:")}
    allow = dict.fromkeys(tokens[0], 1)
    for t in tokens[1]:
        block[t] = block.get(t, 0) + 1
    kinds = len({*block, *allow})
    weigh = lambda t: np.log((block.get(t, 0) + 0.5) / (sum(block.values()) + 0.5 * (kinds + 1))) - np.log((allow.get(t, 0) + 0.5) / (sum(allow.values()) + 0.5 * (kinds + 1)))
    got = {g["page_id"]: g["score"] for g in judge_urls(pages, URL_RULES).collect()}
    for i, own in enumerate(tokens):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-sum(weigh(t) for t in own if t in block or t in allow))))


def test_urls_on_held_out_hosts(spark):
    """Learned from the rules' own verdicts on some hosts, tried on others."""
    dice = random.Random(6)
    rows = []
    for i in range(400):
        bad = i % 2
        path = "/de/" if bad else "/fr/"
        words = ["slots", "jackpots", "spins"] if bad else ["garden", "history", "music"]
        rows.append((i, f"http://{dice.choice(words)}{dice.choice(words)}{i % 50}.com{path}{dice.choice(words)}", " ".join(words)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    taught = lambda host: F.pmod(F.xxhash64(host), F.lit(5)) > 0
    got = judge_urls(pages, URL_RULES, taught).select("score", "verdict", taught(F.col("host")).alias("taught")).where("NOT taught").collect()
    assert len(got) > 40 and np.mean([(g["score"] >= 0.5) == (g["verdict"] == "block") for g in got]) >= 0.95


# ---- quality ------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 700))
def test_chunks_cover_every_window(n):
    text = "".join(chr(33 + i % 90) for i in range(n))
    cut = chunks(text)
    data = text.encode()
    windows = {bytes(c[i : i + WIDTH].astype(np.uint8)) for c in cut if True for i in range(0, CHUNK - WIDTH + 1, 2) if (c[i : i + WIDTH] < 256).all()}
    assert all(data[i : i + WIDTH] in windows for i in range(0, n - WIDTH + 1, 2))
    assert len(cut) == max(1, -(-(n - CHUNK) // STEP) + 1)


def test_quality(spark, with_null_id, empty):
    dice = random.Random(1)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(60)) for _ in range(150)]
    bad = [" ".join(word() + dice.choice(["%%%", "&&&", "!!"]) for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(300)] + [(0, None, 1), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, labels).collect()
    held = [g for g in got if g["held_out"]]
    assert 30 < len(held) < 90
    assert np.mean([g["predicted"] == int(g["doc_id"] < 150) for g in held]) > 0.9
    odd = score_quality(with_null_id, labels).collect()
    assert len(odd) == with_null_id.count() and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in odd)
    assert score_quality(empty, labels).collect() == []
    assert {g["score"] for g in score_quality(with_null_id, labels.limit(0)).collect()} == {0.5}


def test_training_is_repeatable_and_learns():
    dice = np.random.default_rng(0)
    made = lambda low, high: "".join(map(chr, dice.integers(low, high, 300)))
    samples = [made(97, 105) for _ in range(40)] + [made(33, 40) for _ in range(40)]
    labels = np.array([1] * 40 + [0] * 40, np.float32)
    one, two = fit(samples, labels, epochs=10), fit(samples, labels, epochs=10)
    assert np.array_equal(one.tables, two.tables)
    p = one.score(samples)
    assert p[:40].mean() > 0.7 > 0.3 > p[40:].mean()


def test_score_is_a_plain_convolution():
    model = QualityModel.start(0.4, 3)
    for text in ("", "short", "x" * 126 + "ab", "".join(chr(33 + i * 7 % 90) for i in range(700))):
        data = list(text.encode())
        means = []
        for at in range(0, max(1, -(-(len(data) - CHUNK) // STEP) + 1)):
            piece = (data[at * STEP : at * STEP + CHUNK] + [PAD] * CHUNK)[:CHUNK]
            windows = [[sum(float(model.tables[k, piece[i + k], f]) for k in range(WIDTH)) for f in range(FILTERS)] for i in range(0, CHUNK - WIDTH + 1, 2)]
            means.append([max(0.0, max(w[f] for w in windows) + float(model.bias[f])) for f in range(FILTERS)])
        x = float(np.mean(means, axis=0) @ model.out + model.shift)
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-5)


def test_network_slopes():
    """Against finite differences of the loss."""
    dice = np.random.default_rng(2)
    texts, labels = ["".join(map(chr, dice.integers(97, 123, n))) for n in (20, 150, 400)], np.array([1, 0, 1], np.float32)
    model = QualityModel.start(0.5, 4)
    model.tables, model.out, model.bias = model.tables.astype(np.float64), model.out.astype(np.float64), model.bias.astype(np.float64)

    def loss():
        p = model.score(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    slopes = slopes_of(model, [chunks(t) for t in texts], labels)
    some = [tuple(i) for i in dice.permutation(np.argwhere(np.abs(slopes[0]) > 1e-4))[:12]]
    for values, slope, places in ((model.tables, slopes[0], some), (model.bias, slopes[1], [(k,) for k in range(FILTERS)]), (model.out, slopes[2], [(k,) for k in range(FILTERS)])):
        for at in places:
            was, step = values[at], 1e-5
            values[at] = was + step
            up = loss()
            values[at] = was - step
            down = loss()
            values[at] = was
            assert (up - down) / (2 * step) == pytest.approx(slope[at], abs=2e-3, rel=2e-2)


# ---- language -----------------------------------------------------------------------------


def test_language(spark, with_null_id, empty):
    dice = random.Random(3)
    stock = {"en": "the of and thing there with", "de": "der und ein schon über nicht", "fr": "le et une était avec être", "es": "el y una está con niño"}
    rows = [(i, " ".join(dice.choice(stock[lang].split()) for _ in range(12)), lang) for i in range(240) for lang in [list(stock)[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {g["doc_id"]: g for g in identify(docs).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert len(held) > 20 and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(0 <= g["score"] <= 1 for g in got.values())
    odd = identify(with_null_id).collect()
    assert len(odd) == with_null_id.count()
    text = {r["doc_id"]: r["text"] for r in with_null_id.collect() if r["doc_id"] is not None}
    for g in odd:
        if g["doc_id"] is not None:
            assert (g["lang_pred"] == "und") == (not any(map(str.isalpha, text[g["doc_id"]] or "")))
    assert identify(empty).collect() == []
    assert {g["lang_pred"] for g in identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    kept = keep_identified(with_null_id)
    assert kept.columns == with_null_id.columns
    assert kept.count() == sum(g["lang_pred"] != "und" for g in odd)


def test_svm_and_features():
    assert family("en") == family("de") != family("fr") and family("xx") == "xx"
    assert np.linalg.norm(features("some text")) == pytest.approx(1)
    assert np.linalg.norm(features("")) <= 1.0001
    x = np.random.default_rng(0).normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] > 0.1, 1.0, -1.0).astype(np.float32)
    w = fit_svm(x, y, cost=10)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


# ---- benchmark ----------------------------------------------------------------------------


def test_leaks(spark, word, with_null_id, empty):
    dice = random.Random(8)
    prose = lambda n: [word(dice) for _ in range(n)]
    own = [["q" + w for w in prose(dice.randint(14, 60))] for _ in range(12)]
    items = [(i, " ".join(w).capitalize() + ".") for i, w in enumerate(own)] + [(90, None), (91, ""), (None, "x y z"), (0, " ".join(own[0]))]
    docs, planted = [], set()
    for i in range(120):
        text = prose(dice.choice([5, 40, 300]))
        if i % 4 == 0:
            k = dice.randrange(12)
            leak = own[k].copy()
            if i % 8 == 0:  # a paraphrase: some words replaced, not those of the answer
                for j in dice.sample(range(len(leak) - 5), max(1, len(leak) // 6)):
                    leak[j] = word(dice)
            at = dice.randrange(len(text))
            text[at:at] = leak
            planted.add((i, k))
        docs.append((i, " ".join(text).upper() if i % 16 == 4 else " ".join(text)))
    docs += [(500, None), (501, ""), (502, "...")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as file", "3 as row")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(g["doc_id"], g["item_id"]) for g in find_leaks(frame, bench).collect()}
    assert got == planted
    kept = drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in {d for d, _ in planted})
    assert find_leaks(empty, bench).collect() == [] == find_leaks(frame, bench.limit(0)).collect()
    assert find_leaks(with_null_id, bench).collect() == []
    assert drop_leaks(with_null_id, bench).count() == with_null_id.count()


def test_leaks_of_an_item_in_a_third_of_the_documents(spark, word):
    dice = random.Random(12)
    prose = lambda n: [word(dice) for _ in range(n)]
    own = [[f"q{k}{w}" for w in prose(15 + 9 * k)] for k in range(3)]
    rare = [f"r{i}" for i in range(40)]
    docs = []
    for i in range(300):
        text = prose(45)
        at = dice.randrange(45)
        text[at:at] = own[i % 3] if i % 3 else [*dice.sample(rare, 9), *own[0], *dice.sample(rare, 9)]
        docs.append((i, " ".join(text if i % 3 == 0 or i % 9 < 6 else prose(60))))
    docs.append((300, "once " + " ".join(prose(20))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(own)), (8, "once seen elsewhere"), (9, " ".join(rare))], "item_id long, text string")
    got = {(g["doc_id"], g["item_id"]) for g in find_leaks(frame, bench).collect()}
    assert got == {(i, i % 3) for i in range(300) if i % 3 == 0 or i % 9 < 6}


def test_leaks_of_a_long_item(spark, word):
    dice = random.Random(13)
    item = [f"l{i}" for i in range(1000)]
    prose = lambda n: [word(dice) for _ in range(n)]
    docs = [(i, " ".join([*prose(90), *(item if i == 3 else item[:400] if i == 4 else []), *prose(90)])) for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(g["doc_id"], g["item_id"], g["lcs_share"]) for g in find_leaks(frame, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()]
    assert got == [(3, 1, 1.0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (x == y and x > 0))
    assert lcs(np.array(a), np.array(b)) == table[-1][-1]


def test_word_codes():
    vocabulary = np.unique(word_hashes(["one two three"], NOT_ALNUM)[0])
    a, b, c = word_codes(["One, TWO-three! four", "", "x"], vocabulary)
    assert sorted(a[:3].tolist()) == [1, 2, 3] and a[3] == 0 and len(b) == 0 and c.tolist() == [0]
    assert answer_of(np.arange(50)).tolist() == list(range(40, 50)) and BLOCK == 16
