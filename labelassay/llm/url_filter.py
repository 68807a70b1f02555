"""URL filter: allow and block rules, else naive Bayes over segmented host and path words.

Words are counted over all pages, names are split by those counts, and naive
Bayes learns from the urls that the rules judge. All of it is tables on Spark:
no vocabulary is gathered on the driver or cut to its commonest words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_all_salts, bloom_bits, bloom_has, done_with, hash_of_longs, hot_keys, lower_ascii, salted, saved
from .shingles import part_hashes, polynomial_sums, whole_hashes

ALLOW, BLOCK = "allow", "block"

# Words that mark unwanted sites; each counts once, a small prior.
SEED_WORDS = (
    "adult ads advert affiliate bet bets betting bingo bonus casino cheap clickbait coupon crack "
    "dating download escort fake farm free gambling gamble hack hentai jackpot keygen loan loans "
    "lottery malware nude payday pharma phishing pill pills poker porn porno prize promo replica "
    "roulette scam sex sexy slots spam spyware steroids torrent track tracker viagra virus warez "
    "webcam win winner xxx"
).split()
NUMBER = "<num>"


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule (host and path) and action of the longest rule that fits, else null.

    A rule (action, host, path) fits its host and all subdomains where the path
    starts with its own. The rules of a host are looked up by each suffix of
    the url's host at a dot, so the work doesn't grow with the number of rules.
    """
    of: dict[str, list[tuple[str, str]]] = {}
    for action, rule_host, rule_path in rules:
        of.setdefault(rule_host, []).append((rule_path, action))
    if not of:
        return F.lit(None).cast("struct<rule: string, action: string>")
    entry = lambda h, p, a: F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(a).alias("action"))
    table = F.create_map(*(x for h, own in of.items() for x in (F.lit(h), F.array(*(entry(h, p, a) for p, a in own)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())), lambda r: path.startswith(r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["action"].alias("action")))


def best_split(name: str, cost: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The split of a name into words with the least cost (Viterbi): the most probable one by unigrams.

    An unknown word of n letters counts as ``10 / (total * 10**n)``, with
    ``unknown`` = log(total / 10), so a name is cut up only where its parts are
    known words. ``longest`` is the length of the longest known word; only
    lengths that known words have are tried.
    """
    n, known = len(name), cost.get
    lengths = sorted({len(w) for w in cost if len(w) <= longest}, reverse=True)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    letter = 2.302585
    low, at = 0.0, 0  # where an unknown word had best begin: each of its letters costs the same
    for end in range(1, n + 1):
        best[end], back[end] = low + unknown + letter * end, at
        for length in lengths:
            start = end - length
            price = known(name[start:end]) if start >= 0 else None
            if price is not None and best[start] + price < best[end]:
                best[end], back[end] = best[start] + price, start
        if best[end] - letter * end < low:
            low, at = best[end] - letter * end, end
    out, end = [], n
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """word and n of all words in the visible text of all pages; seed words count once more."""
    text = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where("word != ''")
    seeds = pages.sparkSession.createDataFrame([(w,) for w in SEED_WORDS], "word string")
    return words.unionByName(seeds).groupBy("word").agg(F.count("*").alias("n"))


def known_parts(name: str, lengths: np.ndarray, bits: np.ndarray) -> list[str]:
    """The distinct parts of a name that may be words, by their hashes: only parts as long (in bytes) as some word.

    Running sums give the hashes of all parts of one length at once, so a name
    of n letters costs n steps for each length that words have, and only parts
    that the filter lets pass are made.
    """
    raw = np.frombuffer(name.encode("utf-8", "surrogatepass"), np.uint8)
    sums = polynomial_sums(raw)
    out: dict[bytes, None] = {}
    for k in lengths[lengths <= len(raw)].tolist():
        hit = np.flatnonzero(bloom_has(bits, hash_of_longs(part_hashes(sums, k))))
        out.update((raw[i : i + k].tobytes(), None) for i in hit.tolist())
    return [p for x in out if (p := x.decode("utf-8", "ignore")).encode("utf-8", "surrogatepass") == x]


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """name and parts: each of ``names`` (letters) split by the counts ``words`` (word, n).

    Of every name all parts that may be words (by a Bloom filter) are looked up
    in the table of counts, so no vocabulary is held anywhere and none is cut.
    The driver gets the filter's bits and the lengths that words have.
    """

    @F.pandas_udf("long")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(whole_hashes(batch.tolist()).view(np.int64))

    keyed = saved(words.select("n", F.length("word").alias("letters"), F.octet_length("word").alias("bytes"), key("word").alias("id")), "url-word-keys")
    total, longest, kinds = keyed.agg(F.sum("n"), F.max("letters"), F.count("*")).first()
    total, longest = total or 1, longest or 1
    lengths = np.array(sorted(r["bytes"] for r in keyed.select("bytes").distinct().collect()), np.int64)  # as many as the root of twice the words' bytes at most
    share = names.sparkSession.sparkContext.broadcast
    bits, lengths = share(bloom_bits(keyed.select("id"), kinds)), share(lengths)
    done_with(keyed)

    @F.pandas_udf("array<string>")
    def inside(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: known_parts(x, lengths.value, bits.value))

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, known, cost in batches:
            yield pd.Series([best_split(x, {} if k is None else dict(zip(k, c)), math.log(total / 10), longest) for x, k, c in zip(name, known, cost)])

    parts = saved(names.select("name", F.explode(inside("name")).alias("word")), "url-name-parts")
    hot = hot_keys(parts.groupBy("word").agg(F.count("*").alias("n")), parts.count())
    known = salted(parts, hot, "word", "name").join(at_all_salts(words, hot, "word"), ["word", "salt"])
    known = known.groupBy("name").agg(F.collect_list("word").alias("known"), F.collect_list(F.log(F.lit(float(total)) / F.col("n"))).alias("cost"))
    out = saved(names.join(known, "name", "left").select("name", split("name", "known", "cost").alias("parts")), "url-names")
    done_with(parts)
    return out


URL = ["url1", "url2"]  # two hashes that stand for a host and path


def with_url_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("url1", F.xxhash64("host", "path")).withColumn("url2", F.xxhash64("path", F.lit(1), "host"))


def url_tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """url1, url2 and token of each url: words of the host's labels (``h:``) and of the path (``p:``); a number is one token."""
    runs = lambda text, mark: F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+|\p{L}+"), F.lit(0)), lambda r: F.struct(F.lit(mark).alias("mark"), r.alias("name")))
    found = urls.select(*URL, F.explode(F.concat(runs(F.col("host"), "h:"), runs(F.lower("path"), "p:"))).alias("r")).select(*URL, "r.*")
    numbers = F.col("name").rlike("^[0-9]")
    named = saved(found.where(~numbers), "url-runs")
    counted = saved(named.groupBy("name").agg(F.count("*").alias("n")), "url-run-counts")
    parts = segment(counted.select("name"), words)
    hot = hot_keys(counted, named.count())
    cut = salted(named, hot, "name", "url1").join(at_all_salts(parts, hot, "name"), ["name", "salt"]).select(*URL, "mark", F.explode("parts").alias("word"))
    out = cut.select(*URL, F.concat("mark", "word").alias("token")).unionByName(found.where(numbers).select(*URL, F.concat("mark", F.lit(NUMBER)).alias("token")))
    out = saved(out, "url-tokens")
    done_with(named, counted, parts)
    return out


@dataclass
class UrlModel:
    """Log of the odds for block: a table of all tokens seen (token, odds), and before any token."""

    odds: DataFrame
    prior: float


def fit_url_model(tokens: DataFrame, labels: DataFrame, smooth: float = 0.5) -> UrlModel:
    """Multinomial naive Bayes from urls that are judged already.

    ``tokens`` is of ``url_tokens``; ``labels`` has url1, url2, n (pages) and
    bad. All tokens of all labelled urls count. A seed word counts as if it
    had stood once in a blocked url.
    """
    block, allow = F.when(F.col("bad"), F.col("n")).otherwise(0), F.when(F.col("bad"), 0).otherwise(F.col("n"))
    seeds = labels.sparkSession.createDataFrame([(m + w, 1, 0) for w in SEED_WORDS for m in ("h:", "p:")], "token string, block long, allow long")
    seen = tokens.join(labels, URL).select("token", block.cast("long").alias("block"), allow.cast("long").alias("allow")).unionByName(seeds)
    counts = saved(seen.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-token-counts")
    kinds, blocks, allows = counts.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    size = lambda n: float(n + smooth * (kinds + 1))
    odds = F.log((F.col("block") + smooth) / size(blocks)) - F.log((F.col("allow") + smooth) / size(allows))
    b, a = labels.agg(F.coalesce(F.sum(block), F.lit(0)), F.coalesce(F.sum(allow), F.lit(0))).first()
    return UrlModel(counts.select("token", odds.alias("odds")), math.log((b + 1) / (a + 1)))


def url_scores(tokens: DataFrame, model: UrlModel) -> DataFrame:
    """url1, url2 and score: the probability of block for each url that has a token."""
    hot = hot_keys(tokens.groupBy("token").agg(F.count("*").alias("n")), tokens.count())
    met = salted(tokens, hot, "token", "url1").join(at_all_salts(model.odds, hot, "token"), ["token", "salt"])
    total = met.groupBy(*URL).agg(F.sum("odds").alias("odds"))
    return total.select(*URL, (1 / (1 + F.exp(-(F.col("odds") + F.lit(model.prior))))).alias("score"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], teach: Callable[[Column], Column] | None = None) -> DataFrame:
    """Judge the url of every page.

    Reads ``page_id``, ``url`` and, to learn words, ``html``; other columns are
    left out. ``rules`` are (action, host, path); where none fits, naive Bayes
    gives the verdict: block from a score of 0.5. It learns from the urls that
    the rules judge (of these only where ``teach`` of the host holds, to
    measure on others). A null url or one without ``://`` has an empty host
    and path; it and urls without a known token are judged by the prior alone.
    Repeated rows get a row each; an empty table gives no rows.
    Returns page_id, host, path, rule (null if none fits), verdict, score.
    """
    host, path = parse_url(F.col("url"))
    rows = with_url_id(pages.select("page_id", host.alias("host"), path.alias("path")))
    urls = saved(rows.groupBy(*URL).agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("n")), "urls")
    action = matching_rule(F.col("host"), F.col("path"), rules)["action"]
    taught = teach(F.col("host")) if teach else F.lit(True)
    labels = urls.withColumn("action", action).where(F.col("action").isNotNull() & taught).select(*URL, "n", (F.col("action") == BLOCK).alias("bad"))
    words = saved(word_counts(pages), "url-words")
    tokens = url_tokens(urls, words)
    done_with(words)
    model = fit_url_model(tokens, labels)
    scores = saved(urls.select(*URL, "n").join(url_scores(tokens, model), URL, "left"), "url-scores")
    done_with(tokens)
    hot = hot_keys(scores.select("url1", "n"), rows.count())
    out = salted(rows, hot, "url1", "page_id").join(at_all_salts(scores.drop("n"), hot, "url1"), ["url1", "url2", "salt"])
    out = out.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    score = F.coalesce("score", F.lit(1 / (1 + math.exp(-model.prior))))
    verdict = F.coalesce("match.action", F.when(score >= 0.5, BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
