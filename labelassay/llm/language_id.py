"""Language identification in two steps: the family first, then the languages in it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

UNKNOWN = "und"
FEATURES = 1 << 12

# Families of closely related languages by ISO 639-1 code. A code
# that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "celtic": "br cy ga gd",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_seed = np.random.default_rng(20240301)
_GRAM = _seed.integers(0, 1 << 32, (3, 256), np.uint64).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of how often each hashed byte trigram occurs in the whole text."""
    data = _LOWER[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    at = (_GRAM[0][data[:-2]] + _GRAM[1][data[1:-1]] + _GRAM[2][data[2:]]) >> np.uint32(20) if len(data) > 2 else np.zeros(0, np.uint32)
    x = np.sqrt(np.bincount(at.astype(np.int64), minlength=FEATURES).astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, steps: int = 200) -> np.ndarray:
    """Weights, the last one the bias, of a linear support vector machine.

    Squared hinge loss with classes of equal weight, minimised by accelerated
    gradient steps; ``y`` is 1 or -1.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y) * cost
    step = 1.0 / (1.0 + 4.0 * float(share.sum()))
    w = previous = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        v = w + (k / (k + 3.0)) * (w - previous)
        slack = np.maximum(0, 1 - y * (x @ v))
        previous, w = w, v - step * (v - 2 * x.T @ (share * y * slack))
    return w


@dataclass
class LanguageModel:
    """One-versus-one machines between families, and inside each family between its languages."""

    langs: dict[str, list[str]] = field(default_factory=dict)
    families: list[tuple[str, str, np.ndarray]] = field(default_factory=list)
    inside: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)
    steepness: float = 4.0

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        of = np.array(langs, object)
        groups = np.array([family(v) for v in langs], object)
        model = cls({g: sorted(set(of[groups == g])) for g in sorted(set(groups))})

        def machines(names: list[str], labels: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
            out = []
            for a, b in combinations(names, 2):
                rows = (labels == a) | (labels == b)
                out.append((a, b, fit_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0).astype(np.float32))))
            return out

        model.families = machines(list(model.langs), groups)
        model.inside = {g: machines(names, of) for g, names in model.langs.items()}
        return model

    def _vote(self, x: np.ndarray, names: list[str], machines: list[tuple[str, str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The name with most won duels (then the surest, then the first) and its mean sureness."""
        won, sure = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        at = {v: i for i, v in enumerate(names)}
        for a, b, w in machines:
            p = 1 / (1 + np.exp(-self.steepness * np.clip(x @ w[:-1] + w[-1], -20, 20)))
            for name, q in ((a, p), (b, 1 - p)):
                won[:, at[name]] += q > 0.5
                sure[:, at[name]] += q
        duels = max(1, len(names) - 1)
        best = np.argmax(won + sure / (duels + 1), axis=1)
        return best, sure[np.arange(len(x)), best] / duels if machines else np.ones(len(x))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.langs)
        best, score = self._vote(x, names, self.families)
        out = np.empty(len(x), object)
        for i, g in enumerate(names):
            rows = np.flatnonzero(best == i)
            if len(rows):
                at, sure = self._vote(x[rows], self.langs[g], self.inside[g])
                out[rows] = np.array(self.langs[g], object)[at]
                score[rows] *= sure
        return out.tolist(), np.clip(score, 0, 1)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_pydict({"lang": [lang], "x": [features(text).tobytes()]}, schema=pa.schema([("lang", pa.string()), ("x", pa.binary())]))


def fit_language_model(docs: DataFrame, rows_per_lang: int = 400, most_rows: int = 8000, folds: int = 5) -> LanguageModel:
    """Fit on a bounded sample of labelled rows.

    Only ``text`` and non-null ``lang`` of rows whose crc32(doc_id) isn't
    divisible by ``folds`` are used; of each language ``rows_per_lang`` different
    texts with a low hash, ``most_rows`` in all. Texts count whole.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id"), folds) & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    rows = rows.withColumn("dice", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30))).withColumn("key", F.xxhash64("text"))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not counts:
        return LanguageModel()
    each = max(1, min(rows_per_lang, most_rows // len(counts)))
    limits = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, 1.3 * each / n + 20 / n) * (1 << 30)))))
    # A text that repeats is drawn with all its rows; one of them is enough.
    drawn = rows.where(F.col("dice") <= limits[F.col("lang")]).dropDuplicates(["lang", "key"]).select("lang", "text").mapInArrow(_sample_features, "lang string, x binary").collect()
    taken, used = [], dict.fromkeys(counts, 0)
    for row in sorted(drawn, key=lambda r: (r["lang"], bytes(r["x"]))):
        if used[row["lang"]] < each:
            used[row["lang"]] += 1
            taken.append(row)
    return LanguageModel.fit(np.stack([np.frombuffer(r["x"], np.float32) for r in taken]), [r["lang"] for r in taken])


def language_of(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred and score; ``und`` and 0 where the text is null or has no letter."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in range(0, len(batch), 512):
                some = batch.iloc[i : i + 512]
                known = [isinstance(t, str) and any(map(str.isalpha, t)) and bool(model.langs) for t in some]
                langs, scores = np.full(len(some), UNKNOWN, object), np.zeros(len(some))
                if any(known):
                    langs[known], scores[known] = model.predict(np.stack([features(t) for t, k in zip(some, known) if k]))
                out.append(pd.DataFrame({"lang_pred": langs, "score": scores}))
            yield pd.concat(out) if out else pd.DataFrame({"lang_pred": [], "score": []})

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel | None = None, folds: int = 5) -> DataFrame:
    """Language of every whole text.

    Reads ``doc_id``, ``text`` and, to learn, ``lang``; other columns are left
    out. A null text or one without a letter is ``und`` with score 0, and so is
    every text if no row can be learned from. Repeated rows get a result each;
    a null doc_id counts as held out; an empty table gives no rows.
    Returns doc_id, held_out, lang_pred, score.
    """
    model = model or fit_language_model(docs, folds=folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_of(F.col("text").cast("string"), model).alias("found"))
    return rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, in which a language was recognised."""
    model = model or fit_language_model(docs)
    found = language_of(docs["text"].cast("string"), model)
    return docs.where(found["lang_pred"] != UNKNOWN)
