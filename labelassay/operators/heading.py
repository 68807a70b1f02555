"""Whether the warning's heading is printed in bold: ink in the words' boxes."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ink_share(pixels: np.ndarray) -> float | None:
    """Share of dark pixels, the threshold by Otsu's method (most variance between the two sides)."""
    if not pixels.size:
        return None
    counts = np.bincount(pixels.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), pixels.size
    mass = np.cumsum(counts * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    at = int(np.argmax(np.nan_to_num(between)))
    return float((pixels <= at).sum()) / total


def word_density(words: DataFrame, tiles: DataFrame) -> DataFrame:
    """``words`` with ``density``; ``tiles`` has photo_id, w, h and px (gray bytes, row by row)."""

    @F.pandas_udf("double")
    def density(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for px, w, h, left, top, width, height in batches:
            out = []
            for p, a, b, x, y, dx, dy in zip(px, w, h, left, top, width, height):
                out.append(None if p is None else ink_share(np.frombuffer(p, np.uint8).reshape(int(b), int(a))[int(y) : int(y) + int(dy), int(x) : int(x) + int(dx)]))
            yield pd.Series(out, dtype=float)

    return words.join(tiles, "photo_id", "left").withColumn("density", density("px", "w", "h", "left", "top", "width", "height")).drop("px", "w", "h")


def heading_bold(words: DataFrame, ratio: float = 1.15, least: int = 5, most: int = 20) -> DataFrame:
    """photo_id and bold, from words with density: heading words against body words of the first heading's block.

    Null if there is no heading or fewer than ``least`` body words.
    """
    bare = F.btrim(F.col("text"), F.lit(string.punctuation))
    marked = words.withColumn("heading", F.upper(bare).isin("GOVERNMENT", "WARNING")).withColumn("size", F.length(bare))
    block = marked.groupBy("photo_id").agg(F.min_by("block_num", F.when(F.col("heading"), F.col("word_seq"))).alias("block"))
    body = (F.col("block_num") == F.col("block")) & ~F.col("heading") & (F.col("size") >= 3)
    placed = marked.join(block, "photo_id").withColumn("body", F.coalesce(body, F.lit(False)))
    placed = placed.withColumn("place", F.count_if("body").over(Window.partitionBy("photo_id").orderBy("word_seq")))
    used = F.col("body") & (F.col("place") <= most)
    sums = placed.groupBy("photo_id").agg(F.count_if(used).alias("n"), F.avg(F.when(F.col("heading"), F.col("density"))).alias("head"), F.avg(F.when(used, F.col("density"))).alias("rest"))
    return sums.select("photo_id", F.when((F.col("n") >= least) & (F.col("rest") > 0), F.col("head") >= F.col("rest") * ratio).alias("bold"))
