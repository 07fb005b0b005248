"""Category values and typeahead."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entries, fold


def listable(vocabulary: DataFrame, visible: DataFrame | None, column: str) -> DataFrame:
    """The values a viewer may be shown: all of a public vocabulary (visible None), else those that a visible item carries.

    vocabulary: code, key, title.
    """
    if visible is None:
        return vocabulary
    return vocabulary.join(visible.select(F.col(column).alias("code")), "code", "left_semi")


def enumerate_values(values: DataFrame, after: str | None = None, limit: int = 100) -> DataFrame:
    """A page of values by key."""
    out = values if after is None else values.where(F.col("key") > after)
    return out.orderBy("key").limit(limit)


def resolve(values: DataFrame, codes: list[int]) -> DataFrame:
    """Values of the codes named; unknown ones are left out."""
    return values.where(F.col("code").isin(*codes)) if codes else values.limit(0)


def entry_table(vocabulary: DataFrame) -> DataFrame:
    """code, key, title, kind, folded: how each value may be found. Written once per vocabulary."""

    def run(batches):
        for pdf in batches:
            rows = [(c, k, t, kind, text) for c, k, t in zip(pdf["code"], pdf["key"], pdf["title"], strict=True) for kind, text in entries(k, t if isinstance(t, str) else None)]
            yield pd.DataFrame(rows, columns=["code", "key", "title", "kind", "folded"])

    return vocabulary.select("code", "key", "title").mapInPandas(run, "code int, key string, title string, kind int, folded string")


def suggest(entries_: DataFrame, text: str, limit: int = 10, visible: DataFrame | None = None, column: str | None = None, filtered: DataFrame | None = None) -> DataFrame:
    """Values of which an entry starts with the text, in folded order; each once, by its best entry.

    key, title, folded, count (under the filter; values stay with 0) and total (without it), where sets are given, and ``more``.
    """
    prefix = fold(text)
    hits = entries_.where(F.col("folded").startswith(prefix))
    if visible is not None:
        totals = visible.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("total"))
        hits = hits.join(totals, "code")
    best = Window.partitionBy("code").orderBy("kind", "folded")
    out = hits.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    if filtered is not None:
        counts = filtered.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("count"))
        out = out.join(counts, "code", "left").fillna(0, ["count"])
    page = out.orderBy("folded", "key").limit(limit + 1)
    numbered = page.withColumn("place", F.row_number().over(Window.orderBy("folded", "key")))
    return numbered.withColumn("more", F.max("place").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("place") <= limit)
