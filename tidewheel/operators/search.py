"""Search for a part of a title by a table of trigrams.

Postings are sorted by trigram and written, so a search reads the row groups of its own trigrams only; titles that
hold all of them are then compared with the words searched for. Shorter searches compare all titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(text: Column) -> Column:
    """Distinct runs of three characters of the text in small letters."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(0)))
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_postings(offers: DataFrame, *, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """(gram, id), sorted for writing; null titles have none."""
    rows = offers.select(F.explode(_grams(F.col(text_col))).alias("gram"), F.col(id_col).alias("id"))
    return rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def candidates(postings: DataFrame, q: str) -> DataFrame | None:
    """Ids of rows that hold all trigrams of ``q``; None if it has none."""
    low = q.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    found = postings.filter(F.col("gram").isin(grams))
    return found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("id")


def search_titles(offers: DataFrame, postings: DataFrame, q: str, *, text_col: str = "title") -> DataFrame:
    """Offers whose title holds ``q`` in any case; ``%``, ``_`` and the backslash stand for themselves."""
    ids = candidates(postings, q)
    pool = offers if ids is None else offers.join(ids, "id", "left_semi")
    return pool.filter(F.contains(F.lower(text_col), F.lit(q.lower())))
