"""Term lists: regions, industries, their combinations and their date windows."""

from pyspark.sql import functions as F

from newsloom.functions.text import search_phrase, split_terms, strip
from newsloom.schemas import WINDOW_DAYS

# Slices of the industry list in ``combinations``.
_SLICES = 32


def clean(df, column="term"):
    """Strip the terms of a column and drop blank and null ones."""
    return df.withColumn(column, strip(F.col(column))).where(F.col(column) != "")


def split_manual(df, text, position="pos", term="term"):
    """One row per term of a free text, in order."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(split_terms(F.col(text))).alias(position, term))


def combinations(regions, industries):
    """Every region with every industry, and the search text of the pair.

    ``regions`` and ``industries`` have one column ``term``. Each region meets each slice of
    the industries once, on the slice number: the product is spread over the slices and
    needs no cross join.
    """
    left = regions.select(
        F.col("term").alias("wilayah"),
        F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))).alias("_slice"),
    )
    right = industries.select(
        F.col("term").alias("usaha"),
        F.pmod(F.xxhash64("term"), F.lit(_SLICES)).cast("int").alias("_slice"),
    )
    return left.join(right, "_slice").select(
        "wilayah", "usaha", search_phrase(F.col("wilayah"), F.col("usaha")).alias("keyword")
    )


def date_windows(ranges, start="start", end="end", days=WINDOW_DAYS):
    """Consecutive windows of at most ``days`` days over each range.

    Adjacent windows share their boundary date. A range that ends where it starts has none.
    """
    kept = [c for c in ranges.columns if c not in (start, end)]
    # sequence() rejects a stop before its start
    starts = F.when(
        F.col(start) < F.col(end),
        F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr(f"interval {days} days")),
    )
    return ranges.select(*kept, F.col(end), F.explode(starts).alias("win_start")).select(
        *kept, "win_start", F.least(F.date_add("win_start", days), F.col(end)).alias("win_end")
    )
