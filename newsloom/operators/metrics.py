"""Analyses of a report. Each reads only the columns it names."""

from pyspark.sql import functions as F

from newsloom.functions.text import ascii_words, split_labels, strip
from newsloom.schemas import SORT_COLUMN, STOP_WORDS, TOP_KEYWORDS, TOP_LABELS


def top_labels(counts, label, top):
    """The largest counts, smallest first for display; ties in label order."""
    return counts.orderBy(F.desc("n"), F.asc(label)).limit(top).orderBy(F.asc("n"), F.desc(label))


def label_counts(report, column, top=TOP_LABELS):
    """How many rows carry each label of a cell; blank labels do not count."""
    labels = report.select(F.explode(split_labels(F.col(column).cast("string"))).alias("label"))
    counts = labels.where(strip(F.col("label")) != "").groupBy("label").agg(F.count("*").alias("n"))
    return top_labels(counts, "label", top)


def searched_words(report):
    """Distinct words of the searched regions and industries, which are no keywords."""
    cells = F.array("Wilayah", "Usaha")
    words = F.flatten(F.transform(cells, lambda c: ascii_words(F.coalesce(c.cast("string"), F.lit("")), 3)))
    return report.select(F.explode(words).alias("word")).distinct()


def top_keywords(report, top=TOP_KEYWORDS):
    """Most frequent title words that are neither stop words nor searched words.

    Title words and searched words are told apart by a flag and counted together: one scan and
    one aggregation take the place of a count, a distinct and an anti join.
    """
    tag = lambda words, n: F.transform(
        words, lambda w: F.struct(w.alias("word"), F.lit(n).alias("in_title"))
    )
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    words = F.concat(
        tag(ascii_words(F.col("Judul"), 4), 1),
        tag(ascii_words(cell("Wilayah"), 3), 0),
        tag(ascii_words(cell("Usaha"), 3), 0),
    )
    counts = (
        report.select(F.inline(words))
        .where(~F.col("word").isin(STOP_WORDS))
        .groupBy("word")
        .agg(F.sum("in_title").alias("n"), F.min("in_title").alias("only_title"))
    )
    return top_labels(counts.where(F.col("only_title") == 1).select("word", "n"), "word", top)


def daily_trend(report):
    """Dated rows per day, on the sender's calendar when the report carries it."""
    local = "published_local" if "published_local" in report.columns else SORT_COLUMN
    return (
        report.select(F.to_date(local).alias("day"))
        .dropna()
        .groupBy("day")
        .agg(F.count("*").alias("n"))
        .orderBy("day")
    )


def kpis(report):
    """Rows, distinct sources, regions and industries, from one pass over the report."""
    kind = lambda name, labels: F.transform(
        labels, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("label"))
    )
    cell = lambda c: split_labels(F.coalesce(F.col(c).cast("string"), F.lit("")))
    tagged = F.concat(
        kind("source", F.array("Sumber")),
        kind("region", cell("Wilayah")),
        kind("industry", cell("Usaha")),
    )
    distinct = report.select(F.inline(tagged)).groupBy("kind", "label").agg(F.count("*").alias("n"))
    of = lambda name: F.count(F.when(F.col("kind") == name, F.col("label")))
    rows = F.sum(F.when(F.col("kind") == "source", F.col("n")).otherwise(0))
    return distinct.agg(
        F.coalesce(rows, F.lit(0)).alias("total_articles"),
        of("source").alias("sources"),
        of("region").alias("regions"),
        of("industry").alias("industries"),
    )


def wide_coverage(report):
    """How many rows have similar coverage elsewhere."""
    return report.agg(F.count_if(F.col("Liputan Serupa") > 0).alias("n"))
