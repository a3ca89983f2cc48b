"""The report: matched, merged, resolved articles with similar coverage, newest first."""

from pyspark.sql import functions as F

from newsloom.functions.dates import date_label
from newsloom.functions.text import join_labels
from newsloom.operators import metrics
from newsloom.operators.match import match_entries
from newsloom.operators.merge import merge_by_link
from newsloom.operators.resolve import resolve_urls
from newsloom.operators.similarity import similar_coverage
from newsloom.schemas import PAGE_ROWS, REPORT, SIMILARITY_THRESHOLD, SORT_COLUMN
from newsloom.workspace import write_through


def build_articles(entries, regions, industries, start, end, resolution=None):
    """One row per matched link. Lazy: one scan, one shuffle of the hits on the link."""
    hits = match_entries(entries, regions, industries, start, end)
    return resolve_urls(merge_by_link(hits), resolution)


def labelled(articles, *extra):
    """Public names and text cells; keeps ``seq``, and ``published_local`` for the trend."""
    return articles.select(
        *extra,
        "seq",
        "published_local",
        date_label(F.col("published"), F.col("published_local")).alias("Tanggal"),
        F.col("published_at").alias(SORT_COLUMN),
        F.col("title").alias("Judul"),
        F.col("source").alias("Sumber"),
        join_labels(F.col("regions")).alias("Wilayah"),
        join_labels(F.col("industries")).alias("Usaha"),
        F.col("status").alias("Status URL"),
        F.col("url").alias("URL"),
    )


def covered_articles(articles, threshold=SIMILARITY_THRESHOLD, method="fuzzy"):
    """Articles with their similar coverage, before sorting.

    The articles are written once: both the comparison and the report read them.
    """
    articles = write_through(articles, "articles")
    similar = similar_coverage(articles, threshold, method)
    return labelled(similar, F.col("similar").alias("Liputan Serupa"))


def build_report(
    entries, regions, industries, start, end, resolution=None,
    threshold=SIMILARITY_THRESHOLD, method="fuzzy",
):
    """The sorted report with the fixed columns of ``REPORT``."""
    articles = build_articles(entries, regions, industries, start, end, resolution)
    return newest_first(covered_articles(articles, threshold, method))


def analyses(articles):
    """All analyses by name, each lazy, over the labelled articles stored once.

    Columns ``label`` and ``n``; the label of a day is its date.
    """
    stored = write_through(labelled(articles), "labelled")
    return {
        "sources": metrics.label_counts(stored, "Sumber"),
        "regions": metrics.label_counts(stored, "Wilayah"),
        "industries": metrics.label_counts(stored, "Usaha"),
        "keywords": metrics.top_keywords(stored).withColumnRenamed("word", "label"),
        "days": metrics.daily_trend(stored).select(F.date_format("day", "yyyy-MM-dd").alias("label"), "n"),
    }


def in_order(report):
    """Newest rows first, undated ones last, ties in ingest order."""
    return report.orderBy(F.desc_nulls_last(SORT_COLUMN), F.asc("seq"))


def newest_first(report):
    """The ordered report with its fixed columns."""
    return in_order(report).select(*[f"`{c}`" for c in REPORT.names])


def page(report, number, rows=PAGE_ROWS):
    """Page ``number`` (from 0) of a report that still has its ``seq``."""
    return in_order(report).offset(number * rows).limit(rows)


def page_after(report, moment, seq, rows=PAGE_ROWS):
    """The page that follows the row with sort date ``moment`` (None: undated) and ``seq``.

    Whatever the page, a task keeps ``rows`` rows at most: earlier rows are filtered out.
    """
    undated = F.col(SORT_COLUMN).isNull()
    if moment is None:
        later = undated & (F.col("seq") > seq)
    else:
        at = F.lit(moment).cast("timestamp_ntz")
        same = (F.col(SORT_COLUMN) == at) & (F.col("seq") > seq)
        later = undated | (F.col(SORT_COLUMN) < at) | same
    return in_order(report.where(later)).limit(rows)
