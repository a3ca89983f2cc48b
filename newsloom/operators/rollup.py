"""Exact counts by day from which the analyses of any range of days are summed.

A report becomes rows ``day, kind, label, n``: its rows, its labels, its title words and the words of its
searched terms, each counted per local day (null: undated). Sums over days are the counts of those days, and
counts of disjoint reports add up, so no analysis needs the report again.
"""

from pyspark.sql import functions as F

from newsloom.functions.text import ascii_words, split_labels, strip
from newsloom.operators.match import in_range
from newsloom.operators.metrics import top_labels
from newsloom.schemas import SORT_COLUMN, STOP_WORDS, TOP_KEYWORDS, TOP_LABELS
from newsloom.versions import Versions
from newsloom.workspace import write_through

ROLLUP = "day date, kind string, label string, n long"


def daily_counts(report):
    """``day, kind, label, n`` of a labelled report: one scan, one aggregation."""
    local = "published_local" if "published_local" in report.columns else SORT_COLUMN
    tag = lambda kind, labels: F.transform(
        labels, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("label"))
    )
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = F.concat(
        tag("rows", F.array(F.lit(""))),
        tag("Sumber", F.coalesce(split_labels(F.col("Sumber")), F.array().cast("array<string>"))),
        tag("Wilayah", F.coalesce(split_labels(F.col("Wilayah").cast("string")), F.array().cast("array<string>"))),
        tag("Usaha", F.coalesce(split_labels(F.col("Usaha").cast("string")), F.array().cast("array<string>"))),
        tag("source", F.array("Sumber")),
        tag("region", split_labels(cell("Wilayah"))),
        tag("industry", split_labels(cell("Usaha"))),
        tag("title", ascii_words(F.coalesce(F.col("Judul"), F.lit("")), 4)),
        tag("searched", F.concat(ascii_words(cell("Wilayah"), 3), ascii_words(cell("Usaha"), 3))),
    )
    return (
        report.select(F.to_date(local).alias("day"), F.inline(counted))
        .groupBy("day", "kind", "label")
        .agg(F.count("*").alias("n"))
    )


def between(rollup, start=None, end=None):
    """The counts of the days in ``[start, end)`` and of undated rows."""
    if start is None:
        return rollup
    return in_range(rollup, start, end, "day")


def label_counts(rollup, column, top=TOP_LABELS):
    """As ``metrics.label_counts``."""
    labels = rollup.where((F.col("kind") == column) & (strip(F.col("label")) != ""))
    return top_labels(labels.groupBy("label").agg(F.sum("n").alias("n")), "label", top)


def top_keywords(rollup, top=TOP_KEYWORDS):
    """As ``metrics.top_keywords``."""
    words = rollup.where(F.col("kind").isin("title", "searched") & ~F.col("label").isin(STOP_WORDS))
    counts = words.groupBy(F.col("label").alias("word")).agg(
        F.sum("n").alias("n"), F.max(F.col("kind") == "searched").alias("searched")
    )
    return top_labels(counts.where(~F.col("searched")).select("word", "n"), "word", top)


def daily_trend(rollup):
    """As ``metrics.daily_trend``."""
    rows = rollup.where((F.col("kind") == "rows") & F.col("day").isNotNull())
    return rows.groupBy("day").agg(F.sum("n").alias("n")).orderBy("day")


def kpis(rollup):
    """As ``metrics.kpis``."""
    kinds = rollup.where(F.col("kind").isin("rows", "source", "region", "industry"))
    labels = kinds.groupBy("kind", "label").agg(F.sum("n").alias("n"))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, F.col("label")))
    return labels.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "rows", F.col("n"))), F.lit(0)).alias("total_articles"),
        of("source").alias("sources"),
        of("region").alias("regions"),
        of("industry").alias("industries"),
    )


def analyses(rollup):
    """All analyses by name, as in ``plans.report.analyses``."""
    return {
        "sources": label_counts(rollup, "Sumber"),
        "regions": label_counts(rollup, "Wilayah"),
        "industries": label_counts(rollup, "Usaha"),
        "keywords": top_keywords(rollup).withColumnRenamed("word", "label"),
        "days": daily_trend(rollup).select(F.date_format("day", "yyyy-MM-dd").alias("label"), "n"),
    }


class RollupStore:
    """Daily counts under one path; the days of a new report take the place of those stored before.

    Each day names the part that holds it, so a range of days reads these only.
    """

    def __init__(self, spark, path):
        self._versions = Versions(spark, path)

    def put(self, report):
        """Store the counts of a report that is whole for each of its days (undated rows are one day)."""
        counts = write_through(daily_counts(report), "daily-counts")
        stored = counts.select(F.coalesce(F.col("day").cast("string"), F.lit("undated")).alias("of"), *counts.columns)
        part = self._versions.write(stored.repartition("of"), "days", "of")
        days = [r[0] for r in stored.select("of").distinct().collect()]  # the days of the report
        self._versions.change(lambda state: {"days": {**state.get("days", {}), **{d: part for d in days}}})

    def read(self, start=None, end=None):
        """The counts of the days in ``[start, end)``, and of undated rows, as ``between`` gives them."""
        days = self._versions.current()[1].get("days", {})
        if start is not None:
            inside = lambda d: d == "undated" or start.isoformat() <= d < end.isoformat()
            days = {d: part for d, part in days.items() if start != end and inside(d)}
        return self._versions.read([f"{part}/of={d}" for d, part in sorted(days.items())], ROLLUP)
