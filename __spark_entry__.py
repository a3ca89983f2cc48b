"""Registered queries and the SQL each must agree with.

``entry(spark)`` is the flagship, ``queries()`` one callable per operator, ``oracle_sql()``
the same results in DuckDB SQL over the same tables.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import fixtures as fx  # noqa: E402
from newsloom.functions.dates import date_label, search_date  # noqa: E402
from newsloom.functions.text import join_labels, run_label, split_terms  # noqa: E402
from newsloom.operators import metrics, terms  # noqa: E402
from newsloom.operators.match import match_articles, match_entries  # noqa: E402
from newsloom.operators.merge import merge_by_link  # noqa: E402
from newsloom.operators.mergestate import MergeState  # noqa: E402
from newsloom.operators import rollup  # noqa: E402
from newsloom.operators.similarity import similar_coverage, similar_groups, similar_pairs  # noqa: E402
from newsloom.plans import report as plans  # noqa: E402
from newsloom.plans.coverage import CoverageState  # noqa: E402
from newsloom.plans.pages import PagedReport  # noqa: E402
from newsloom.schemas import REPORT, SORT_COLUMN  # noqa: E402
from newsloom.sinks import export  # noqa: E402
from newsloom.sinks.runs import RunLog, run_records  # noqa: E402
from newsloom.sources import feed, reference  # noqa: E402
from newsloom.workspace import new_path, write_through  # noqa: E402
from oracle import ORACLE  # noqa: E402

try:
    from newsloom.llm import queries as llm
except ImportError as absent:
    if absent.name not in ("newsloom.llm", "corpus_pipeline"):
        raise
    llm = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"


# ---- sources -------------------------------------------------------------------


def ref_terms_long(spark, sf_dir):
    path = fx.supplier_list(spark, sf_dir, new_path(spark, "suppliers"))
    return reference.members(reference.read_wide(spark, path))


def ref_group_count(spark, sf_dir):
    lists = {
        "suppliers": fx.supplier_list(spark, sf_dir, new_path(spark, "suppliers")),
        "nations": fx.nation_list(spark, sf_dir, new_path(spark, "nations")),
    }
    rows = [
        (name, len(reference.group_names(reference.read_wide(spark, path))))
        for name, path in lists.items()
    ]
    return spark.createDataFrame(rows, "list string, n_groups bigint")


def select_group_terms(spark, sf_dir):
    """Suppliers of the chosen nations; region names are no groups and stand for themselves."""
    path = fx.supplier_list(spark, sf_dir, new_path(spark, "suppliers"))
    nations = fx.table(spark, sf_dir, "nation").where("n_regionkey < 2").select("n_name")
    regions = fx.table(spark, sf_dir, "region").select("r_name")
    chosen = [r[0] for r in nations.union(regions).collect()]
    return reference.select_terms(reference.read_wide(spark, path), chosen)


def feed_normalize(spark, sf_dir):
    path = new_path(spark, "landed")
    fx.raw_feed(spark, sf_dir).write.json(path)
    return feed.normalize(feed.read_feed(spark, path))


def split_manual_terms(spark, sf_dir):
    return terms.split_manual(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def clean_terms(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(F.split("text", "[.]")).alias("term")
    )
    return terms.clean(raw)


def run_labels(spark, sf_dir):
    """The short label of every turn's list of terms."""
    listed = split_terms(F.col("text"))
    return fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", run_label(listed).alias("label")
    )


# ---- terms, windows, dates -------------------------------------------------------


def term_combinations(spark, sf_dir):
    sources = fx.page_feed(spark, sf_dir).select(F.col("source").alias("term")).distinct()
    kinds = fx.table(spark, sf_dir, "part").select(F.col("p_type").alias("term")).distinct()
    return terms.combinations(sources, kinds)


def date_windows(spark, sf_dir):
    """Windows over every customer's span of orders."""
    spans = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end")
    )
    return terms.date_windows(spans).select(
        "o_custkey",
        "win_start",
        "win_end",
        search_date(F.col("win_start")).alias("from_text"),
        search_date(F.col("win_end")).alias("to_text"),
    )


def parse_published(spark, sf_dir):
    return fx.parsed_event_dates(spark, sf_dir).select(
        "event_id",
        "published_local",
        "published_at",
        date_label(F.col("published"), F.col("published_local")).alias("label"),
    )


# ---- matching, merging, resolving -------------------------------------------------


def _hits(spark, sf_dir):
    return match_articles(fx.page_entries(spark, sf_dir), fx.REGIONS, fx.INDUSTRIES, fx.START, fx.END)


def match_pages(spark, sf_dir):
    return _hits(spark, sf_dir).select(
        "seq", "link", "title", "source", "published", "wilayah", "usaha"
    )


def match_pages_many_terms(spark, sf_dir):
    """Hundreds of terms: every word of the benchmark items, and their pairs of words."""
    text = F.lower(F.col("text"))
    bench = fx.table(spark, sf_dir, "benchmark")
    words = bench.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("term"))
    pairs = bench.select(
        F.explode(F.regexp_extract_all(text, F.lit("[a-z]+ [a-z]+"), F.lit(0))).alias("term")
    )
    entries = fx.page_entries(spark, sf_dir)
    hits = match_articles(entries, words.distinct(), pairs.distinct(), fx.START, fx.END)
    return hits.select("seq", "link", "wilayah", "usaha")


def _merged_columns(articles):
    return articles.select(
        "link",
        "seq",
        "title",
        "source",
        "published",
        join_labels(F.col("regions")).alias("wilayah"),
        join_labels(F.col("industries")).alias("usaha"),
    )


def merge_pages(spark, sf_dir):
    return _merged_columns(merge_by_link(_hits(spark, sf_dir)))


def merge_documents(spark, sf_dir):
    """Many entries per link, merged from the compact form of the tags."""
    return _merged_columns(
        plans.build_articles(
            fx.document_entries(spark, sf_dir), fx.REGIONS, fx.INDUSTRIES, fx.START, fx.END
        )
    )


def merge_documents_batches(spark, sf_dir):
    """The same from a state that four batches were merged into."""
    hits = write_through(
        match_entries(fx.document_entries(spark, sf_dir), fx.REGIONS, fx.INDUSTRIES, fx.START, fx.END), "hits"
    )
    state = MergeState(spark, new_path(spark, "merged"), buckets=32)
    for batch in (2, 0, 3, 1, 0):
        state.add(hits.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == batch), batch)
    return _merged_columns(state.articles())


def _articles(spark, sf_dir, resolve=True):
    return plans.build_articles(
        fx.page_entries(spark, sf_dir), fx.REGIONS, fx.INDUSTRIES, fx.START, fx.END,
        fx.resolution(spark, sf_dir) if resolve else None,
    )


def resolve_urls(spark, sf_dir):
    return _articles(spark, sf_dir).select("link", "url", "status")


def resolve_urls_off(spark, sf_dir):
    return _articles(spark, sf_dir, resolve=False).select("link", "url", "status")


# ---- similarity -------------------------------------------------------------------


def _titles(spark, sf_dir):
    return fx.page_feed(spark, sf_dir).select("seq", "title")


def title_pairs(spark, sf_dir):
    return similar_pairs(_titles(spark, sf_dir))


def title_clusters(spark, sf_dir):
    return similar_coverage(_titles(spark, sf_dir)).select("seq", "leader")


def similar_pages(spark, sf_dir):
    return similar_coverage(_titles(spark, sf_dir)).select("seq", "similar")


def similar_pages_exact_key(spark, sf_dir):
    return similar_coverage(_titles(spark, sf_dir), method="exact").select("seq", "leader", "similar")


def similar_documents_exact_key(spark, sf_dir):
    titles = fx.document_feed(spark, sf_dir).select("seq", "title")
    return similar_coverage(titles, method="exact").select("seq", "leader", "similar")


def title_pairs_exact(spark, sf_dir):
    return similar_pairs(_titles(spark, sf_dir), method="exact")


def similar_events(spark, sf_dir):
    """Compared titles of many rows."""
    return similar_coverage(fx.event_titles(spark, sf_dir)).select("seq", "similar")


def headline_pairs(spark, sf_dir):
    return similar_pairs(fx.headline_feed(spark, sf_dir))


def headline_classes(spark, sf_dir):
    """The same relation by classes: a row per title."""
    return similar_groups(fx.headline_feed(spark, sf_dir))[0]


def headline_class_links(spark, sf_dir):
    """And a row per pair of similar classes."""
    return similar_groups(fx.headline_feed(spark, sf_dir))[1]


def headline_clusters_batches(spark, sf_dir):
    """Coverage kept up to date over three batches in order, one of which comes twice."""
    titles = write_through(fx.headline_feed(spark, sf_dir), "headlines")
    bounds = [None, *titles.approxQuantile("seq", [0.4, 0.7], 0.01), None]
    state = CoverageState(spark, new_path(spark, "coverage"))
    for batch in (0, 1, 1, 2):
        low, high = bounds[batch], bounds[batch + 1]
        rows = titles if low is None else titles.where(F.col("seq") > low)
        state.add(rows if high is None else rows.where(F.col("seq") <= high), batch)
    return state.coverage(titles).select("seq", "leader", "similar")


# ---- report and analyses -----------------------------------------------------------


def _covered(spark, sf_dir):
    return plans.covered_articles(_articles(spark, sf_dir))


def build_report(spark, sf_dir):
    return plans.newest_first(_covered(spark, sf_dir))


def build_report_documents(spark, sf_dir):
    """Long titles in any number: coverage by the exact key."""
    return plans.build_report(
        fx.document_entries(spark, sf_dir), fx.REGIONS, fx.INDUSTRIES, fx.START, fx.END, method="exact"
    )


def report_page(spark, sf_dir):
    return plans.page(_covered(spark, sf_dir), 1).select("seq", *[f"`{c}`" for c in REPORT.names])


def report_page_stored(spark, sf_dir):
    """The second page from the files of a report stored in order."""
    paged = PagedReport(spark, new_path(spark, "pages"))
    paged.store(_covered(spark, sf_dir))
    return paged.page(1).select("seq", *[f"`{c}`" for c in REPORT.names])


def report_page_after(spark, sf_dir):
    """The second page, found from the last row of the first one."""
    report = write_through(_covered(spark, sf_dir), "covered")
    last = plans.page(report, 0).select(SORT_COLUMN, "seq").collect()[-1]
    return plans.page_after(report, *last).select("seq", *[f"`{c}`" for c in REPORT.names])


def blank_terms_report(spark, sf_dir):
    """Terms of a given table that are blank once they are stripped: no article, the full schema."""
    blank = fx.table(spark, sf_dir, "region").select(F.translate("r_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "").alias("term"))
    return plans.build_report(fx.page_entries(spark, sf_dir), blank, fx.INDUSTRIES, fx.START, fx.END)


def wide_coverage_count(spark, sf_dir):
    return metrics.wide_coverage(_covered(spark, sf_dir))


def _labelled(spark, sf_dir):
    # these analyses do not read the coverage, so the titles are not compared
    return plans.labelled(_articles(spark, sf_dir))


def explode_counts_source(spark, sf_dir):
    return metrics.label_counts(_labelled(spark, sf_dir), "Sumber")


def explode_counts_region(spark, sf_dir):
    return metrics.label_counts(_labelled(spark, sf_dir), "Wilayah")


def explode_counts_industry(spark, sf_dir):
    return metrics.label_counts(_labelled(spark, sf_dir), "Usaha")


def keyword_topk(spark, sf_dir):
    return metrics.top_keywords(_labelled(spark, sf_dir))


def exclude_terms(spark, sf_dir):
    return metrics.searched_words(_labelled(spark, sf_dir))


def daily_trend(spark, sf_dir):
    return metrics.daily_trend(_labelled(spark, sf_dir))


def kpi_summary(spark, sf_dir):
    return metrics.kpis(_labelled(spark, sf_dir))


def stored_analyses(spark, sf_dir):
    """Every analysis of one stored report."""
    found = None
    for name, part in plans.analyses(_articles(spark, sf_dir)).items():
        part = part.select(F.lit(name).alias("analysis"), "label", "n")
        found = part if found is None else found.unionByName(part)
    return found


def rollup_analyses(spark, sf_dir):
    """Every analysis of fifteen days, summed from stored daily counts."""
    store = rollup.RollupStore(spark, new_path(spark, "days"))
    store.put(_labelled(spark, sf_dir))
    found = None
    for name, part in rollup.analyses(store.read(dt.date(2024, 1, 5), dt.date(2024, 1, 20))).items():
        part = part.select(F.lit(name).alias("analysis"), "label", "n")
        found = part if found is None else found.unionByName(part)
    return found


# ---- exports and runs ----------------------------------------------------------------


def export_public(spark, sf_dir):
    path = new_path(spark, "export")
    report = build_report(spark, sf_dir)
    export.write_csv(report, path)
    schema = export.public(report).schema
    return export.read_csv(spark, path, schema)


def export_table(spark, sf_dir):
    path = new_path(spark, "export")
    export.write_table(build_report(spark, sf_dir), path)
    return spark.read.parquet(path)


def land_range(spark, sf_dir):
    """Ten days of a feed landed by day; undated entries stay in."""
    path = new_path(spark, "landed")
    feed.land(fx.page_feed(spark, sf_dir), path, files_per_day=2)
    return feed.read_landed(spark, path, dt.date(2024, 1, 10), dt.date(2024, 1, 20))


def land_batches(spark, sf_dir):
    """The feed landed in nine batches, one of them twice; small batches are merged on the way."""
    path, entries = new_path(spark, "landed"), fx.page_feed(spark, sf_dir)
    for batch in (0, 1, 2, 3, 1, 4, 5, 6, 7, 8):
        feed.land(entries.where(F.col("seq") % 9 == batch), path, batch=f"batch-{batch}")
    return feed.read_landed(spark, path)


def nested_source(spark, sf_dir):
    """Entries whose source is an object with a title, as feeds deliver it; some have none."""
    path = new_path(spark, "landed")
    named = F.when(F.col("seq") % 3 != 0, F.struct(F.col("source").alias("title")))
    fx.page_feed(spark, sf_dir).withColumn("source", named).write.json(path)
    return feed.normalize(feed.read_feed(spark, path)).select("seq", "source")


def _runs(spark, sf_dir):
    """One run per day of events: its event types as terms, its span as period."""
    day = F.to_date("ts")
    kinds = F.sort_array(F.collect_set("event_type"))
    return (
        fx.table(spark, sf_dir, "events")
        .groupBy(day.alias("day"))
        .agg(
            kinds.alias("regions"),
            F.count("*").alias("rows"),
            F.max("ts").alias("run_at"),
            (F.count("*") / 8).alias("seconds"),
        )
        .select(
            F.date_format("day", "yyyyMMdd").alias("run_id"),
            F.date_trunc("minute", "run_at").cast("timestamp_ntz").alias("run_at"),
            "regions",
            F.slice("regions", 1, 2).alias("industries"),
            F.col("day").alias("start"),
            F.date_add("day", 30).alias("end"),
            "rows",
            "seconds",
        )
    )


def run_log_recent(spark, sf_dir):
    log = RunLog(spark, new_path(spark, "runs"))
    log.append(run_records(_runs(spark, sf_dir)))
    return log.recent()


def run_log_repeated(spark, sf_dir):
    """Every run logged twice, the second time with its final number of rows."""
    log = RunLog(spark, new_path(spark, "runs"))
    records = run_records(_runs(spark, sf_dir))
    log.append(records.withColumn("jumlah", F.lit(0).cast("long")))
    log.append(records)
    return log.all().select("run_id", "run_at", "jumlah")


def run_snapshot_load(spark, sf_dir):
    log = RunLog(spark, new_path(spark, "runs"))
    log.save_snapshot("first", _covered(spark, sf_dir))
    log.save_snapshot("second", plans.labelled(_articles(spark, sf_dir), F.lit(0).alias("Liputan Serupa")))
    return plans.newest_first(log.load_snapshot("first"))


def run_log_cleared(spark, sf_dir):
    """Runs logged, forgotten, and the newest one logged again."""
    log = RunLog(spark, new_path(spark, "runs"))
    records = run_records(_runs(spark, sf_dir))
    log.append(records)
    log.clear()
    log.append(records.orderBy(F.desc("run_id")).limit(1))
    return log.recent().select("run_id", "jumlah")


# ---------------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """The full report over the smallest tables."""
    return build_report(spark, FLAGSHIP_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "ref_terms_long": ref_terms_long,
        "ref_group_count": ref_group_count,
        "select_group_terms": select_group_terms,
        "feed_normalize": feed_normalize,
        "split_manual_terms": split_manual_terms,
        "clean_terms": clean_terms,
        "run_label": run_labels,
        "term_combinations": term_combinations,
        "date_windows": date_windows,
        "parse_published": parse_published,
        "match_articles": match_pages,
        "match_articles_many_terms": match_pages_many_terms,
        "merge_by_link": merge_pages,
        "merge_by_link_documents": merge_documents,
        "merge_by_link_batches": merge_documents_batches,
        "resolve_urls": resolve_urls,
        "resolve_urls_off": resolve_urls_off,
        "title_pairs": title_pairs,
        "title_pairs_exact": title_pairs_exact,
        "title_clusters": title_clusters,
        "similar_coverage_events": similar_events,
        "headline_pairs": headline_pairs,
        "headline_classes": headline_classes,
        "headline_class_links": headline_class_links,
        "headline_clusters_batches": headline_clusters_batches,
        "similar_coverage": similar_pages,
        "similar_coverage_exact_key": similar_pages_exact_key,
        "similar_coverage_exact_key_documents": similar_documents_exact_key,
        "build_report": build_report,
        "build_report_documents": build_report_documents,
        "report_page": report_page,
        "report_page_stored": report_page_stored,
        "report_page_after": report_page_after,
        "blank_terms_report": blank_terms_report,
        "wide_coverage_count": wide_coverage_count,
        "explode_counts_source": explode_counts_source,
        "explode_counts_region": explode_counts_region,
        "explode_counts_industry": explode_counts_industry,
        "keyword_topk": keyword_topk,
        "exclude_terms": exclude_terms,
        "daily_trend": daily_trend,
        "kpi_summary": kpi_summary,
        "stored_analyses": stored_analyses,
        "rollup_analyses": rollup_analyses,
        "export_public": export_public,
        "export_table": export_table,
        "land_range": land_range,
        "land_batches": land_batches,
        "nested_source": nested_source,
        "run_log_recent": run_log_recent,
        "run_log_repeated": run_log_repeated,
        "run_log_cleared": run_log_cleared,
        "run_snapshot_load": run_snapshot_load,
        **(llm.QUERIES if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    known = ORACLE | (llm.ORACLE if llm else {})
    return {name: known[name] for name in queries() if known.get(name)}
