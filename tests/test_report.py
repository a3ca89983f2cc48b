import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import fixtures as fx
from newsloom.operators import match, metrics
from newsloom.operators.merge import merge_by_link
from newsloom.operators.resolve import resolve_urls
from newsloom.plans import report as plans
from newsloom.schemas import REPORT, RESULT_COLUMNS, RUN, SNAPSHOT, empty_report
from newsloom.sinks import export
from newsloom.sinks.runs import RunLog, run_records
from newsloom.sources import feed, reference

SF_DIR = "/root/testdata/sf0.01"
DAY = dt.date(2024, 1, 1)


def entries(spark, *rows):
    raw = spark.createDataFrame(
        [(seq, title, published, link, "src") for seq, title, published, link in rows],
        "seq long, title string, published string, link string, source string",
    )
    return feed.entries(raw)


@pytest.mark.parametrize("scale,rows", [("sf0.001", 4), ("sf0.01", 65), ("sf0.1", 648)])
def test_known_number_of_articles(spark, scale, rows):
    sf_dir = f"/root/testdata/{scale}"
    assert registered.build_report(spark, sf_dir).count() == rows


def test_inline_and_joined_matching_agree(spark, monkeypatch):
    run = lambda: sorted(
        map(tuple, match.match_articles(
            fx.page_entries(spark, SF_DIR), ["the", "Of the", "–", "the"], [" in ", "and", "die die"],
            fx.START, fx.END,
        ).select("seq", "wilayah", "usaha").collect())
    )
    inline = run()
    monkeypatch.setattr(match, "INLINE_TERMS", 1)
    assert run() == inline and len(inline) > 20


def test_repeated_entries_are_matched_each_time(spark, monkeypatch):
    twice = entries(spark, *[(7, "papua beras", "", "l")] * 2)
    ways = []
    for limit in (128, 0):
        monkeypatch.setattr(match, "INLINE_TERMS", limit)
        hits = match.match_articles(twice, ["papua"], ["beras"], DAY, dt.date(2024, 2, 1))
        ways.append(sorted(map(tuple, hits.select("seq", "wilayah", "usaha").collect())))
    assert ways[0] == ways[1] and len(ways[0]) == 2
    with pytest.raises(ValueError):
        match.match_articles(twice, ["papua"], ["beras"], dt.date(2024, 2, 1), DAY)


def test_merge_keeps_the_first_entry_and_all_tags(spark):
    hits = match.match_entries(
        entries(spark, (5, "Papua beras", "n/a", "l"), (2, "Papua jagung", "", "l"),
                (3, "Papua", "", "l"), (9, "beras jagung Biak", "", "m"), (1, "beras", "", "l")),
        ["Papua", "Biak"], ["beras", "jagung"], DAY, dt.date(2024, 2, 1),
    )
    rows = {r.link: r for r in merge_by_link(hits).collect()}
    assert (rows["l"].seq, rows["l"].title, rows["l"].regions, rows["l"].industries) == (
        2, "Papua jagung", ["Papua"], ["beras", "jagung"],
    )
    assert rows["m"].regions == ["Biak"]
    # one row per pair gives the same
    flat = match.match_articles(
        entries(spark, (9, "beras jagung Biak", "", "m")), ["Biak"], ["beras", "jagung"], DAY, dt.date(2024, 2, 1)
    )
    assert flat.count() == 2
    assert merge_by_link(flat).first().industries == ["beras", "jagung"]


def test_range_bounds(spark):
    rows = entries(
        spark, (1, "a b", "Mon, 01 Jan 2024 00:00:00 GMT", "1"), (2, "a b", "Tue, 02 Jan 2024 00:00:00 GMT", "2"),
        (3, "a b", "n/a", "3"),
    )
    found = lambda s, e: sorted(r.seq for r in plans.build_articles(rows, ["a"], ["b"], s, e).collect())
    assert found(DAY, dt.date(2024, 1, 2)) == [1, 3]
    assert found(DAY, DAY) == []
    with pytest.raises(ValueError):
        found(dt.date(2024, 1, 2), DAY)


def test_empty_terms_give_an_empty_report(spark):
    rows = entries(spark, (1, "a b", "", "1"))
    for regions, industries in ([], ["b"]), (["a"], [" "]), (["–"], ["b"]):
        report = plans.build_report(rows, regions, industries, DAY, dt.date(2024, 1, 2))
        assert report.schema.names == REPORT.names and report.count() == 0
    assert empty_report(spark).schema == REPORT


def test_resolution(spark):
    articles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "link string")
    known = spark.createDataFrame(
        [("a", "A", True), ("a", None, False), ("b", "B", False), ("c", None, True)],
        "link string, decoded_url string, status boolean",
    )
    rows = {r.link: (r.url, r.status) for r in resolve_urls(articles, known).collect()}
    assert rows == {
        "a": ("A", "Asli"), "b": ("b", "Redirect Google News"),
        "c": ("c", "Redirect Google News"), "d": ("d", "Redirect Google News"),
    }


def test_order_and_pages(spark):
    rows = [
        (i, f"x{i} a b", f"Mon, {d:02d} Jan 2024 00:00:00 GMT" if d else "", str(i))
        for i, d in enumerate([3, 0, 5, 3, 4])
    ]
    articles = plans.build_articles(entries(spark, *rows), ["a"], ["b"], DAY, dt.date(2024, 2, 1))
    covered = plans.covered_articles(articles)
    order = [r.URL for r in plans.newest_first(covered).collect()]
    assert order == ["2", "4", "0", "3", "1"]
    assert [r.URL for r in plans.page(covered, 1, rows=2).collect()] == ["0", "3"]
    rows, seen = plans.page(covered, 0, rows=2).collect(), []
    while rows:
        seen += [r.URL for r in rows]
        rows = plans.page_after(covered, rows[-1].TanggalSort, rows[-1].seq, rows=2).collect()
    assert seen == order


def report_rows(spark, *cells):
    blank = {c: None for c in REPORT.names}
    return spark.createDataFrame([tuple({**blank, **c}[n] for n in REPORT.names) for c in cells], REPORT)


def test_label_counts_split_and_skip_blanks(spark):
    cells = ["b", "a", "a, b", "", "x,y", None]
    df = report_rows(spark, *[{"Sumber": c} for c in cells])
    counts = [tuple(r) for r in metrics.label_counts(df, "Sumber").collect()]
    assert counts == [("x,y", 1), ("b", 2), ("a", 2)]
    assert [tuple(r) for r in metrics.label_counts(df, "Sumber", top=1).collect()] == [("a", 2)]


def test_keywords_and_kpis(spark):
    df = report_rows(
        spark,
        {"Judul": "Harga Beras naik tahun ini", "Wilayah": "Papua Barat", "Usaha": "beras", "Sumber": "s"},
        {"Judul": "Harga jagung di papua, harga!", "Wilayah": "Papua Barat, Biak", "Usaha": "a, ", "Sumber": None},
    )
    assert [tuple(r) for r in metrics.top_keywords(df).collect()] == [("naik", 1), ("jagung", 1), ("harga", 3)]
    assert sorted(r.word for r in metrics.searched_words(df).collect()) == ["barat", "beras", "biak", "papua"]
    assert tuple(metrics.kpis(df).first()) == (2, 1, 2, 3)
    assert tuple(metrics.kpis(empty_report(spark)).first()) == (0, 0, 0, 0)
    assert metrics.daily_trend(df).count() == 0


def test_reference_lists(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("Utara,Selatan,Kosong\nA,B,\nC,,\n", encoding="utf-8")
    wide = reference.read_wide(spark, str(path))
    assert reference.group_names(wide) == ["Utara", "Selatan", "Kosong"]
    assert sorted(map(tuple, reference.members(wide).collect())) == [
        ("Selatan", "B"), ("Utara", "A"), ("Utara", "C"),
    ]
    picked = reference.select_terms(wide, ["Utara", "Kosong", "Timur"])
    assert sorted(r.term for r in picked.collect()) == ["A", "C", "Timur"]
    assert reference.select_terms(wide, []).count() == 0


def test_csv_export(spark, tmp_path):
    df = report_rows(
        spark, {"Judul": 'a "b", c\nd ', "Sumber": "", "Liputan Serupa": 2, "Wilayah": "é", "Tanggal": "-"},
    )
    path = str(tmp_path / "csv")
    export.write_csv(df, path)
    part = next(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfTanggal,Judul,")
    back = export.read_csv(spark, path, export.public(df).schema)
    assert back.columns == RESULT_COLUMNS
    row = back.first()
    assert row.Judul == 'a "b", c\nd ' and row.Wilayah == "é" and row["Liputan Serupa"] == 2 and row.URL is None
    export.write_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).columns == RESULT_COLUMNS


def test_run_log(spark, tmp_path):
    base = dt.datetime(2024, 2, 1)
    runs = spark.createDataFrame(
        [(f"r{i:02d}", base + dt.timedelta(hours=i), list("abcde"), ["x"], DAY, dt.date(2024, 2, 1), i, i / 3)
         for i in range(12)],
        "run_id string, run_at timestamp_ntz, regions array<string>, industries array<string>, "
        "start date, end date, rows int, seconds double",
    )
    log = RunLog(spark, str(tmp_path / "runs"))
    log.append(run_records(runs.where("rows < 6")))
    log.append(run_records(runs.where("rows >= 6")))
    recent = log.recent().collect()
    assert [r.jumlah for r in recent] == list(range(11, 3, -1))
    assert tuple(recent[0][2:]) == (
        "01 Feb 2024, 11:00", "a, b, c +2 lainnya", "x", "01 Jan 2024 – 01 Feb 2024", 11, "3.7s",
    )
    for run, title in ("r1", "one"), ("r2", "two"), ("r2", "again"):
        rows = report_rows(spark, {"Judul": title}, {"Judul": "later", "TanggalSort": dt.datetime(2024, 1, 2)})
        log.save_snapshot(run, rows.withColumn("seq", F.length("Judul").cast("long")))
    loaded = log.load_snapshot("r2")
    assert loaded.schema.names == SNAPSHOT.names
    assert [r.Judul for r in plans.newest_first(loaded).collect()] == ["later", "again"]
    log.clear()
    assert log.recent().count() == 0 and log.all().schema == RUN
    assert log.load_snapshot("r1").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_uses_a_cross_join(spark):
    for name in registered.oracle_sql():
        plan = plan_of(registered.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_articles_shuffle_once_and_prune(spark):
    articles = plans.build_articles(
        fx.page_entries(spark, SF_DIR), fx.REGIONS, fx.INDUSTRIES, fx.START, fx.END
    )
    plan = plan_of(articles)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters: [IsNotNull(url)" in plan
    trend = plan_of(fx.table(spark, SF_DIR, "documents").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in trend


def test_lookup_of_addresses_reuses_the_partitioning(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registered._articles(spark, SF_DIR).select("link", "url", "title"))
        # one for the hits, one for the addresses, none for their join
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_trend_uses_the_senders_day(spark):
    articles = plans.build_articles(
        entries(spark, (1, "a b", "Mon, 01 Jan 2024 23:30:00 -0700", "1")), ["a"], ["b"], DAY, dt.date(2024, 2, 1)
    )
    row = plans.labelled(articles).select("Tanggal", "TanggalSort").first()
    assert tuple(row) == ("01 Jan 2024", dt.datetime(2024, 1, 2, 6, 30))
    assert metrics.daily_trend(plans.labelled(articles)).first().day == DAY
    assert metrics.daily_trend(plans.labelled(articles).drop("published_local")).select(
        F.col("day").cast("string")
    ).first()[0] == "2024-01-02"
