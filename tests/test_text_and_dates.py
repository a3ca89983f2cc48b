import datetime as dt
from email.utils import format_datetime, parsedate_to_datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import dates, text
from newsloom.operators import terms
from newsloom.sources import feed

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, made):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(made(F.col("v"))).collect()]


@FEW
@given(st.lists(st.text(max_size=30), min_size=40, max_size=40))
def test_strip_and_terms_agree_with_python(spark, values):
    values = [v.replace("\x00", "") for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    expected = [
        [p.strip() for line in v.splitlines() for p in line.split(",") if p.strip()] for v in values
    ]
    assert column(spark, values, text.split_terms) == expected
    assert column(spark, values, text.phrase_text) == [text.phrase_of(v) for v in values]
    assert column(spark, values, text.split_on_space) == [v.split() for v in values]


def test_split_manual_keeps_order(spark):
    df = spark.createDataFrame([(1, "A, B\r\n C ,,\n")], "id int, text string")
    rows = terms.split_manual(df, "text").orderBy("pos").collect()
    assert [(r.id, r.pos, r.term) for r in rows] == [(1, 0, "A"), (1, 1, "B"), (1, 2, "C")]


def test_run_label(spark):
    df = spark.createDataFrame([(list("abcde"),), (["a", "b"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(text.run_label(F.col("t"))).collect()] == ["a, b, c +2 lainnya", "a, b", ""]


def test_title_key(spark):
    values = ["Harga  BERAS, naik!", "harga beras naik", "—", "É a"]
    assert column(spark, values, text.title_key) == ["harga beras naik", "harga beras naik", "", "a"]


def parse(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, published string")
    df = dates.parse_published(df).orderBy("i")
    label = dates.date_label(F.col("published"), F.col("published_local"))
    return [tuple(r) for r in df.select("published_local", "published_at", label).collect()]


def expected_date(value):
    if not value:
        return None, None, "-"
    try:
        moment = parsedate_to_datetime(value)
    except Exception:
        return None, None, value
    utc = moment.astimezone(dt.timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment
    return moment.replace(tzinfo=None), utc, moment.strftime("%d %b %Y")


SAMPLES = [
    "Tue, 19 Aug 2025 07:00:00 GMT", "Tue, 19 Aug 2025 23:30:00 +0700", "19 Aug 25 07:00",
    "19 Aug 99 07:00:00 EST", "19 Aug 68 07:00 PDT", "x", "", "19 August 2025 1:2:3 -0000",
    "Tue 19 Aug 2025 07:00:00 Z", "19-Aug-2025 07:00:00 GMT", "Aug 19 2025 07:00:00 +0530",
    "Tue, 31 Feb 2025 07:00:00 GMT", "Tue, 19 Aug 2025 24:00:00 GMT", "Tue, 19 Aug 2025 07:00:60 GMT",
    "Tue, 19 Aug 2025 07:00:00 XYZ", "Tue, 19 Aug 2025 07:00:00 -0330", "2025-08-19 07:00:00",
    "Tue, 19 Foo 2025 07:00:00 GMT", "Tue, 19 Aug 2025 07:00:00 -0700 (PDT)", "n/a",
    "Tue, 19 Aug 2025 07.00.00 GMT", "19 Aug 2025 7.05", "Tue, 19 Aug 2025 07:00.00 GMT",
    "Tue Aug 19 07:00:00 2025", "Tue Aug 19 07:00:00 2025 +0700", "Aug 19 07:00 2025 EST",
    "19 Aug 07:00:00 2025", "Tue Aug 19 07:00:00 PDT 2025", "Tue Aug 19 07:00:00 +0530 2025",
    "Tue Aug 19 07.00.00 2025", "Thu, 29 Feb 2024 00:00:00 +1400", "Wed, 1 May 2024 09:05:00 CDT",
]


def test_dates_agree_with_the_standard_library(spark):
    assert parse(spark, SAMPLES) == [expected_date(v) for v in SAMPLES]


@FEW
@given(st.lists(
    st.datetimes(
        min_value=dt.datetime(1971, 1, 2), max_value=dt.datetime(2090, 1, 1),
        timezones=st.integers(-720, 840).map(lambda m: dt.timezone(dt.timedelta(minutes=m))),
    ), min_size=30, max_size=30,
))
def test_any_formatted_date_parses_back(spark, moments):
    values = [format_datetime(m.replace(microsecond=0)) for m in moments]
    assert parse(spark, values) == [expected_date(v) for v in values]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Jakarta", "America/Sao_Paulo"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert parse(spark, SAMPLES) == [expected_date(v) for v in SAMPLES]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_duration_label(spark):
    values = [4.25, 4.35, 0.35, 0.05, 12345.67, 0.0, 59.96, 2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(dates.duration_label(F.col("v"))).collect()] == [f"{v:.1f}s" for v in values]


def test_date_windows(spark):
    day = dt.date.fromisoformat
    ranges = spark.createDataFrame(
        [("a", day("2025-01-01"), day("2025-03-05")), ("b", day("2025-01-01"), day("2025-01-01")),
         ("c", day("2025-02-01"), day("2025-01-01"))], "id string, start date, end date",
    )
    rows = [tuple(map(str, r)) for r in terms.date_windows(ranges).orderBy("win_start").collect()]
    assert rows == [
        ("a", "2025-01-01", "2025-01-31"), ("a", "2025-01-31", "2025-03-02"), ("a", "2025-03-02", "2025-03-05"),
    ]


def test_feed_defaults(spark):
    raw = spark.createDataFrame(
        [(1, None, None, "l1", None), (2, "", "x", "l2", ""), (3, "t", "", "", "s"), (4, "t", "", None, "s")],
        "seq long, title string, published string, link string, source string",
    )
    rows = [tuple(r) for r in feed.normalize(raw).orderBy("seq").collect()]
    assert rows == [(1, "-", "", "l1", "-"), (2, "-", "x", "l2", "-")]


def test_landed_days_are_pruned(spark, tmp_path):
    raw = spark.createDataFrame(
        [(i, "t", f"Tue, {i:02d} Jan 2024 07:00:00 GMT" if i < 9 else "n/a", f"l{i}", "s") for i in range(1, 11)],
        "seq long, title string, published string, link string, source string",
    )
    feed.land(raw, str(tmp_path / "landed"), files_per_day=2)
    start, end = dt.date(2024, 1, 3), dt.date(2024, 1, 5)
    landed = feed.read_landed(spark, str(tmp_path / "landed"), start, end)
    assert sorted(r.seq for r in landed.collect()) == [3, 4, 9, 10]
    assert "PartitionFilters: [(isnull(day" in landed._jdf.queryExecution().toString()
