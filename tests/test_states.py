"""Versions of immutable parts, and what is kept in them across batches."""

import datetime as dt
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import fixtures as fx
from newsloom.operators import match, metrics, rollup, similarity
from newsloom.operators.merge import merge_by_link
from newsloom.operators.mergestate import MERGED, MergeState
from newsloom.operators.resolve import addresses
from newsloom.plans import report as plans
from newsloom.plans.coverage import CoverageState
from newsloom.plans.pages import PagedReport
from newsloom.sinks.runs import RunLog
from newsloom.sources import feed
from newsloom.versions import Conflict, Versions, merge_small
from test_similarity import clusters, frame, random_titles

SF_DIR = "/root/testdata/sf0.01"
DAY = dt.date(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- versions ---------------------------------------------------------------------


def test_the_second_writer_of_a_version_fails(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert table.current() == (0, {})
    table.publish(0, {"a": 1})
    with pytest.raises(Conflict):
        table.publish(0, {"a": 2})
    assert table.current() == (1, {"a": 1})
    assert [f.name for f in (tmp_path / "t/versions").iterdir() if f.name.startswith(".") and f.suffix != ".crc"] == []


def test_a_change_is_made_again_from_the_newer_state(spark, tmp_path):
    table, tries = Versions(spark, str(tmp_path / "t")), []

    def make(state):
        if not tries:
            Versions(spark, table.path).publish(0, {"n": 10})
        tries.append(state)
        return {"n": state.get("n", 0) + 1}

    assert table.change(make) == {"n": 11} and len(tries) == 2
    assert table.change(lambda state: None) == {"n": 11} and table.current()[0] == 2


def test_unused_parts_are_deleted_when_old_enough(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    kept, lost = table.write(spark.range(3), "x"), table.write(spark.range(4), "x")
    assert table.drop_unused({kept}, older_than=3600) == []
    assert table.drop_unused({kept}, older_than=0) == [lost]
    assert table.read([kept], "id long").count() == 3


def test_merging_leaves_few_parts_of_each_size():
    parts, rewritten = [], 0

    def merged(several):
        nonlocal rewritten
        rewritten += sum(p["rows"] for p in several)
        return {"rows": sum(p["rows"] for p in several)}

    for _ in range(1000):
        parts = merge_small([*parts, {"rows": 1}], 4, merged)
    assert sum(p["rows"] for p in parts) == 1000 and len(parts) < 3 * 5 and rewritten <= 5 * 1000


# ---- run log ----------------------------------------------------------------------


def _runs(spark, *rows):
    return spark.createDataFrame(
        [(i, dt.datetime(2024, 2, 1) + dt.timedelta(hours=h), "", "", "", "", n, "") for i, h, n in rows],
        "run_id string, run_at timestamp_ntz, waktu string, wilayah string, usaha string, periode string, "
        "jumlah long, durasi string",
    )


def test_a_repeated_run_is_one_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("newsloom.sinks.runs.MANY_PARTS", 3)
    log = RunLog(spark, str(tmp_path / "runs"))
    for n in range(8):
        log.append(_runs(spark, ("a", 1, n), (f"r{n}", 2 + n, n)))
    log.append(_runs(spark, ("a", 1, 7)))
    found = log.all().collect()
    assert len(found) == 9 and {r.jumlah for r in found if r.run_id == "a"} == {7}


def test_readers_outlive_a_clear_and_a_crash_changes_nothing(spark, tmp_path, monkeypatch):
    log = RunLog(spark, str(tmp_path / "runs"))
    log.append(_runs(spark, ("a", 1, 1)))
    before = log.all()
    log.clear()
    assert log.recent().count() == 0 and before.count() == 1
    log.append(_runs(spark, ("b", 1, 1)))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(Versions, "publish", crash)
        with pytest.raises(OSError):
            log.append(_runs(spark, ("c", 1, 1)))
    assert [r.run_id for r in log.all().collect()] == ["b"]
    assert len(log.drop_unused(older_than=0)) == 2 and log.all().count() == 1


# ---- landing ----------------------------------------------------------------------


def _raw(spark, batch, rows):
    return spark.createDataFrame(
        [(batch * 100 + k, f"t{k}", f"Mon, {1 + k % 3:02d} Jan 2024 00:00:00 GMT" if k % 4 else "", f"l{k}", "s")
         for k in range(rows)],
        "seq long, title string, published string, link string, source string",
    )


def test_a_batch_landed_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "feed")
    for batch in (1, 2, 1):
        feed.land(_raw(spark, batch, 12), path, batch=f"b{batch}")
    found = feed.read_landed(spark, path)
    assert found.count() == 24 and found.select("seq").distinct().count() == 24
    assert feed.read_landed(spark, str(tmp_path / "none")).count() == 0


def test_files_of_a_day_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "FAN_IN", 3)
    path = str(tmp_path / "feed")
    for batch in range(12):
        feed.land(_raw(spark, batch, 9), path, files_per_day=2, batch=str(batch))
    days = feed.read_landed(spark, path, DAY, dt.date(2024, 1, 2))
    assert days.where("published <> ''").select(F.to_date("published_local")).distinct().count() == 1
    assert feed.read_landed(spark, path).count() == 12 * 9
    files = [f for f in days.where("published_local is not null").inputFiles()]
    per_day = [len([f for f in files if f"day=2024-01-{d:02d}" in f]) for d in (1, 2, 3)]
    assert 0 < max(per_day) <= 2 * 2 * 4
    assert "PartitionFilters" in plan_of(days) and "day#" in plan_of(days)


# ---- merge state ------------------------------------------------------------------


def _hits(spark, seed, batch):
    rng = random.Random(seed * 1000 + batch)
    rows = [
        (batch * 1000 + k, f"t{batch}-{k}", f"l{rng.randrange(60)}", [rng.choice("abc")], sorted(rng.sample("xyz", 2)))
        for k in range(40)
    ]
    made = spark.createDataFrame(rows, "seq long, title string, link string, regions array<string>, industries array<string>")
    return made.selectExpr(
        "*", "'s' as source", "'' as published", "cast(null as timestamp_ntz) as published_local",
        "cast(null as timestamp_ntz) as published_at",
    )


def test_merged_batches_equal_one_merge(spark, tmp_path):
    state = MergeState(spark, str(tmp_path / "m"), buckets=8)
    assert state.articles().count() == 0
    batches = [_hits(spark, 1, b) for b in (3, 1, 2, 0)]
    for k, hits in enumerate([*batches, batches[1]]):
        state.add(hits, f"b{min(k, 4) if k < 4 else 1}")
    every = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3])
    assert rows_of(state.articles()) == rows_of(merge_by_link(every).select(*MERGED.names))


def test_buckets_that_a_batch_does_not_touch_are_not_read(spark, tmp_path):
    state = MergeState(spark, str(tmp_path / "m"), buckets=64)
    state.add(_hits(spark, 2, 0), "first")
    held = dict(state._versions.current()[1]["buckets"])
    link = sorted(r.link for r in _hits(spark, 2, 1).collect())[0]
    one = _hits(spark, 2, 1).where(F.col("link") == link).limit(1)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(link)), F.lit(64))).first()[0]
    for part in set(held.values()):  # a bucket that may not be read cannot be
        for folder in (tmp_path / "m" / part).glob("bucket=*"):
            if folder.name != f"bucket={bucket}":
                for file in folder.glob("*.parquet"):
                    file.write_bytes(b"unreadable")
                for file in folder.glob(".*.crc"):
                    file.unlink()
    state.add(one, "second")
    now = state._versions.current()[1]["buckets"]
    assert sum(now[b] != part for b, part in held.items()) <= 1 and len(now) >= len(held)


# ---- coverage in batches -----------------------------------------------------------


@pytest.mark.parametrize("seed", [4])
def test_clusters_of_ten_batches_equal_those_of_all_rows(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr("newsloom.plans.coverage.FAN_IN", 3)
    titles = random_titles(seed, 150)
    rows, state = frame(spark, titles), CoverageState(spark, str(tmp_path / "c"))
    for batch in range(10):
        part = rows.where((F.col("seq") >= batch * 15) & (F.col("seq") < batch * 15 + 15))
        state.add(part, batch)
        if batch in (0, 4):
            seen = titles[: batch * 15 + 15]
            found = {r.seq: r.leader for r in state.coverage(frame(spark, seen)).collect()}
            assert [found[i] for i in range(len(seen))] == clusters(seen)
    state.add(rows.where("seq < 15"), 0)
    assert rows_of(state.coverage(rows)) == rows_of(similarity.similar_coverage(rows))


def test_late_rows_redo_the_clusters_from_their_place(spark, tmp_path):
    titles = random_titles(9, 90)
    rows, state = frame(spark, titles), CoverageState(spark, str(tmp_path / "c"))
    for batch, low in enumerate((0, 60, 30)):
        state.add(rows.where((F.col("seq") >= low) & (F.col("seq") < low + 30)), batch)
    assert rows_of(state.coverage(rows)) == rows_of(similarity.similar_coverage(rows))
    assert state.coverage(frame(spark, [])).count() == 0


@pytest.mark.parametrize("first", [20])
def test_leaders_found_in_batches_are_those_of_the_sequential_rule(spark, monkeypatch, first):
    monkeypatch.setattr(similarity, "FIRST_BATCH", first)
    titles = random_titles(first, 110)
    found = {r.seq: r.leader for r in similarity.similar_coverage(frame(spark, titles)).collect()}
    assert [found[i] for i in range(len(titles))] == clusters(titles)


def test_cross_pairs_are_the_pairs_between_two_tables(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_TILE_LEAST", 8)
    rows = frame(spark, random_titles(12, 130))
    nodes = similarity.write_through(similarity.title_nodes(rows), "nodes")
    one = similarity.write_through(nodes.where("node % 3 = 0"), "one")
    other = similarity.write_through(nodes.where("node % 3 <> 0"), "other")
    expected = similarity.node_pairs(nodes).where("(i % 3 = 0) <> (j % 3 = 0)")
    assert rows_of(similarity.cross_pairs(one, other)) == rows_of(expected)
    assert similarity.cross_pairs(one, other.limit(0)).count() == 0


def test_a_class_of_many_titles_takes_a_row_each(spark):
    words = [f"kata{k}" for k in range(9)]
    rng = random.Random(8)
    titles = list({" ".join(rng.sample(words, 9)) for _ in range(3000)})
    rows = frame(spark, titles + ["kata0 kata1"])
    members, links = similarity.similar_groups(rows)
    assert members.count() == len(titles) + 1 and links.count() == 1
    assert members.select("class", "class_size").distinct().count() == 2


@pytest.mark.parametrize("method", ["fuzzy", "exact"])
def test_groups_say_the_same_as_pairs(spark, method):
    rows = frame(spark, random_titles(21, 140))
    groups = similarity.similar_groups(rows, method=method)
    assert rows_of(similarity.expanded(*groups)) == rows_of(similarity.similar_pairs(rows, method=method))
    sizes = groups[0].groupBy("class").agg(F.count("*").alias("n"), F.max("class_size").alias("m"), F.min("seq").alias("s"))
    assert sizes.where("n <> m or class <> s").count() == 0


# ---- addresses and phrases ---------------------------------------------------------


def test_resolutions_of_other_links_do_not_reach_the_shuffle(spark):
    links = spark.range(50).selectExpr("concat('l', id) as link")
    table = spark.range(100_000).selectExpr("concat('l', id) as link", "concat('u', id) as decoded_url", "true as status")
    found = addresses(table, links)
    plan = plan_of(found)
    filtered, shuffled = plan.rindex("BroadcastHashJoin"), plan.index("Exchange hashpartitioning")
    assert shuffled < filtered  # the tree prints the last step first
    assert found.where("link < 'm'").join(links, "link").count() == 50 and found.count() < 300


def test_long_lists_shuffle_only_places_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(match, "INLINE_TERMS", 0)
    titles = [f"berita nomor {k} dari kota besar" for k in range(200)] + ["harga beras naik tajam", "beras"]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(titles)], "_entry long, text array<string>")
    terms = spark.createDataFrame(
        [(" harga beras naik ", "x", "r"), (" kota besar tajam ", "y", "r"), (" beras ", "z", "i"), (" jauh kota ", "w", "i")],
        "phrase string, term string, kind string",
    )
    anchors = match.anchored(terms, rows)
    assert rows_of(anchors.select("word", "at", "term")) == [("beras", 0, "z"), ("harga", 0, "x"), ("tajam", 2, "y")]
    # all sequences of up to three words would be over 2,900 rows
    assert match.anchor_places(rows, anchors).count() == 4


def test_phrases_at_both_ends_and_repeated(spark, monkeypatch):
    raw = spark.createDataFrame(
        [(1, "a b a b c", "", "l1", "s"), (2, "c", "", "l2", "s"), (3, "b c a", "", "l3", "s"), (4, "", "", "l4", "s")],
        "seq long, title string, published string, link string, source string",
    )
    ways = []
    for limit in (128, 0):
        monkeypatch.setattr(match, "INLINE_TERMS", limit)
        hits = match.match_articles(
            feed.entries(raw), ["a b", "B", "c", "a b a b c", "c a b"], ["b c", "a", "c a", "z"], DAY, dt.date(2024, 2, 1)
        )
        ways.append(rows_of(hits.select("seq", "wilayah", "usaha")))
    assert ways[0] == ways[1] and len(ways[0]) > 10


# ---- pages and rollups -------------------------------------------------------------


def _covered(spark):
    articles = plans.build_articles(fx.page_entries(spark, SF_DIR), fx.REGIONS, fx.INDUSTRIES, fx.START, fx.END)
    return similarity.write_through(plans.labelled(articles, F.lit(0).alias("Liputan Serupa")), "covered")


def test_stored_pages_equal_sorted_pages(spark, tmp_path):
    covered, paged = _covered(spark), PagedReport(spark, str(tmp_path / "p"))
    assert paged.page(0).count() == 0
    paged.store(covered, files=5)
    assert paged.rows() == covered.count() == 65
    for number in (0, 1, 3, 6, 7, 10_000):
        columns = ["seq", "URL", "TanggalSort"]
        expected = plans.page(covered, number).select(*columns).collect()
        assert paged.page(number).select(*columns).collect() == expected
        assert len(expected) == max(0, min(10, 65 - 10 * number))
    old = paged.page(2)
    paged.store(covered.limit(3), files=2)
    assert old.count() == 10 and paged.rows() == 3


def test_a_page_reads_its_files_only(spark, tmp_path):
    rows = spark.range(50_000).selectExpr(
        "id as seq", "'t' as Tanggal", "timestamp_ntz'2024-01-01' - make_dt_interval(0, 0, 0, id) as TanggalSort", "'j' as Judul",
        "'s' as Sumber", "'w' as Wilayah", "'u' as Usaha", "0 as `Liputan Serupa`", "'r' as `Status URL`", "'l' as URL",
    )
    paged = PagedReport(spark, str(tmp_path / "p"))
    paged.store(rows, files=20)
    page = paged.page(4_000)
    files = {re.search("range=[0-9]+", f)[0] for f in page.inputFiles()}
    assert len(files) <= 2 and [r.seq for r in page.collect()] == list(range(40_000, 40_010))
    assert "PushedFilters: [IsNotNull(_place)" in plan_of(page)


@pytest.mark.parametrize("days", [(0, 60), (-30, 5), (3, 4), (9, 9), (100, 200)])
def test_rollups_give_the_analyses_of_any_range(spark, days):
    covered = _covered(spark)
    start, end = (DAY + dt.timedelta(days=d) for d in days)
    counts = rollup.between(rollup.daily_counts(covered), start, end)
    part = match.in_range(covered, start, end)
    for column in ("Sumber", "Wilayah", "Usaha"):
        assert rollup.label_counts(counts, column).collect() == metrics.label_counts(part, column).collect()
    assert rollup.top_keywords(counts).collect() == metrics.top_keywords(part).collect()
    assert rollup.daily_trend(counts).collect() == metrics.daily_trend(part).collect()
    assert rollup.kpis(counts).collect() == metrics.kpis(part).collect()


def test_stored_days_are_replaced_and_pruned(spark, tmp_path):
    covered, store = _covered(spark), rollup.RollupStore(spark, str(tmp_path / "r"))
    day = F.to_date("published_local")
    store.put(covered.where(day.isNull() | (day < dt.date(2024, 1, 15))))
    store.put(covered.where(day >= dt.date(2024, 1, 10)))
    assert rows_of(store.read()) == rows_of(rollup.daily_counts(covered))
    low, high = dt.date(2024, 1, 8), dt.date(2024, 1, 20)
    some = store.read(low, high)
    assert rows_of(some) == rows_of(rollup.between(rollup.daily_counts(covered), low, high))
    read = {re.search("of=([^/]+)", f)[1] for f in some.inputFiles()}
    assert read and all(d == "undated" or "2024-01-08" <= d < "2024-01-20" for d in read)
    assert store.read(low, low).count() == 0
