import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from newsloom.functions.lcs import lcs_length, matched_length
from newsloom.functions.tiles import aligned_in_tile
from newsloom.operators import similarity as sim
from newsloom.operators.resolve import resolve_urls
from newsloom.operators.skew import attach


def lcs(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(max(new[i], row[i + 1], row[i] + (x == y)))
        row = new
    return row[-1]


def score(a, b):
    a, b = set(a.split()), set(b.split())
    if not a or not b:
        return 0.0
    both, da, db = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
    if both and not (da and db):
        return 100.0
    la, lb = (len(both) + bool(both) + len(d) for d in (da, db))
    scores = [200.0 * (len(both) + bool(both) + lcs(da, db)) / (la + lb)]
    if both:
        scores += [200.0 * len(both) / (len(both) + n) for n in (la, lb)]
    return max(scores)


def clusters(titles, threshold=82):
    leader = {}
    for i, a in enumerate(titles):
        if i not in leader:
            leader[i] = i
            for j in range(i + 1, len(titles)):
                if j not in leader and round(score(a, titles[j])) >= threshold:
                    leader[j] = i
    return [leader[i] for i in range(len(titles))]


def random_titles(seed, count):
    rng = random.Random(seed)
    words = ["harga", "beras", "naik", "Naik", "turun", "di", "pasar", "é", "kota", "2024", "Kompas.com", "a", "ab"]
    made = []
    for _ in range(count):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
        if made and rng.random() < 0.5:
            title = list(rng.choice(made))
            for _ in range(rng.randint(0, 4)):
                if title:
                    title[rng.randrange(len(title))] = rng.choice("aeiou -")
            title = "".join(title)
        made.append(title)
    return made


def frame(spark, titles):
    return spark.createDataFrame(list(enumerate(titles)), "seq long, title string")


def test_lcs(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé 😀") for _ in range(rng.randint(0, n))) for n in [5, 40, 300] * 20]
    pairs = [(a, rng.choice(texts)) for a in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", lcs_length()("a", "b").alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in rows)


@pytest.mark.parametrize("seed,tile", [(1, 256), (2, 7)])
def test_pairs_and_clusters_agree_with_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(sim, "_TILE_LEAST", tile)
    titles = random_titles(seed, 160)
    rows = frame(spark, titles)
    found = {(r.i, r.j): r.score for r in sim.similar_pairs(rows).collect()}
    first = {}
    for i, t in enumerate(titles):
        if t.split():
            first.setdefault(t, i)
    nodes = sorted(first.values())
    expected = {
        (i, j): s for i in nodes for j in nodes if i < j and (s := score(titles[i], titles[j])) >= 81.5
    }
    assert len(expected) > 100
    assert found.keys() == expected.keys()
    assert all(abs(found[p] - s) < 1e-9 for p, s in expected.items())
    leaders = {r.seq: r.leader for r in sim.similar_coverage(rows).collect()}
    assert [leaders[i] for i in range(len(titles))] == clusters(titles)


def test_leaders_agree_with_the_sequential_rule(spark):
    rng = random.Random(3)
    edges, expected = [], {}
    for graph in range(300):
        size, base = rng.randint(2, 14), graph * 100
        chosen = {(i, j) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.25}
        chosen |= {(i, i + 1) for i in range(size - 1) if graph % 10 == 0}
        leading = []
        for j in range(size):
            near = [i for i in leading if (i, j) in chosen]
            if near:
                expected[base + j] = base + near[0]
            else:
                leading.append(j)
        edges += [(base + i, base + j, 100.0) for i, j in chosen]
    pairs = spark.createDataFrame(edges, "i long, j long, score double")
    assert {r.node: r.leader for r in sim.leaders(pairs).collect()} == expected
    with pytest.raises(RuntimeError):
        sim.leaders(pairs, max_rounds=1)


def test_non_transitive_and_missing_titles(spark):
    pairs = spark.createDataFrame([(1, 2, 90.0), (2, 3, 90.0)], "i long, j long, score double")
    assert [tuple(r) for r in sim.leaders(pairs).collect()] == [(2, 1)]
    rows = frame(spark, ["-", " ", "-", "", "beras naik"])
    got = [(r.leader, r.similar) for r in sim.similar_coverage(rows).orderBy("seq").collect()]
    assert got == [(0, 1), (1, 0), (0, 1), (3, 0), (4, 0)]
    assert sim.similar_coverage(frame(spark, [])).count() == 0


def test_methods(spark):
    rows = frame(spark, ["Harga beras naik", "harga BERAS, naik", "Harga beras naik 2024", "—", "!", "!"])
    fuzzy = [r.similar for r in sim.similar_coverage(rows).orderBy("seq").collect()]
    exact = [r.similar for r in sim.similar_coverage(rows, method="exact").orderBy("seq").collect()]
    assert fuzzy == [1, 0, 1, 0, 1, 1]
    assert exact == [1, 1, 0, 2, 2, 2]
    pairs = [tuple(r) for r in sim.similar_pairs(rows, method="exact").orderBy("i").collect()]
    assert pairs == [(0, 1, 100.0), (3, 4, 100.0)]
    with pytest.raises(ValueError):
        sim.similar_coverage(rows, method="other")


def test_exact_pairs_are_all_pairs_of_titles(spark):
    rows = frame(spark, ["A", "a", "A!", "b", "A"])
    assert sorted((r.i, r.j) for r in sim.similar_pairs(rows, method="exact").collect()) == [(0, 1), (0, 2), (1, 2)]


def test_titles_of_the_same_words_are_a_pair(spark):
    rows = frame(spark, ["harga beras naik", "naik beras harga", "naik beras harga"])
    assert [tuple(r) for r in sim.similar_pairs(rows).collect()] == [(0, 1, 100.0)]


def test_more_rows_than_any_limit(spark):
    """The relation does not depend on the number of rows."""
    titles = [f"berita nomor {k % 50} dari kota" for k in range(4500)] + ["harga beras naik", "naik beras harga!"]
    got = {r.seq: r.similar for r in sim.similar_coverage(frame(spark, titles)).collect()}
    assert got[4500] == got[4501] == 1 and clusters(titles[:50])[1] == 0
    assert got[0] == 4499


def test_hot_keys_are_split(spark):
    titles = ["hot title"] * 400 + [f"title {i % 150}" for i in range(600)]
    split = sim.similar_coverage(frame(spark, titles), method="exact")
    rows = sorted(map(tuple, split.collect()))
    assert rows[0] == (0, "hot title", 0, 399) and len(rows) == 1000
    assert rows[400] == (400, "title 0", 400, 3)
    assert len(re.findall("_hot_key", split._jdf.queryExecution().optimizedPlan().toString())) > 0


# rows, clusters, rows with similar coverage, largest cluster
KNOWN = {
    "sf0.001": ((50, 37, 26, 2), (37, 26)),
    "sf0.01": ((250, 182, 108, 15), (184, 104)),
    "sf0.1": ((2500, 1603, 1178, 129), (1648, 1125)),
}


@pytest.mark.parametrize("scale", KNOWN)
def test_known_answers(spark, scale):
    titles = fx.page_feed(spark, f"/root/testdata/{scale}").select("seq", "title")
    summary = lambda df: df.agg(
        F.count("*"), F.countDistinct("leader"), F.count_if(F.col("similar") > 0), F.max("similar") + 1
    ).first()
    fuzzy, exact = KNOWN[scale]
    assert tuple(summary(sim.similar_coverage(titles))) == fuzzy
    assert tuple(summary(sim.similar_coverage(titles, method="exact")))[1:3] == exact


def test_known_pairs(spark):
    titles = fx.page_feed(spark, "/root/testdata/sf0.1").select("seq", "title")
    assert sim.similar_pairs(titles).count() == 241
    titles = fx.page_feed(spark, "/root/testdata/sf0.01").select("seq", "title")
    assert sim.similar_pairs(titles).count() == 2


def test_sides_that_grow_by_their_words_and_tiles_are_not_broadcast(spark):
    titles = random_titles(21, 300)
    nodes = sim.write_through(sim.title_nodes(spark.createDataFrame(list(enumerate(titles)), "seq long, title string")), "nodes")
    plan = sim.node_pairs(nodes)._jdf.queryExecution().sparkPlan().toString()
    # only the hot words are, by a number
    joins = re.findall(r"(\w+Join) \[([a-z_]+)", plan)
    assert ("SortMergeJoin", "token") in joins and ("SortMergeJoin", "ba") in joins, joins
    assert {key for kind, key in joins if kind == "BroadcastHashJoin"} <= {"xxhash"}, joins


def test_coverage_and_addresses_broadcast_nothing_that_grows(spark, monkeypatch):
    written, write = [], sim.write_through
    keep = lambda df, label: written.append(df) or write(df, label)
    monkeypatch.setattr(sim, "write_through", keep)
    monkeypatch.setattr(sim, "FIRST_BATCH", 40)
    titles = random_titles(22, 300)
    found = sim.similar_coverage(frame(spark, titles))
    articles = spark.createDataFrame([("a",), ("b",)], "link string")
    known = spark.createDataFrame([("a", "A", True)], "link string, decoded_url string, status boolean")
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in [*written, found, resolve_urls(articles, known)]]
    joins = [join for plan in plans for join in re.findall(r"(\w+Join) \[([a-z_]+)", plan)]
    # hot keys by a number and a filter of bounded size are
    assert {key for kind, key in joins if kind == "BroadcastHashJoin"} <= {"xxhash", "pmod"}, joins
    assert {key for kind, key in joins if kind == "SortMergeJoin"} >= {"i", "j", "node", "link", "_spread_key"}, joins
    assert [r.leader for r in found.orderBy("seq").collect()] == clusters(titles)


def test_attach_finds_hot_and_other_keys_and_none(spark):
    rows = spark.createDataFrame([(i, "hot") for i in range(900)] + [(1000, "cold"), (1001, "none"), (1002, None)], "id long, k string")
    lookup = spark.createDataFrame([("hot", 900, 1), ("cold", 1, 2), ("other", 1, 3), (None, 1, 4)], "k string, n long, v int")
    for hint in (None, "merge"):
        found = attach(rows, lookup, "k", "n", 903, "id", hint).groupBy("k", "v").count().collect()
        assert sorted(map(tuple, found), key=str) == sorted([("hot", 1, 900), ("cold", 2, 1), ("none", None, 1), (None, None, 1)], key=str)


def test_matched_length_of_many_pairs_at_once(spark):
    rng = random.Random(5)
    words = ["a", "ab", "ba", "naik", "Naik", "é", "日本", "😀", "a\0", "\0\0b", "x" * 63, "y" * 64, "kota.", "ß" * 130, "beras"]
    long = " ".join(sorted(f"w{k}" for k in range(90)))
    sets = [" ".join(sorted(rng.sample(words, rng.randint(1, 6)))) for _ in range(120)] + [long, long[:240].strip(), long[3:]]
    pairs = [(a, b) for a in sets for b in rng.sample(sets, 50)]
    rows = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    found = rows.select("a", "b", matched_length()("a", "b").alias("n")).distinct().collect()
    assert len(found) == len(set(pairs))
    for r in found:
        a, b = r.a.split(" "), r.b.split(" ")
        both = set(a) & set(b)
        left, right = (" ".join(w for w in side if w not in both) for side in (a, b))
        assert r.n == sum(len(w) + 1 for w in both) + lcs(left, right), (r.a, r.b)


def tile_of(one, other, tile):
    titles = pa.list_(pa.struct([("node", pa.int64()), ("key", pa.string())]))
    sides = [pa.array([[{"node": n, "key": k} for n, k in side]], titles) for side in (one, other)]
    return pa.table([*(pa.array([t], pa.int32()) for t in tile), *sides], ["ba", "xa", "bb", "xb", "a", "b"])


@pytest.mark.parametrize("cutoff,words", [(81.5, 4), (81.5, 9), (60.5, 9), (99.5, 9), (30.5, 3), (81.5, 60)])
def test_a_tile_has_the_pairs_whose_texts_align(cutoff, words):
    rng = random.Random(words)
    known = ["harga", "beras", "naik", "Naik", "é", "日本", "😀", "x" * 63, "kota.", "pasar", "turun", "the", "ma\0n", "ß" * 64]
    keys = {}
    for _ in range(max(8, 300 // (words + 4))):
        key = " ".join(sorted({rng.choice(known) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(rng.randint(1, words))}))
        near = list(key)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = rng.choice("aeiou -z日")
        keys |= {key: 0, " ".join(sorted(set("".join(near).split(" ")) - {""})): 0}
    titles = [(k * 7919 % 100_003, key) for k, key in enumerate(keys) if key]
    half = len(titles) // 2

    def aligned(one, other, same):
        found = set()
        for (x, a), (y, b) in itertools.product(one, other):
            sa, sb = set(a.split(" ")), set(b.split(" "))
            # one within the other scores 100 by its words
            if sa <= sb or sb <= sa or (same and x >= y):
                continue
            length = sum(len(w) + 1 for w in sa & sb) + lcs(" ".join(sorted(sa - sb)), " ".join(sorted(sb - sa)))
            if 200 * length / (len(a) + len(b)) >= cutoff:
                found.add((min(x, y), max(x, y), length, len(a) + len(b)))
        return found

    within = {(x, y) for x, a in titles for y, b in titles if set(a.split(" ")) <= set(b.split(" "))}
    for one, other, tile in [(titles, titles, (1, 2, 1, 2)), (titles[:half], titles[half:], (1, 2, 1, 3))]:
        rows = aligned_in_tile(cutoff, True)(tile_of(one, other, tile)).to_pydict()
        pairs = [(min(x, y), max(x, y), m, t) for x, y, m, t in zip(*rows.values())]
        assert len(pairs) == len(set(pairs))
        expected = aligned(one, other, tile[:2] == tile[2:])
        assert expected or cutoff > 99
        assert {p for p in pairs if not {p[:2], p[1::-1]} & within} == expected


def test_blocks_are_sent_once_a_tile_and_not_the_texts_of_each_pair(spark):
    titles = random_titles(23, 200)
    nodes = sim.write_through(sim.title_nodes(frame(spark, titles)), "nodes")
    for pairs in (sim.node_pairs(nodes), sim.cross_pairs(nodes.where("node % 2 = 0"), nodes.where("node % 2 = 1"))):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "FlatMapGroupsInArrow" in plan
        assert not re.search(r"\bh0#", plan)


def test_a_title_of_many_rows_is_taken_apart_once(spark):
    titles = [t if k % 7 else None for k, t in enumerate(random_titles(24, 90))] * 3
    rows = frame(spark, titles)
    plan = sim.title_nodes(rows)._jdf.queryExecution().sparkPlan().toString()
    # from the top: titles come together below the step that makes their keys
    assert 0 < plan.index("Generate") < plan.index("keys=[title")
    found = {r.seq: (r.leader, r.similar) for r in sim.similar_coverage(rows).collect()}
    expected = clusters([t or "" for t in titles])
    alone = {k for k, t in enumerate(titles) if not (t or "").split()}
    for k in range(len(titles)):
        leader = k if k in alone else expected[k]
        assert found[k] == (leader, 0 if k in alone else expected.count(leader) - 1)


def test_known_leaders_make_batches_larger(spark, monkeypatch):
    monkeypatch.setattr(sim, "FIRST_BATCH", 4)
    words = [f"{c * 9}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQR"]
    nodes = sim.write_through(sim.title_nodes(frame(spark, words)), "nodes")
    leading = sim.write_through(nodes.where("node < 30"), "leading")
    seen, follow = [], sim.follow
    monkeypatch.setattr(sim, "follow", lambda *a: seen.append(1) or follow(*a))
    led = sim.follow_in_order(sim.write_through(nodes.where("node >= 30"), "late"), leading)
    assert led.where("node = leader").count() == 14 and len(seen) == 1
