"""HTML text and nearest neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import hnsw, htmltext


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def text_of(html):
    return htmltext._split(html)[0]


def test_article_alone():
    got = text_of(
        page(
            "<nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article class='post ad-free-reading'>"
            "<h1>A &amp; B</h1><p><b>one\n  two<br><p>three &lt;3 a < b</p><div class=\"box share-bar\"><p>Share</p></div>"
            "<aside>side</aside><form><p>mail</p></form><p class='cookieNotice'>We use</p><p>four</p>"
            "<section id=comments><p>reader</p></section><ul><li>x</li><li>y</li></ul><!-- <p>no</p> --></article>"
            "<footer>&copy; host</footer>"
        )
    )
    assert got == "A & B\none two\nthree <3 a < b\nfour\nx\ny"


def test_broken_markup():
    assert text_of("<article><p>one<div><p>two</article><p>after") == "one\ntwo"
    assert text_of("<article><p>one</div></p>two<script>never closed") == "one\ntwo"
    assert text_of("<main><article>a</article><article><p>longer text</p></article></main>") == "a\nlonger text"
    assert text_of("<article>a</article><p>x</p><article>b</article><article class=teaser>c</article>") == "a\nb"
    assert text_of("<article><div class='header'><h1>A</h1></div>b<div class=sidebar>c</div></article>") == "A\nb"
    assert text_of('<article><p title="a>b">one</p></article>') == "one"
    assert text_of("") is None and text_of("<article></article>") is None
    assert text_of("<article " * 5 + "x") is None


def plain_text(pages, run, least, share):
    """The text that each bare page keeps. ``pages``: (page_id, host, lines); a page may be repeated."""
    lists = {}  # strings of tokens and whole short lines, by the pages that hold them
    for page_id, host, lines in pages:
        tokens = [w for line in lines for w in line.split()]
        strings = {tuple(tokens[k : k + run]) for k in range(len(tokens) - run + 1)}
        strings |= {("block", line) for line in lines if len(line.split()) < run}
        for string in strings:
            lists.setdefault((host, string), set()).add(page_id)
    number = {}
    for page_id, host, _ in pages:
        number.setdefault(host, set()).add(page_id)
    gone = {x for x, own in lists.items() if len(own) >= max(least, share * len(number[x[0]]))}
    out = []
    for page_id, host, lines in pages:
        tokens = [w for line in lines for w in line.split()]
        hit = {
            j for k in range(len(tokens)) if (host, tuple(tokens[k : k + run])) in gone for j in range(k, k + run)
        }
        kept, at = [], 0
        for line in lines:
            words = line.split()
            left = [w for k, w in enumerate(words) if at + k not in hit]
            at += len(words)
            if left and (host, ("block", line)) not in gone:
                kept.append(" ".join(left))
        out.append((page_id, "\n".join(kept)))
    return sorted(out)


def bare_pages(spark, pages):
    rows = [
        (page_id, f"https://{host}/{page_id}?q#x", page("".join(f"<div>{x}</div>" for x in lines), head=""))
        for page_id, host, lines in pages
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("x"))


@pytest.mark.parametrize("sorted_at_once", [htmltext.SORTED, 50])
def test_repeated_runs_of_a_host_go(spark, monkeypatch, sorted_at_once):
    monkeypatch.setattr(htmltext, "SORTED", sorted_at_once)
    monkeypatch.setattr(htmltext, "MERGED", 40)
    draw = random.Random(6)
    menus = [" ".join(draw.choices("abcdefgh", k=n)) for n in (4, 7, 12)]
    pages = []
    for k in range(60):
        unique = " ".join(draw.choices([f"t{j}" for j in range(200)], k=20))
        lines = [draw.choice(menus), unique, draw.choice(menus), "seldom said" if k % 20 < 3 else "x"]
        pages += [(k, f"h{k % 3}.example", lines)] * (4 if k % 10 == 0 else 1)
    got = htmltext.extract(bare_pages(spark, pages), run=6, share=0.3).collect()
    expected = plain_text(pages, 6, 3, 0.3)
    assert sorted((r.page_id, r.text) for r in got) == expected
    assert all(r.n_chars == len(r.text) for r in got) and len({t for _, t in expected}) > 50


def test_nothing_is_lost_on_a_large_host(spark):
    """Phrases on a few of many bare pages stay, and so does a page that is repeated; the menu goes."""
    menu, phrase = "Home News Sport", "as the minister said on the day before yesterday"
    pages = []
    for k in range(600):
        own = f"page{k} " + " ".join(f"w{k * j % 977}" for j in range(30))
        pages.append((k, "big.example", [menu, own + (" " + phrase if k % 200 == 0 else ""), phrase if k % 150 == 1 else "y"]))
    pages += [pages[7]] * 40
    got = sorted((r.page_id, r.text) for r in htmltext.extract(bare_pages(spark, pages)).collect())
    assert got == sorted((i, "\n".join(x for x in lines if x not in (menu, "y"))) for i, _, lines in pages)


def test_articles_go_through_the_suffixes(spark):
    """What nearly all articles of a host hold goes, be it a line or part of one; copies and phrases stay."""
    draw = random.Random(4)
    said = lambda n: " ".join(draw.choices([f"t{j}" for j in range(500)], k=n))
    line, notice, phrase, copied = "Read our daily letter", said(40), said(30), [said(30) for _ in range(5)]
    rows, expected = [], {}
    for k in range(40):
        own = [said(60), said(50), phrase if k % 2 else "x"]
        held = [line, own[0] + " " + notice, own[1], own[2]] if k < 38 else own
        rows.append((k, "news.example", held))
        expected[k] = "\n".join(own)
        # one article with another last line on each page, and a host of few pages
        rows += [(100 + k, "copies.example", [*copied, f"page {k}"]), (200 + k, f"h{k // 9}.example", [line, own[0], notice])]
        expected |= {100 + k: "\n".join([*copied, f"page {k}"]), 200 + k: "\n".join([line, own[0], notice])}
    # the same article at other addresses counts once
    rows += [(300 + k, "same.example", [line, f"{copied[k // 20]} {copied[4]}"]) for k in range(40)]
    expected |= {300 + k: f"{line}\n{copied[k // 20]} {copied[4]}" for k in range(40)}
    table = spark.createDataFrame(
        [(i, f"https://{h}/{i}", page("<article>" + "".join(f"<p>{x}</p>" for x in held) + "</article>")) for i, h, held in rows],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.text for r in htmltext.extract(table).collect()}
    assert got == expected
    assert got[0] != text_of(table.where("page_id = 0").first().html)


def test_marks_depend_on_the_string_alone():
    draw = random.Random(9)
    words = [b"%d" % draw.randrange(30) for _ in range(300)]
    marks = htmltext._run_marks(words, 24)
    assert len(marks) == 277 and all(htmltext._run_marks(words[k : k + 24], 24)[0] == m for k, m in enumerate(marks))
    assert len(set(marks.tolist())) < 80 and len(htmltext._run_marks(words[:23], 24)) == 0


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "u", ""), (3, "u", "plain text"), (4, "u", "<article>" + "word " * 50_000 + "</article>"),
        (5, "v", "<p>same</p>"), (5, "v", "<p>same</p>"), (6, "v", "<p>" + "w" * 5000 + " x</p>" * 9),
    ]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = sorted((r.page_id, len(r.text)) for r in got)
    assert [t[0] for t in texts] == [1, 2, 3, 4, 5, 5, 6]
    assert texts[0][1] == texts[1][1] == 0 and texts[2][1] == 10 and texts[3][1] == 249_999
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract(none).collect() == []


def exact(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    matrix = np.array([r[1] for r in rows], float)
    out = {}
    for q in queries:
        score = matrix @ matrix[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 700)
    monkeypatch.setattr(hnsw, "QUERIES", 40)
    draw = np.random.default_rng(8)
    matrix = (draw.normal(size=(2000, 24)) * draw.uniform(0.5, 2, (2000, 1))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(matrix)]
    got = {}
    for r in hnsw.nearest(vectors(spark, rows), F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    best = exact(rows, range(0, 2000, 20), 20)
    hits = 0
    for q, own in best.items():
        assert sorted(got[q]) == list(range(1, 21))
        listed = [got[q][k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in own} & {v for v, _ in listed})
        score = dict(exact(rows, [q], 2000)[q])
        assert all(abs(score[v] - s) < 1e-12 for v, s in listed)
    assert hits >= 0.95 * 20 * len(best)


def test_ties_and_repeated_rows(spark, monkeypatch):
    """The smallest ids of thousands of equal vectors, over shards; a repeated row is one."""
    monkeypatch.setattr(hnsw, "SHARD", 40)
    draw = np.random.default_rng(5)
    rows = [(11 + 3 * k, [1.0, 0.0, 0.5]) for k in range(3000)]
    rows += [(20 * k, draw.normal(size=3).astype(np.float32).tolist()) for k in range(1, 60)] + [(20, [0.0, 1.0, 0.0])]
    rows += rows[3000:3020] + [(100, [9.0, 9.0, 9.0])]
    once = {}
    for vec_id, vector in rows:
        once[vec_id] = min(vector, once.get(vec_id, vector))
    best = exact(sorted(once.items()), [q for q in once if q % 20 == 0], 20)
    got = {}
    for r in hnsw.nearest(vectors(spark, rows), F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == best.keys() and all(sorted(own) == list(range(1, 21)) for own in got.values())
    for q, own in best.items():
        assert [got[q][k][0] for k in range(1, 21)] == [v for v, _ in own]


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]),
        (4, None), (40, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
        (8, [1.0]), (None, [1.0, 1.0]), (60, []),
    ]
    got = hnsw.nearest(vectors(spark, rows), F.col("id") % 20 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == {
        0: [(1, 1.0), (20, 1.0), (2, 0.5), (3, -1.0)],
        20: [(0, 1.0), (1, 1.0), (2, 0.5), (3, -1.0)],
    }


def test_many_equal_vectors_and_none(spark):
    rows = [(k, [1.0, 2.0]) for k in range(300)]
    got = hnsw.nearest(vectors(spark, rows), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(k, 5.0) for k in range(1, 21)]
    assert hnsw.nearest(vectors(spark, []), F.col("id") == 0).collect() == []
    assert hnsw.nearest(vectors(spark, [(1, [1.0])]), F.col("id") == 1).collect() == []
