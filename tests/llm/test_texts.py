"""Decontamination, license scan, toxicity and quality on small texts."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import calibration, decontaminate, licenses, quality, toxicity
from newsloom.llm.textwords import HashSet, char_spans, grams, words

WORDS = [f"w{k}" for k in range(400)]


def plain_distance(item, text):
    """Least word edits that turn the item into some run of the text."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def edited(draw, base, edits):
    out = list(base)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[at] = "zz"
        elif kind == 1:
            out.insert(at, "zz")
        elif len(out) > 1:
            del out[at]
    return out


@pytest.fixture(scope="module")
def contaminated():
    draw = random.Random(3)
    items = [(k, draw.choices(WORDS, k=n)) for k, n in enumerate([1, 3, 5, 9, 14, 30, 45, 70])]
    rows = []
    for k in range(120):
        body = draw.choices(WORDS, k=draw.randint(5, 150))
        for _ in range(draw.randrange(3)):
            _, item = draw.choice(items[2:])
            at = draw.randrange(len(body))
            body[at:at] = edited(draw, item, draw.randrange(0, len(item) // 3 + 1))
        rows.append((k, body))
    return items, rows


def test_leaks_equal_brute_force(spark, documents, odd_rows, contaminated):
    items, rows = contaminated
    docs = documents([(i, " ".join(b).capitalize() + ".") for i, b in rows] + [(1000 + i, t) for i, t in odd_rows], True)
    bench = spark.createDataFrame(
        [(i, ", ".join(t)) for i, t in items] + [(50, None), (51, " ?! ")], "item_id long, text string"
    ).withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs, bench).collect()}
    expected = {}
    for i, body in rows:
        for k, item in items:
            d = plain_distance(item, body)
            if d <= int(decontaminate.TOLERANCE * len(item)):
                expected[i, k] = d
    assert got.keys() <= expected.keys()
    assert len(got) >= 0.99 * len(expected)
    assert all(got[k] == v for k, v in expected.items() if v == 0)
    # a passage that is found is measured exactly; of two passages of an item the nearer one may be missed
    assert sum(got[k] != expected[k] for k in got) <= 0.01 * len(got)
    kept = {r.doc_id for r in decontaminate.keep(docs, bench).collect()}
    assert kept.isdisjoint({k[0] for k in got})
    assert len(kept) == len({i for i, _ in rows} | {1000 + i for i, _ in odd_rows}) - len({k[0] for k in got})


def test_leaks_in_passes(spark, documents, contaminated, monkeypatch):
    items, rows = contaminated
    docs = documents([(i, " ".join(b)) for i, b in rows])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole
    assert decontaminate.leaks(documents([]), bench).collect() == []
    assert decontaminate.leaks(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["deletions", "mixed"])
def test_recall_at_the_full_tolerance(kind):
    """Against the windows that the exact filter leaves, all of which hold the item."""
    draw = random.Random(14)
    number = lambda ws: words(" ".join(ws))[2]
    tried = missed = 0
    for n, many in ((5, 60), (20, 60), (59, 50), (100, 40), (200, 30)):
        items = [draw.choices([f"v{k}" for k in range(5000)], k=n) for _ in range(many)]
        prepared = decontaminate.Items([(k, " ".join(t)) for k, t in enumerate(items)])
        for k, item in enumerate(items):
            d = int(decontaminate.TOLERANCE * n)
            gone = set(draw.sample(range(n), d))
            body = edited(draw, item, d) if kind == "mixed" else [w for j, w in enumerate(item) if j not in gone]
            text = number(draw.choices(WORDS, k=50) + body + draw.choices(WORDS, k=50))
            assert k in prepared.supported(text)
            found = {x[0]: x[1] for x in prepared.leaks(text)}
            assert found.get(k, 0) <= d
            tried, missed = tried + 1, missed + (k not in found)
    assert missed <= 0.01 * tried


def test_a_text_of_a_common_opening_takes_no_time():
    """Items that share their opening, and a text made of it: no run of the opening counts twice."""
    opening = [f"o{k}" for k in range(12)]
    rows = [(k, " ".join(opening + [f"i{k}x{j}" for j in range(30)])) for k in range(400)]
    prepared = decontaminate.Items(rows)
    text = words(" ".join(opening * 270))[2]
    start = time.process_time()
    assert prepared.leaks(text) == []
    assert time.process_time() - start < 20
    held = words(" ".join(opening * 200) + " " + rows[17][1] + " " + " ".join(opening * 100))[2]
    assert prepared.leaks(held) == [(17, 0, 2400, 2442)]


def test_supported_starts():
    draw = random.Random(2)
    for _ in range(300):
        pairs = sorted((draw.randrange(40), draw.randrange(8)) for _ in range(draw.randrange(1, 25)))
        d, least = draw.randrange(4), draw.randrange(1, 5)
        near = lambda s: {p for x, p in pairs if abs(x - s) <= d}
        expected = [s for s in range(-5, 50) if len(near(s)) >= least]
        got = decontaminate.supported_starts([x for x, _ in pairs], [p for _, p in pairs], d, least)
        assert got.tolist() == expected


def test_edit_distance():
    draw = random.Random(9)
    for _ in range(200):
        item = draw.choices("abcd", k=draw.randint(1, 12))
        text = draw.choices("abcd", k=draw.randint(0, 20))
        number = lambda s: np.array([ord(c) for c in s], np.uint64)
        distance, a, b = decontaminate.edit_distance_within(number(item), number(text))
        assert distance == plain_distance(item, text)
        whole = [list(range(b - a + 1))]
        for k, x in enumerate(item, 1):
            row = [k]
            for j, y in enumerate(text[a:b], 1):
                row.append(min(whole[-1][j] + 1, row[-1] + 1, whole[-1][j - 1] + (x != y)))
            whole.append(row)
        assert whole[-1][-1] == distance


def test_words_and_hashes():
    text = "The  cat-sat; naïve ÉCOLE 42!"
    starts, ends, hashes = words(text)
    raw = text.lower().encode()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == ["the", "cat", "sat", "naïve", "école", "42"]
    assert len(words("")[0]) == 0 and len(words(" .,")[0]) == 0
    again = words("x the y cat")[2]
    assert hashes[0] == again[1] and hashes[1] == again[3]
    assert len(grams(hashes, 7)) == 0
    assert HashSet(hashes[:2]).positions(hashes).tolist() == [0, 1]
    assert [text[a:b] for a, b in char_spans(text, [(int(starts[4]), int(ends[4]))])] == ["ÉCOLE"]


def test_every_template_is_found_where_it_stands(documents, odd_rows):
    draw = random.Random(5)
    rows = list(odd_rows)
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        lead = " ".join(draw.choices(WORDS, k=draw.randint(0, 60)))
        rows.append((100 + k, f"{lead}\n{text.upper()}\n" + " ".join(draw.choices(WORDS, k=30))))
    # an eighth of the words changed in one place keeps the containment, half of them does not
    longest = max(range(len(licenses.TEMPLATES)), key=lambda k: len(licenses.TEMPLATES[k][1]))
    own = licenses.TEMPLATES[longest][1].split()
    rows.append((200, " ".join(own[: len(own) * 7 // 8])))
    rows.append((201, " ".join(own[: len(own) // 2])))
    got = licenses.scan(documents(rows, clashing=True)).collect()
    found = {(r.doc_id, r.template) for r in got}
    assert {(100 + k, k) for k in range(len(licenses.TEMPLATES))} <= found
    assert (200, longest) in found and (201, longest) not in found
    assert not {d for d, _ in found} & {r[0] for r in odd_rows}
    texts = dict(rows)
    for r in got:
        own = set(grams(words(licenses.TEMPLATES[r.template][1])[2], min(5, len(words(licenses.TEMPLATES[r.template][1])[2]))).tolist())
        q = min(5, len(words(licenses.TEMPLATES[r.template][1])[2]))
        inside = set(grams(words(texts[r.doc_id][r.start_char : r.end_char])[2], q).tolist())
        assert math.isclose(len(own & inside) / len(own), r.containment)
    assert licenses.scan(documents([])).collect() == []


def test_grammar():
    grammar = toxicity.Grammar({"idio": 2.0, "clown$": 2.0})
    plain = grammar.score("what an idiot came")
    assert grammar.score("you are an idiot") > plain > grammar.score("not an idiot") > 0
    assert plain > grammar.score('he called it "idiotic"')
    assert grammar.score("clown. clown.") == 2 * grammar.score("clown")
    assert grammar.score("clowns") == 0 == grammar.score("paraidiot") == grammar.score("")
    assert grammar.score("i will kill you") > grammar.score("time to kill") == 0
    # a clause is matched once, however many stems it holds
    assert grammar.score("idiot idiot") == 2 * grammar.score("idiot")
    long_ = "x " * 5000 + "idiot " + "y " * 5000
    assert grammar.score(long_) == plain


def labelled(spark, documents, seed=1, n=1200):
    draw = random.Random(seed)
    rows, marks = [], []
    for k in range(n):
        body = draw.choices(WORDS, k=draw.randint(10, 60))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(2):
                body.insert(draw.randrange(len(body)), "grmpf" + draw.choice(["ez", "on", "ique"]))
        good = k % 3 != 0
        if not good:
            body = [w + draw.choice(["###", "&&&"]) for w in body] if k % 2 else [w for w in body for _ in range(4)]
        rows.append((k, " ".join(body)))
        marks.append((k, int(good), int(toxic)))
    marks += [(None, 1, 1), (1, None, None), (999_999, 1, 0)]
    return documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_learns_held_out_rows(spark, documents, odd_rows):
    docs, labels = labelled(spark, documents)
    model, raw = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert any(s.startswith("grmpf"[: toxicity.SHORTEST]) for s in model[0])
    got = {r.doc_id: r.score for r in toxicity.score(raw, model).collect()}
    wrong = [k for k, s in got.items() if k % 3 == 1 and (s >= 0.7) != (k % 5 == 0)]
    assert len(wrong) <= 4
    odd = documents(odd_rows, clashing=True)
    assert {r.doc_id for r in toxicity.keep(odd, model, 0.7).collect()} == {r[0] for r in odd_rows}
    kept = {r.doc_id for r in toxicity.keep(docs, model, 0.7).collect()}
    assert kept == {k for k, s in got.items() if s < 0.7}


def test_quality_learns_held_out_rows(spark, documents, odd_rows):
    docs, labels = labelled(spark, documents)
    stats = quality.with_statistics(docs)
    model = quality.train(stats, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    wrong = [k for k, s in got.items() if k % 4 == 2 and (s >= 0.7) != (k % 3 != 0)]
    assert len(wrong) <= 4
    odd = quality.score(quality.with_statistics(documents(odd_rows, clashing=True)), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)


def test_classifiers_without_labels_or_documents(spark, documents, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = documents(odd_rows)
    for docs, n in ((odd, len(odd_rows)), (documents([]), 0)):
        model, raw = toxicity.train(docs, none, F.lit(True))
        assert toxicity.score(raw, model).count() == n
        stats = quality.with_statistics(docs)
        scores = [r.score for r in quality.score(stats, quality.train(stats, none, F.lit(True))).collect()]
        assert len(scores) == n and all(abs(s - 0.5) < 1e-3 for s in scores)


def test_isotonic(spark):
    draw = random.Random(0)
    rows = [(x, int(draw.random() < x)) for x in (draw.random() for _ in range(3000))]
    knots = calibration.fit_isotonic(spark.createDataFrame(rows, "raw double, label int"))
    at = np.linspace(0.05, 0.95, 19)
    scores = calibration.apply_isotonic(at, knots)
    assert (np.diff(scores) >= 0).all() and np.abs(scores - at).max() < 0.12


def test_training_sends_few_texts_at_a_time(spark, documents, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(toxicity, "_train", lambda docs, marks: seen.append(spark.conf.get(name)))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    toxicity.train(documents([(1, "one")]), labels, F.lit(True))
    assert seen == ["1000"] and spark.conf.get(name) == before
