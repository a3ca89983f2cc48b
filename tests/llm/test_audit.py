import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import audit

LISTS = st.lists(st.lists(st.integers(0, 60), unique=True).map(sorted), max_size=5)


@settings(max_examples=300, deadline=None)
@given(LISTS)
def test_union_size(lists):
    assert audit.union_size(lists) == len(set().union(*lists))


@settings(max_examples=200, deadline=None)
@given(LISTS.filter(lambda x: len(x) > 1))
def test_common(lists):
    assert audit.common(lists[0], lists[1]) == sorted(set(lists[0]) & set(lists[1]))


@given(st.lists(st.integers(0, 99), unique=True).map(sorted), st.integers(-1, 101), st.integers(0, 20))
def test_gallop(items, value, start):
    start = min(start, len(items))
    assert audit.gallop(items, value, start) == start + sum(x < value for x in items[start:])


def plain(rows, labels):
    """Every order applied to one document after the other. ``rows``: (doc_id, text, lang)."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    texts = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            texts[text or ""].append(i)
    parts = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j < i for j in texts[text]),
        }
        parts[lang or ""].append(("".join(f for f in "ABCDE" if failed[f]), i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                rest = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                out[part, "".join(order), step] = [
                    len(rest), len(gone), failing - len(gone), sum(d[0] == f for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
                shapley[part, f] += len(gone)
                left = rest
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name in ("part", "A", "E", "good", "digest", "first", "n"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    found = audit.interactions(audit.postings(audit.failures(docs, marks))).collect()
    keys = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(found) == len({(r.part, r.filter_order, r.step) for r in found})
    return {(r.part, r.filter_order, r.step): tuple(r[k] for k in keys) for r in found}


LONG = " ".join(f"w{k}" for k in range(230))
ROWS = (
    [(k, LONG, ("en", "de", "", None)[k % 4]) for k in range(12)]
    + [(20 + k, LONG + " # of it", "en") for k in range(3)]
    + [(30, "same " * 300, "en"), (31, "SAME " * 300, "de"), (32, "SHORT | text", "de"), (33, "", "fr")]
    + [(34, None, "fr"), (35, LONG.replace(" ", " "), "fr"), (35, LONG, "fr"), (35, LONG, "fr")]
    + [(None, LONG, "en"), (None, "x", None), (36, "a\x0bb\x1cc " * 150, "en"), (37, LONG * 40, "en")]
)
LABELS = [(k, k % 2, k % 3 == 0) for k in range(0, 40, 2)] + [(4, 1, 1), (30, None, None), (None, 1, 1), (99, 1, 1)]
LABELS = [(i, q, None if t is None else int(t)) for i, q, t in LABELS]


@pytest.mark.parametrize("in_range", [3, 1 << 16])
def test_equals_applying_every_order(spark, monkeypatch, in_range):
    monkeypatch.setattr(audit, "RANGE", in_range)
    assert result(spark, ROWS, LABELS) == plain(ROWS, LABELS)


def test_clean_documents_give_zeros(spark):
    found = result(spark, [(1, LONG, "en")], [])
    assert len(found) == 600 and set(found.values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_no_documents(spark):
    assert result(spark, [], LABELS) == {}


def test_lists_hold_positions_in_order(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE", 4)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    chunks = audit.postings(audit.failures(docs, marks)).collect()
    assert sum(len(c.ids) for c in chunks) == len(ROWS)
    for c in chunks:
        known = [i for i in c.ids if i is not None]
        assert len(c.ids) <= 4 and known == sorted(known) and len(c.lists) == 7
        assert all(held == sorted(set(held)) and all(p < len(c.ids) for p in held) for held in c.lists)
