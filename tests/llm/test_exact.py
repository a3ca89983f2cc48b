import hashlib
import string
from collections import defaultdict

import pytest

from newsloom.llm import exact
from newsloom.operators.membership import key_filter, mark_members, members

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    """The rows that ``find(digest=True)`` gives, one group at a time."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(_FOLD)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, left = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            stays = i == keep and left == 1
            left -= stays
            out.append((i, keep, len(ids), bool(stays), sha))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()), key=repr
    )


COPIES = [(100 + k, "Same TEXT of many rows") for k in range(60)] + [
    (200, "ÄÖ Same"),
    (201, "äö same"),
    (202, "ÄÖ sAME"),
    (203, "x" * 64 + "one"),
    (204, "x" * 64 + "two"),
    (205, "X" * 64 + "two"),
    (None, "no id"),
    (None, "NO ID"),
    (None, "alone, without id"),
    (206, "Iİ \U0001f600"),
]


@pytest.mark.parametrize("clashing", [False, True])
def test_equals_grouping_whole_texts(documents, odd_rows, clashing):
    rows = odd_rows + COPIES
    assert rows_of(exact.find(documents(rows, clashing), digest=True)) == plain(rows)


def test_texts_alone_by_length_or_start_are_not_hashed(documents):
    rows = [(1, "a"), (2, "bb"), (3, "CC"), (4, "Bb"), (5, "dddd")]
    found = {r.doc_id: r for r in exact.find(documents(rows)).collect()}
    assert [i for i, r in sorted(found.items()) if r.text_sha256] == [2, 4]
    assert (found[2].keep_id, found[2].kept, found[4].kept, found[1].group_size) == (4, False, True, 1)


def test_of_repeated_rows_one_is_kept(documents):
    rows = [(7, "t")] * 5 + [(6, "T")] * 2
    found = exact.find(documents(rows)).collect()
    assert sorted((r.doc_id, r.kept) for r in found) == [(6, False)] * 2 + [(7, False)] * 4 + [(7, True)]
    assert {(r.keep_id, r.group_size) for r in found} == {(7, 7)}


def test_empty_table(documents):
    assert exact.find(documents([]), digest=True).collect() == []


def test_plan_has_no_python(documents, capsys):
    exact.find(documents(COPIES)).explain("extended")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("words", [1, 2, 64, 1 << 20])
def test_a_key_is_never_missed_by_the_filter(spark, words):
    keys, rows = spark.range(0, 3000, 3), spark.range(3000)
    known = key_filter(keys, "xxhash64(id)", words)
    assert known.count() <= words
    inside = {r.id for r in members(rows, known, "xxhash64(id)", words).collect()}
    marked = {r.id for r in mark_members(rows, known, "xxhash64(id)", "held", words).where("held").collect()}
    assert marked == inside >= set(range(0, 3000, 3))
    if words == 1 << 20:
        assert len(inside) < 1020
