import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import resample

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_FOLD))
    features = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in features]


def plain(rows, target, percent, least, seed):
    """``doc_id, n_features, weight, score, rank`` with one feature after the other."""
    read = [(i, *plain_buckets(t)) for i, t in rows if i is not None]
    s, t = Counter(), Counter()
    for _, _, buckets in read:
        s.update(buckets)
    for _, text in target:
        t.update(plain_buckets(text)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    scored = []
    for i, n_words, buckets in read:
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((i, n_words, len(buckets), weight, score))
    eligible = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0], x[2], x[3]))
    ranks = Counter()
    out = [(x[0], x[2], x[3], x[4], k) for k, x in enumerate(eligible[: len(eligible) * percent // 100], 1)]
    drawn = Counter(x[:4] for x in out)
    for x in scored:
        key = (x[0], *x[2:])
        ranks[key] += 1
        if ranks[key] > drawn[key]:
            out.append((*key, None))
    return sorted(out, key=repr)


def result(spark, rows, target, percent=25, least=20, seed=7):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "rank", "bucket", "n", "_key", "_place", "weight"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    items = spark.createDataFrame(target, "item_id long, text string")
    found = resample.draw(docs, items, percent, least, seed).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found), key=repr)


def texts(count, seed=3):
    rng = random.Random(seed)
    words = ["The", "naïve", "café", "x", "Zürich", "9", "文字", "a" * 63, "b" * 64, "C" * 200, "don't", "end.", "--"]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(count)]


@pytest.mark.parametrize("round_bytes", [8, 100, 1 << 20])
def test_buckets_equal_those_of_whole_features(monkeypatch, round_bytes):
    monkeypatch.setattr(resample, "ROUND_BYTES", round_bytes)
    raws = [t for _, t in texts(80)] + ["", "  ", "word", "a  b", "\x00nul\x7f"]
    found = [[0, []] for _ in raws]
    for ones, owners, buckets in resample.feature_buckets([r.encode() for r in raws]):
        for o in ones:
            found[o][0] += 1
        for o, b in zip(owners, buckets):
            found[o][1].append(int(b))
    for raw, (n_words, buckets) in zip(raws, found):
        assert (n_words, sorted(buckets)) == (lambda n, b: (n, sorted(b)))(*plain_buckets(raw))


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_equals_sorting_all_documents(spark, odd_rows, percent):
    rows, target = texts(300) + [(1000 + i, t) for i, t in odd_rows], texts(20, 9) + [(1, None), (2, "")]
    assert result(spark, rows, target, percent) == plain(rows, target, percent, 20, 7)


def test_repeated_rows_are_drawn_up_to_the_exact_number(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text)] * 9 + [(6, text)] * 3 + [(None, text)]
    found = result(spark, rows, [(1, "w1 w2")])
    assert found == plain(rows, [(1, "w1 w2")], 25, 20, 7)
    assert sorted(r[4] for r in found if r[4]) == [1, 2, 3]


def test_nothing_to_draw(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert [r[4] for r in result(spark, texts(3), [])] == [None] * 3
    assert {r[4] for r in result(spark, [(1, "too short")] * 8, [(1, "a")])} == {None}


@pytest.mark.parametrize("wanted", [1, 2, 37, 500])
def test_bisection(spark, wanted):
    values = sorted(random.Random(wanted).choices(range(-(10**12), 10**12, 10**10), k=500))
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    value = values[wanted - 1]
    assert resample.least_reaching(rows, "v", wanted) == (value, sum(v < value for v in values))
    assert resample.least_reaching(rows, "v", 501) is None


def test_gain_of_an_unseen_bucket(spark):
    counts = spark.createDataFrame([(3, 7)], "bucket long, n long")
    gain = resample.gains(counts, counts.limit(0))
    assert gain[3] == math.floor(1000 * math.log(10_007 / (8 * 10_000)))
    assert np.all(np.delete(gain, 3) == math.floor(1000 * math.log(10_007 / 10_000)))
