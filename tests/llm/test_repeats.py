import random

import numpy as np
import pytest

from newsloom.llm import repeats
from newsloom.llm.runs import common_prefix, front_code, front_decode, merge


def brute(rows, length):
    """doc -> list of spans, from every substring of the given length."""
    raws = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    count = {}
    for _, raw in raws:
        for k in range(len(raw) - length + 1):
            piece = raw[k : k + length]
            count[piece] = count.get(piece, 0) + 1
    out = []
    for i, raw in raws:
        spans = []
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        out.append((i, spans))
    return sorted(out)


def found(docs, **options):
    rows = repeats.remove(docs, **options).collect()
    for r in rows:
        assert r.n_removed == sum(b - a for a, b in r.spans)
        assert len(r.kept) == r.n_bytes - r.n_removed
    return sorted((r.doc_id, [list(s) for s in r.spans]) for r in rows)


def corpus(seed, n):
    draw = random.Random(seed)
    pool = ["".join(draw.choices("abcde ", k=draw.randint(20, 400))) for _ in range(12)]
    texts = ["".join(draw.choices(pool, k=draw.randint(1, 5))) for _ in range(n)]
    # edits, so that repeats end at all distances from their anchors
    for k in range(0, n, 3):
        at = draw.randrange(len(texts[k]))
        texts[k] = texts[k][:at] + draw.choice("xyz") + texts[k][at + 1 :]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
@pytest.mark.parametrize("length", [200, 64])
def test_equals_brute_force(documents, hot, length):
    rows = corpus(length, 60)
    assert found(documents(rows), length=length, hot=hot) == brute(rows, length)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_odd_rows(documents, odd_rows, hot):
    rows = [r for r in odd_rows if r[0] != 10]
    assert found(documents(rows, clashing=True), hot=hot) == brute(rows, repeats.LENGTH)


def test_long_text_and_empty_table(documents, odd_rows):
    long_ = [r for r in odd_rows if r[0] == 10]
    ((doc, spans),) = found(documents(long_))
    assert doc == 10 and spans == [[0, len(long_[0][1])]]
    assert found(documents([])) == []


def test_small_runs_and_parts(documents, monkeypatch):
    monkeypatch.setattr(repeats, "RUN", 7)
    monkeypatch.setattr(repeats, "MERGED", 20)
    rows = corpus(5, 50)
    assert found(documents(rows)) == brute(rows, repeats.LENGTH)


def test_hot_anchors_that_reach_differently_far(documents, monkeypatch):
    """One passage after texts of its own: its windows at the far range must meet in one of many parts."""
    monkeypatch.setattr(repeats, "MERGED", 5)
    draw = random.Random(8)
    letters = lambda n: "".join(draw.choices("abcdefghij", k=n))
    rows = []
    for k in range(30):
        passage = letters(draw.randint(200, 330))
        rows += [(4 * k + j, letters(draw.randint(0, 150)) + passage + letters(draw.randint(0, 150))) for j in range(2)]
    assert found(documents(rows), hot=1) == brute(rows, repeats.LENGTH)


def test_clean_keeps_other_rows(documents, odd_rows):
    rows = [r for r in odd_rows if r[0] != 10]
    docs = documents(rows).selectExpr("doc_id", "text", "length(text) as n_chars", "'s' as source")
    kept = {(r.doc_id, r.text, r.n_chars) for r in repeats.clean(docs).collect()}
    assert {1, 2, 3, 4, 11} <= {k[0] for k in kept}
    assert not {5, 6, 8} & {k[0] for k in kept}
    assert (7, "lead  tail", 10) in kept or any(k[0] == 7 and len(k[1]) == k[2] for k in kept)


def test_anchors_depend_on_the_window_alone():
    draw = np.random.default_rng(0)
    raw = draw.integers(97, 100, 700).astype(np.uint8)
    place, low, high, _ = repeats.anchors(raw, 200)
    of = {w: p for p, a, b in zip(place, low, high) for w in range(a, b + 1)}
    for w in range(len(raw) - 199):
        alone = repeats.anchors(raw[w : w + 200], 200)[0]
        assert of[w] == w + alone[0]


def test_merge_of_front_coded_runs():
    draw = random.Random(2)
    for _ in range(100):
        runs = []
        for _ in range(draw.randint(0, 7)):
            keys = sorted(bytes(draw.choices(b"ab", k=draw.randint(0, 8))) for _ in range(draw.randint(0, 30)))
            decoded, shared = front_decode(*front_code(keys))
            assert decoded == keys
            runs.append((decoded, shared))
        out = list(merge(runs))
        got = [runs[r][0][k] for r, k, _ in out]
        assert got == sorted(k for r in runs for k in r[0])
        assert all(out[k][2] == common_prefix(got[k - 1], got[k]) for k in range(1, len(got)))
