import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from newsloom.llm import nearcopies
from newsloom.workspace import shared_folder


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_first(rows):
    """The smallest id of each component, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(least.values())


@pytest.fixture(scope="module")
def copies():
    """Copies edited little and much, texts of one word, and a common line in half of all texts."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    line = draw.choices(words, k=25)
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two")]
    for k in range(45):
        base = draw.choices(words, k=draw.randint(5, 200))
        if k % 2:
            base[:0] = line
        for copy in range(draw.randint(1, 5)):
            changed = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 30)) if copy else 0):
                changed[draw.randrange(len(changed))] = draw.choice(words)
            rows.append((1000 - 10 * k + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize("stars", [0, nearcopies.STARS])
def test_equals_brute_force(documents, copies, monkeypatch, stars):
    monkeypatch.setattr(nearcopies, "STARS", stars)
    kept = nearcopies.keep_first(documents(copies, clashing=True)).collect()
    assert sorted(r.doc_id for r in kept) == plain_first(copies)


def test_the_stage_removes_near_copies(spark, documents, copies):
    kept = corpus_pipeline.near_copies(spark, documents(copies), None).collect()
    assert sorted(r.doc_id for r in kept) == plain_first(copies) and len(kept) < len(copies)


def test_empty_table(documents):
    assert nearcopies.keep_first(documents([])).collect() == []


def test_bitmaps_never_differ_more_than_the_sets(copies):
    sets = [nearcopies.shingles(t or "") for _, t in copies]
    maps = [nearcopies.parity(s) for s in sets]
    for a, x in zip(sets, maps):
        for b, y in zip(sets, maps):
            differing = sum(int(k).bit_count() for k in (x ^ y).view("uint64"))
            assert differing <= len(set(a.tolist()) ^ set(b.tolist()))


def test_fingerprint_is_the_majority_of_bits():
    hashes = nearcopies.shingles(" ".join(f"w{k}" for k in range(40)))
    bits = nearcopies.fingerprint(hashes) % (1 << 64)
    for k in range(64):
        assert (bits >> k & 1) == (2 * sum(int(h) >> k & 1 for h in hashes) > len(hashes))


def test_pairs_are_compared_once_and_few_texts_move(documents, monkeypatch):
    """Form letters whose common part is too small to be copies: bitmaps leave none to compare."""
    draw = random.Random(11)
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(k, f"{common} " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(40))) for k in range(80)]
    moved = []
    plain_close = nearcopies._close
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    monkeypatch.setattr(nearcopies, "_close", lambda *a: moved.append(plain_close(*a)) or moved[-1])
    kept = nearcopies.keep_first(documents(rows)).collect()
    assert len(kept) == 80 and sum(m.count() for m in moved) == 0


def test_large_sets_that_are_no_copies_are_not_sent(documents, monkeypatch):
    """Over a thousand shingles fill the 1,024 bits evenly; the wide bitmaps tell such sets apart all the same."""
    draw = random.Random(12)
    common = [f"c{k}" for k in range(1500)]
    rows = [(k, " ".join(common + [f"w{draw.randrange(10**6)}" for _ in range(1500)])) for k in range(12)]
    copy = rows[0][1].split()
    copy[2000:2010] = [f"x{k}" for k in range(10)]
    rows.append((99, " ".join(copy)))
    moved = []
    plain_close = nearcopies._close
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    monkeypatch.setattr(nearcopies, "_close", lambda *a: moved.append(plain_close(*a)) or moved[-1])
    kept = nearcopies.keep_first(documents(rows)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(12)) and sum(m.count() for m in moved) == 1


def test_wide_bitmaps_of_any_lengths_never_differ_more_than_the_sets():
    draw = random.Random(13)
    sets = [nearcopies.shingles(" ".join(draw.choices([f"w{k}" for k in range(5000)], k=n))) for n in (400, 600, 1100, 1100, 2500, 9000)]
    sets.append(np.unique(np.concatenate([sets[4][5:], sets[0]])))
    wides = [nearcopies.wide_parity(s) for s in sets]
    assert wides[0] is None and [len(w) for w in wides[1:]] == [128, 256, 256, 512, 2048, 512]
    for a, x in zip(sets[1:], wides[1:]):
        for b, y in zip(sets[1:], wides[1:]):
            assert nearcopies.differing(x, y) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_members_of_a_bucket_are_told_apart_in_the_join(documents, monkeypatch):
    """Texts of one line and little else: the last round pairs only those that the folded bitmaps leave."""
    draw = random.Random(14)
    line = [f"c{k}" for k in range(40)]
    rows = [(k, " ".join([f"w{draw.randrange(10**6)}" for _ in range(30)] + line)) for k in range(60)]
    asked = []
    plain_close = nearcopies._close
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    monkeypatch.setattr(nearcopies, "STARS", 0)
    monkeypatch.setattr(nearcopies, "_close", lambda pairs, *a: asked.append(pairs.count()) or plain_close(pairs, *a))
    kept = nearcopies.keep_first(documents(rows)).collect()
    assert len(kept) == 60 and len(asked) == 2 and asked[-1] == 0


def test_a_text_with_many_pairs_is_dealt_out(spark):
    """Its pairs are spread over shares, and it is sent once for each of these, ahead of the others, not with every pair."""
    pairs = [(min(k, 500), max(k, 500)) for k in range(1000) if k != 500] + [(1, 2)]
    close = spark.createDataFrame(pairs, "x long, y long")
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(1000)], "node long, text string")
    parts = nearcopies._rows_to_compare(close, texts).rdd.glom().collect()
    compared, shares = [], {}
    for rows in parts:
        ahead = None
        for r in rows:
            assert r.text == f"text {r.a if r.b is None else r.b}"
            if r.b is None:
                ahead = (r.a, r.share)
                assert ahead not in shares
                shares[ahead] = 0
            else:
                assert ahead == (r.a, r.share)
                shares[ahead] += 1
                compared.append((min(r.a, r.b), max(r.a, r.b)))
    assert sorted(compared) == sorted(pairs)
    assert max(shares.values()) < 2 * nearcopies.TOGETHER and len(shares) < len(pairs) / 40


def test_only_the_result_stays_in_the_shared_folder(spark, documents, copies):
    place = Path(shared_folder(spark).removeprefix("file:")) / "newsloom" / spark.sparkContext.applicationId
    before = set(place.glob("*"))
    kept = corpus_pipeline.near_copies(spark, documents(copies), None)
    assert {p.name.split("-")[0] for p in set(place.glob("*")) - before} == {"first"}
    assert sorted(r.doc_id for r in kept.collect()) == plain_first(copies)
