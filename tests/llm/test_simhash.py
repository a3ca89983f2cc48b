import random
import re

import numpy as np
import xxhash

from newsloom.llm import simhash
from newsloom.llm.components import roots


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marked):
    """(doc_id, fingerprint) -> {doc_id: component} by comparing all pairs."""
    group = list(range(len(marked)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(marked)):
        for j in range(i):
            if (marked[i][1] ^ marked[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for k, (doc, _) in enumerate(marked):
        least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted((doc, f"{fp:016x}", least[find(k)]) for k, (doc, fp) in enumerate(marked))


def test_documents_equal_brute_force(documents, odd_rows):
    draw = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = list(odd_rows)
    for k in range(40):
        base = draw.choices(words, k=draw.randint(1, 400))
        for copy in range(draw.randint(1, 4)):
            changed = list(base)
            if copy > 1:
                changed[draw.randrange(len(changed))] = "other"
            rows.append((100 + 10 * k + copy, " ".join(changed)))
    got = simhash.near_duplicates(documents(rows, clashing=True)).collect()
    expected = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert sorted(map(tuple, got)) == expected
    kept = simhash.keep_first(documents(rows)).collect()
    assert sorted({r.doc_id for r in kept}) == sorted({e[2] for e in expected})
    assert len(kept) == len({r.doc_id for r in kept})


def test_no_pair_within_the_radius_is_missed():
    for masks in simhash._tables():
        for a in range(64):
            for b in range(a):
                assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_crowded_buckets_are_covered_anew(spark, monkeypatch):
    """All fingerprints share their high bits, so the first tables hold all of them in one bucket."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    draw = random.Random(4)
    fps = sorted({draw.randrange(1 << 14) << 20 for _ in range(600)})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = dict(tuple(r) for r in roots(simhash.links(distinct)).collect())
    expected = plain_components([(f, f) for f in fps])
    groups = {}
    for fp, _, component in expected:
        groups.setdefault(component, set()).add(got.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    got = dict(tuple(r) for r in roots(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert len({got[k] for k in range(301)}) == 1
    assert len({got[1000 + k] for k in range(200)}) == 1
    assert got[0] != got[1000]
    assert roots(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []


def test_fingerprint_of_a_long_text():
    text = " ".join(f"W{k % 977}" for k in range(20_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert np.uint64(simhash.fingerprint("")) == 0
