"""The registered queries on whole tables: every column of their contract against a plain version."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from newsloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def rows(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids])
    found = {}
    for r in rows(spark, "op1_hnsw"):
        found.setdefault(r.query_id, {})[r["rank"]] = r
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    assert found.keys() == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, own in found.items():
        assert sorted(own) == list(range(1, 21))
        listed = [(-own[k].score, own[k].vec_id) for k in range(1, 21)]
        assert listed == sorted(listed)
        order = np.lexsort((ids, -(matrix @ vectors[q])))
        best = [i for i in ids[order] if i != q][:20]
        hits += len({v for _, v in listed} & set(best))
    assert hits >= 0.9 * 20 * len(found)


def test_op2(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(hash(t[k : k + 200]) for t in raw.values() for k in range(len(t) - 199))
    for r in rows(spark, "op2_suffix_dedup"):
        text = raw[r.doc_id]
        gone = np.zeros(len(text) + 1, int)
        for k in range(len(text) - 199):
            if seen[hash(text[k : k + 200])] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(text) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), int(gone.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op4(spark, texts):
    def fingerprint(text):
        words = text.encode().lower().split()
        if not words:
            return 0
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            best = min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2)
            changed, least[i] = changed or best < least[i], min(best, least[i])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op4_simhash_covering")}
    assert found == {i: (f"{prints[i]:016x}", least[i]) for i in prints}


def test_op5(spark):
    found = {r.page_id: r for r in rows(spark, "op5_html_text")}
    pages = {r["page_id"]: r for r in table("pages")}
    assert found.keys() == pages.keys()
    for page_id, r in found.items():
        assert r.url == pages[page_id]["url"] and r.n_chars == len(r.text) > 0
        assert not any(line != " ".join(line.split()) or not line for line in r.text.split("\n"))


def test_op6(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    expected, sequences = set(), {}
    for i, own in ids.items():
        expected |= {(i, k, at, len(own[at : at + 2048]), crc(own[at : at + 2048])) for k, at in enumerate(range(0, len(own), 2048))}
    found = rows(spark, "op6_best_fit_packing")
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == expected and len(found) == len(expected)
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 2048) + 1


@pytest.mark.parametrize("name,of,out", [("op8_quality", 4, 2), ("op9_toxicity", 3, 1)])
def test_op8_op9(spark, texts, name, of, out):
    found = rows(spark, name)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == out)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_op10(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op10_token_binary")}, 0
    assert found.keys() == texts.keys()
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert found[i] == (start, len(ids), crc(ids))
        start += len(ids)


def test_op3_op7(spark, texts):
    for name, key in (("op3_decontamination", "item_id"), ("op7_license_scan", "template")):
        found = rows(spark, name)
        assert all(r.doc_id in texts and 0 <= r.start_char <= r.end_char <= len(texts[r.doc_id]) for r in found)
        assert len({(r.doc_id, r[key]) for r in found}) == len(found)
