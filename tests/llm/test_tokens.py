import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import packing, tokenfile
from newsloom.llm.tokens import Encoder, encoder

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(
    st.text(alphabet=st.sampled_from("ab  '\n\ts.,9é漢̈​!<|>\x00\xa0Ω"), max_size=40)
    | st.lists(st.sampled_from(["Foo", "bar,", "x|y", "it's", "<|endoftext|>", "<|startoftext|>", "é.)", "\n", "a\nb", "|"]))
    .map(" ".join)
    | st.text(max_size=30)
)
def test_words_looked_up_equal_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    for path, spaces in ((BYTE, True), (WORD, False)):
        got = np.frombuffer(encoder(path, spaces).encode_all([text])[0], "<u4").tolist()
        assert got == library(path)(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAzZstSTéÉñÑßÿµªºİıŉ\u0301'"), min_size=1, max_size=8), max_size=30).map(" ".join))
def test_latin_words_equal_whole_texts(text):
    got = np.frombuffer(encoder(WORD, False).encode_all([text])[0], "<u4").tolist()
    assert got == library(WORD)(text)


def test_latin_words_need_no_preparing(monkeypatch):
    """They go to the model many at once, without the marks, normalizer and split that other pieces need."""
    coder, prepared = Encoder(WORD, False), []
    plain = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda texts: prepared.extend(texts) or plain(texts))
    words = [f"Wörd{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'UVWXYZÉÑÀÇ'[k // 100]}" for k in range(1000)]
    text = " ".join(words) + " x1"
    assert np.frombuffer(coder.encode_all([text])[0], "<u4").tolist() == library(WORD)(text)
    assert prepared == ["x1"]


def expected_pieces(rows, capacity):
    ids_of = library(WORD)
    out = []
    for doc_id, text in rows:
        ids = [*ids_of(text or ""), 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(documents, odd_rows, capacity):
    got = packing.pack(documents(odd_rows, clashing=True), WORD, capacity).collect()
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert pieces == expected_pieces(odd_rows, capacity)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing_of_nothing(documents):
    assert packing.pack(documents([]), WORD).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 90), st.integers(1, 40), max_size=30))
def test_plan_places_all(counts):
    capacity, room, seen = 90, {}, {}
    for length, rank, n, sequence, offset in packing.plan(counts, capacity):
        assert rank == seen.get(length, 0)
        seen[length] = rank + n
        for k in range(n):
            room.setdefault(sequence + k, []).append((offset, length))
    assert seen == counts
    for own in room.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    # no two sequences could be one
    free = sorted(sum(x[1] for x in own) for own in room.values())
    assert len(free) < 2 or free[0] + free[1] > capacity


def test_ranks_in_salts(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    rows = [(k, "same words") for k in range(120)]
    got = packing.pack(documents(rows), WORD, 7).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(rows)
    assert len({r.sequence_id for r in got}) == 60


def test_token_file(spark, documents, odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    rows = [r for r in odd_rows if r[0] != 6]
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(documents(rows, clashing=True), path, BYTE, partitions=3)
    ids_of, start = library(BYTE), 0
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, path).collect()}
    assert len(got) == len(rows)
    for doc_id, text in sorted(rows):
        ids = np.array([*ids_of(text or ""), 2], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert r.ids == ids.tolist()
        start += len(ids)
    dictionary = spark.read.parquet(f"{path}/dictionary").first()[0]
    data = spark.read.parquet(f"{path}/blocks").first()["data"]
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.Block(data, dictionary + b"x")


def test_token_file_of_repeated_rows_and_nothing(spark, documents, tmp_path):
    tokenfile.write_tokens(documents([(1, "a"), (1, "a")]), str(tmp_path / "two"), BYTE)
    assert sorted(r.start for r in tokenfile.read_tokens(spark, str(tmp_path / "two")).collect()) == [0, 2]
    tokenfile.write_tokens(documents([]), str(tmp_path / "none"), BYTE)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_texts_in_rounds_equal_the_plain_call(monkeypatch, odd_rows, path, spaces):
    """Special strings in a text are what the library makes of them."""
    monkeypatch.setattr("newsloom.llm.tokens.ROUND_CHARS", 500)
    monkeypatch.setattr("newsloom.llm.tokens.REMEMBERED", 40)
    monkeypatch.setattr("newsloom.llm.tokens.JOINED", 7)
    texts = [t for _, t in odd_rows if t] + ["", "a <|endoftext|> b", "Ends, with; marks!", "tab\tand\n\nlines\r\n x"] * 3
    texts += [" ".join(f"wörd{k * j}, | x" for j in range(30)) for k in range(40)]
    ids_of = library(path)
    found = encoder(path, spaces).__class__(path, spaces).encode_all(texts)
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)


def test_a_worker_keeps_pieces_for_its_next_task(spark, tmp_path):
    rows = [(k, f"kept{k} pieces of a task") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "kept"), BYTE, partitions=1)

    def remembered(batches):
        from newsloom.llm import tokens

        for batch in batches:
            known = tokens._encoders.get((BYTE, True))
            found = known is not None and any(" pieces" in own for own in (known._young, known._old))
            yield pa.RecordBatch.from_arrays([pa.array([found] * batch.num_rows)], names=["found"])

    # whichever idle worker a task gets, one of them wrote the block
    assert any(r.found for r in spark.range(0, 64, 1, 64).mapInArrow(remembered, "found boolean").collect())


def test_new_words_go_through_the_library_without_marks_between(monkeypatch):
    """What is sent to the library holds the new pieces alone, and each gets the ids of its own call."""
    own = encoder(BYTE, True).__class__(BYTE, True)
    pieces = [f" wörd{k}" for k in range(90)] + [" 漢字", " it's", " x|y", " Ω̈", " 1.2.3", " \x01", " \U0001f600a"]
    sent, plain = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda texts: sent.extend(texts) or plain(texts))
    found = own._encoded(pieces)
    assert "".join(sent) == "".join(pieces)
    ids_of = library(BYTE)
    assert [np.frombuffer(found[p], "<u4").tolist() for p in pieces] == [ids_of(p) for p in pieces]


def test_token_file_looks_up_more_texts_at_once(monkeypatch):
    """Of the same new word in many texts of a round one call is made."""
    own = encoder(BYTE, True).__class__(BYTE, True)
    rounds, plain = [], own._round
    monkeypatch.setattr(own, "_round", lambda texts: rounds.append(len(texts)) or plain(texts))
    monkeypatch.setattr("newsloom.llm.tokens.ROUND_CHARS", 10)
    texts = [f"round{k} of words" for k in range(50)]
    ids_of = library(BYTE)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts, tokenfile.ROUND_CHARS)] == [ids_of(t) for t in texts]
    assert rounds == [50]
