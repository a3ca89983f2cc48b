"""Token ids of whole texts by the tokenizers library, with each different word looked up once.

A byte-pair tokenizer never merges across a space between two other characters, nor between the letters of a
word and the marks that end it, so a text without runs of spaces is the concatenation of such pieces.
The pieces of many texts are told apart by array operations; each Python worker keeps the ids of those it
met lately, and only new ones go through the library, many in one call. A text goes through the library
whole where it holds the string of an added token, or, where spaces are part of the ids, a run of
spaces. The ids are those of the library's plain call.
"""

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newsloom.llm.tables import give_back

#: Pieces a worker remembers per generation; two generations are kept.
REMEMBERED = 150_000
#: Characters of texts whose pieces are looked up at once.
ROUND_CHARS = 1 << 21
#: New pieces in one call's text.
JOINED = 200

# Letters that every version of Unicode knows, and marks; a piece may end between the two. (U+0130 is not
# among them: in lower case it ends with a combining mark, which the split joins to the next one.)
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
_MARK = r"[!-/:-@\[-`{-~]"
# Between pieces where a space is part of the next one.
_CUT = "\x00"
# Words that the usual normalizer only lower-cases and the usual split leaves whole.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_USUAL_NORMALIZER = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}
]
_USUAL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders = {}


class Encoder:
    """Ids as bytes (unsigned 32 bit, little endian)."""

    def __init__(self, path, spaces_matter):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._spaces_matter = spaces_matter
        self._young, self._old = {}, {}
        # what stands between new pieces in a call, and its only id
        self._mark, self._between = ("\n", "\n") if spaces_matter else ("|", " | ")
        ids = self._ids([self._mark])[0]
        self._mark_id = ids[0] if len(ids) == 1 else None
        self._sizes = self._token_sizes() if spaces_matter else None
        self._bare, self._last = (None, None) if spaces_matter else self._without_preparing()

    def _without_preparing(self):
        """The library's model without normalizer and split, and which ids end a word; None, None if these are unusual.

        A word of Latin letters, lower-cased, goes through both as it is, so its ids are those of the plain call.
        """
        own = json.loads(self._library.to_str())
        splits = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
        suffix = own["model"].get("end_of_word_suffix")
        if (
            (own["normalizer"] or {}).get("normalizers") != _USUAL_NORMALIZER
            or [s["type"] for s in splits] != ["Split", "ByteLevel"]
            or (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) != ({"Regex": _USUAL_SPLIT}, "Removed", True)
            or (splits[1]["add_prefix_space"], splits[1]["use_regex"]) != (False, False)
            or own["model"]["type"] != "BPE"
            or not suffix
            or any(t["normalized"] for t in own["added_tokens"])
        ):
            return None, None
        known = own["model"]["vocab"]
        last = np.zeros(max(known.values()) + 1, bool)
        last[[k for token, k in known.items() if token.endswith(suffix)]] = True
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, splits[1]]}
        own |= {"normalizer": None, "pre_tokenizer": split, "added_tokens": [], "post_processor": None}
        return type(self._library).from_str(json.dumps(own)), last

    def _words(self, words):
        """``ids, ends`` of words of Latin letters, many in one text: ids that end a word tell them apart; None where they do not."""
        groups = [" ".join(words[at : at + JOINED]).lower() for at in range(0, len(words), JOINED)]
        found = self._bare.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
        ends = np.flatnonzero(self._last[ids]) + 1
        return (ids, ends) if len(ends) == len(words) and ends[-1] == len(ids) else None

    def _token_sizes(self):
        """The bytes of each token by id; None if not every byte of a text is a character of its tokens.

        None too if the string of an added token could stand over the end of a piece.
        """
        from tokenizers import pre_tokenizers

        alphabet = set(pre_tokenizers.ByteLevel.alphabet())
        known = self._library.get_vocab(with_added_tokens=False)
        if not isinstance(self._library.pre_tokenizer, pre_tokenizers.ByteLevel) or not alphabet <= known.keys():
            return None
        if any(len(added.split()) != 1 for added in self._added):
            return None
        sizes = np.zeros(max(known.values()) + 1, np.int64)
        for token, k in known.items():
            sizes[k] = len(token)
        return sizes

    def _ids(self, texts):
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts):
        return [_packed(ids) for ids in self._ids(texts)]

    def _in_a_row(self, pieces):
        """``ids, ends``: those of pieces that begin with their only space, and the place in the ids where each ends.

        No token reaches over a space, so many pieces make one text and the bytes of its tokens tell the pieces
        apart; None where they do not.
        """
        groups = ["".join(pieces[at : at + JOINED]) for at in range(0, len(pieces), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._ids(groups)), "<u4")
        tokens = np.cumsum(self._sizes[ids])
        raw = np.frombuffer("".join(groups).encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
        at = np.minimum(np.searchsorted(tokens, ends), len(tokens) - 1)
        return (ids, at + 1) if len(ends) == len(pieces) and np.array_equal(tokens[at], ends) else None

    def _encoded(self, pieces):
        """The ids of pieces, many of them in one text."""
        found, alone, joined, spaced = {}, [], [], []
        if self._bare:
            spaced = [p for p in pieces if _PLAIN(p)]
            pieces = [p for p in pieces if not _PLAIN(p)]
        for piece in pieces:
            begins = self._spaces_matter and piece[:1] == " "
            bare = piece[1:] if begins else piece
            plain = self._mark_id is not None and self._mark not in bare and bare.split() == [bare]
            (spaced if plain and begins and self._sizes is not None else joined if plain else alone).append(piece)
        row = (self._words if self._bare else self._in_a_row)(spaced) if spaced else None
        if row:
            raw, start = row[0].tobytes(), 0
            for piece, end in zip(spaced, (4 * row[1]).tolist()):
                found[piece] = raw[start:end]
                start = end
        else:
            joined += spaced
        groups = [joined[at : at + JOINED] for at in range(0, len(joined), JOINED)]
        for group, ids in zip(groups, self._ids([self._between.join(g) for g in groups])):
            ids = np.array(ids, "<u4")
            marks = np.flatnonzero(ids == self._mark_id)
            if len(marks) != len(group) - 1:
                alone += group
                continue
            raw, start = ids.tobytes(), 0
            for piece, end in zip(group, [*marks.tolist(), len(ids)]):
                found[piece] = raw[4 * start : 4 * end]
                start = end + 1
        found.update(zip(alone, self._whole(alone)))
        return found

    def _pieces(self, texts):
        """The pieces of each text, as a list array."""
        texts = pa.array(texts, pa.large_string())
        if not self._spaces_matter:
            # any white space will do, so a space parts letters and marks
            texts = pc.replace_substring_regex(texts, f"({_LETTER})({_MARK}+)([ \n]|$)", r"\1 \2\3")
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        texts = pc.replace_substring(texts, " ", _CUT + " ")
        texts = pc.replace_substring_regex(texts, f"({_LETTER})({_MARK}+)({_CUT}|\n|$)", rf"\1{_CUT}\2\3")
        either = f"({_LETTER}|{_MARK}|[0-9])"
        texts = pc.replace_substring_regex(texts, f"{either}\n{either}", f"\\1{_CUT}\n{_CUT}\\2")
        return pc.split_pattern(texts, _CUT)

    def _round(self, texts):
        """The ids of texts that are their pieces."""
        if len(self._young) > REMEMBERED:
            self._old, self._young = self._young, {}
        split = self._pieces(texts)
        coded = split.flatten().dictionary_encode()
        different, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        young, old = self._young, self._old
        missing = [p for p in different if p not in young]
        known = {p: old[p] for p in missing if p in old}
        young.update(known)
        young.update(self._encoded([p for p in missing if p not in known]))
        ids = [young[p] for p in different]
        values = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(starts[which] - (ends - lengths), lengths)
        raw = values[places].tobytes()
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _goes_whole(self, text):
        if any(added in text for added in self._added):
            return True
        return self._spaces_matter and ("  " in text or _CUT in text)

    def encode_all(self, texts, together=None):
        """The ids of each text; pieces of so many characters are looked up at once."""
        together = together or ROUND_CHARS
        out, held, size = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if self._goes_whole(text):
                out[k] = self._whole([text])[0]
                continue
            held.append(k)
            size += len(text)
            if size >= together:
                self._fill(out, texts, held)
                held, size = [], 0
        self._fill(out, texts, held)
        return out

    def forget(self):
        """Drops the remembered pieces at the end of a task."""
        self._young, self._old = {}, {}
        give_back()

    def _fill(self, out, texts, held):
        if held:
            for k, ids in zip(held, self._round([texts[k] for k in held])):
                out[k] = ids


def _packed(ids):
    return array("I", ids).tobytes() if np.little_endian else np.array(ids, "<u4").tobytes()


def encoder(path, spaces_matter):
    """The worker's encoder for a vocabulary file."""
    key = (path, spaces_matter)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaces_matter)
    return _encoders[key]
