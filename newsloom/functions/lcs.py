"""Longest common subsequence of two string columns, and of the words in which two titles differ.

Spark has Levenshtein distance but not this one; nested ``aggregate`` is an order of
magnitude slower. It sees only the few pairs that the native bounds leave over.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F


def _of_two():
    """The function of two texts. Local functions travel by value to workers."""

    def length(a, b):
        if len(a) > len(b):
            a, b = b, a
        # a common start and end belong to some longest common subsequence
        start, most = 0, len(a)
        while start < most and a[start] == b[start]:
            start += 1
        end = 0
        while end < most - start and a[-1 - end] == b[-1 - end]:
            end += 1
        a, b = a[start : most - end], b[start : len(b) - end]
        # one bit for each character of a: cleared where the row of the table steps up
        places = {}
        for k, c in enumerate(a):
            places[c] = places.get(c, 0) | 1 << k
        full = (1 << len(a)) - 1
        row = full
        for c in b:
            hit = row & places.get(c, 0)
            if hit:
                row = (row + hit | row - hit) & full
        return start + end + len(a) - row.bit_count()

    return length


def lcs_length():
    """Arrow UDF ``(string, string) -> int``."""
    length = _of_two()

    @F.pandas_udf("int")
    def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([length(a, b) for a, b in zip(left, right)], dtype="int32")

    return lcs


def _of_word_sets():
    """The functions of two word sets, of one pair and of many. Local functions travel by value to workers."""
    length = _of_two()

    def one(a, b):
        a, b = a.split(" "), b.split(" ")
        both = set(a) & set(b)
        rest = [" ".join(w for w in words if w not in both) for words in (a, b)]
        return sum(len(w) + 1 for w in both) + length(*rest)

    def features(keys, words):
        """Of each key, padded: its words, the word and the code of each character; every word ends with a space."""
        ends = np.array([len(k) + 1 for k in keys])
        split = [k.split(" ") for k in keys]
        most = max(map(len, split))
        tokens = np.full((len(keys), most + 1), -1, np.int32)
        for r, own in enumerate(split):
            tokens[r, : len(own)] = [words.setdefault(w, len(words)) for w in own]
        width = int(ends.max())
        chars = np.array([k + " " for k in keys], f"<U{width}").view("<u4").reshape(len(keys), width)
        inside = np.arange(width) < ends[:, None]
        space = (chars == 32) & inside
        # the last place is of no word
        place = np.where(inside, np.cumsum(space, axis=1) - space, most)
        return tokens, place, np.where(inside, chars + 1, 0)

    def many(left, right, at, of):
        """Of the pairs ``left[at], right[of]``."""
        words = {}
        (ta, pa_, ca), (tb, pb, cb) = features(left, words), features(right, words)
        # code 0 is no character
        codes, coded = np.unique(np.concatenate([[0], ca.ravel(), cb.ravel()]), return_inverse=True)
        ca, cb = coded[1 : 1 + ca.size].reshape(ca.shape), coded[1 + ca.size :].reshape(cb.shape)
        rows, count = np.arange(len(at)), -(-ca.shape[1] // 64)
        # masks[key, code]: where the code is in the key
        masks = np.zeros((len(left), len(codes), 64 * count), bool)
        masks[np.arange(len(left))[:, None], ca, np.arange(ca.shape[1])] = ca > 0
        masks = np.packbits(masks, axis=2, bitorder="little").view("<u8")
        masks[:, 0] = 0
        wa, wb = ta[at], tb[of]
        in_a, in_b = np.zeros(wa.shape, bool), np.zeros(wb.shape, bool)
        for k in range(wb.shape[1] - 1):
            same = (wa == wb[:, k, None]) & (wa >= 0)
            in_a |= same
            in_b[:, k] = same.any(1)
        taken, real = in_a[rows[:, None], pa_[at]], (ca > 0)[at]
        common, open_a = taken & real, real & ~taken
        some = open_a.any(1)
        rest = np.zeros((len(at), 64 * count), bool)
        rest[:, : ca.shape[1]] = open_a
        rest = np.packbits(rest, axis=1, bitorder="little").view("<u8")
        codes_b = np.where(in_b[rows[:, None], pb[of]], 0, cb[of])
        some &= codes_b.any(1)
        state = [np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(count)]
        for column in np.ascontiguousarray(codes_b.T):
            hits, carry = masks[at, column] & rest, None
            for w in range(count):
                v = state[w]
                hit = v & hits[:, w]
                total = v + hit
                over = total < v
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                state[w] = total | (v - hit)
        found = sum(np.bitwise_count(~v).astype(np.int64) for v in state)
        # the space behind the last words is no part of what is left of them
        return common.sum(1) + found - some

    return one, many


def matched_length():
    """Arrow UDF ``(string, string) -> int`` of two word sets, each its words in order and one space apart.

    The length of the common words, each with a space, and of the longest common subsequence of the others,
    joined. Many pairs are compared at once: a row of the table is the bits of 64-bit words of each pair, and
    common words are bits that match nothing. Long titles are compared one by one.
    """
    one, many = _of_word_sets()
    chunk, longest = 10_000, 250

    @F.arrow_udf("int")
    def matched(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), np.int32)
        for start in range(0, len(left), chunk):
            sides = [side.slice(start, chunk).dictionary_encode() for side in (left, right)]
            keys = [side.dictionary.to_pylist() for side in sides]
            at, of = (side.indices.to_numpy() for side in sides)
            size = [np.array([len(k) for k in own], np.int64) for own in keys]
            long = np.maximum(size[0][at], size[1][of]) > longest
            part = out[start : start + chunk]
            for k in np.flatnonzero(long):
                part[k] = one(keys[0][at[k]], keys[1][of[k]])
            short = np.flatnonzero(~long)
            if len(short):
                (ia, at), (ib, of) = (np.unique(x[short], return_inverse=True) for x in (at, of))
                part[short] = many([keys[0][k] for k in ia], [keys[1][k] for k in ib], at, of)
        return pa.array(out)

    return matched
