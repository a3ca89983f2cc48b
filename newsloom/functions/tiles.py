"""All pairs of two blocks of titles whose texts may align: bounds first, the exact length for what is left.

A block is compared with a block at once, as arrays. What bounds and lengths say holds for titles in any script.
"""

import numpy as np
import pyarrow as pa

from newsloom.functions.lcs import _of_word_sets

ALIGNED = "x long, y long, matched long, total long"


def aligned_in_tile(cutoff, one_table):
    """Function of a table with one row, a tile, for ``applyInArrow``: the pairs ``x, y`` of a node of ``a`` and
    one of ``b`` with ``matched`` and ``total`` length, whose score of alignment is ``cutoff`` or more.

    ``a`` and ``b`` are lists of ``node, key``, a key being the words of a set in order and one space apart. With
    ``one_table`` both are blocks of the same table, and a block meets itself in pairs ``x < y`` alone.

    The distance of two texts is at most ``room``, a share of both lengths, in three steps:

    - Counts of characters in unary code differ in no more bits than texts in insertions and deletions. All
      pairs of two blocks come from one product of matrices; the bits that tell most apart are taken.
    - Words of common hash bound what common words add. The longest common subsequence of the whole texts and
      these are no less than what matches. A row of its table is bits of a number; a pair is dropped
      as soon as the rest of both texts cannot make up for what is missing.
    - What is left, few pairs, is compared by words and what remains of them.

    Long titles have the first step and are then compared one by one.
    """
    one, many = _of_word_sets()
    buckets, levels, most_bits = 64, 64, 256
    rows_left, rows_right, chunk, longest = 1024, 4096, 16384, 250
    hashes = 1024
    share = 1 - cutoff / 100
    every = np.uint64(0xFFFFFFFFFFFFFFFF)

    class Side:
        """The titles of a block, by length."""

        def __init__(self, rows):
            nodes = rows.field("node").to_numpy(zero_copy_only=False)
            keys = rows.field("key").to_pylist()
            size = np.array([len(k) for k in keys], np.int64)
            order = np.lexsort((nodes, size))
            self.nodes, self.size = nodes[order], size[order]
            self.keys = [keys[k] for k in order]
            text = "".join(self.keys).encode("utf-32-le", "surrogatepass")
            self.chars = np.frombuffer(text, "<u4").astype(np.int64)
            self.row = np.repeat(np.arange(len(keys)), self.size)
            self.start = np.cumsum(self.size) - self.size

        def coded(self, codes):
            self.code = codes[self.chars]
            self.counts = np.bincount(
                self.row * buckets + np.minimum(self.code - 1, buckets - 1), minlength=len(self.keys) * buckets
            ).reshape(-1, buckets)

        def bits(self, bucket, level):
            found = self.counts[:, bucket] > level
            self.unary = found.astype(np.float32)
            self.spare = (found.sum(1) - share * self.size) / 2

        def words(self):
            """Of each title the hash and the length of each word, with its space; short titles only."""
            split = [k.split(" ") if len(k) <= longest else [] for k in self.keys]
            most = max(1, max(map(len, split)))
            self.hash = np.zeros((most, len(split)), np.int64)
            self.long = np.zeros((most, len(split)), np.int64)
            seen = {}
            for r, own in enumerate(split):
                for k, w in enumerate(own):
                    h = seen.get(w)
                    if h is None:
                        h = seen[w] = hash(w) % hashes
                    self.hash[k, r] = h
                    self.long[k, r] = len(w) + 1

        def block(self, low, high):
            """The codes of the characters of some titles: a row per place, a column per title."""
            width = int(self.size[low:high].max())
            found = np.zeros((width, high - low), np.int64)
            first, last = self.start[low], self.start[high - 1] + self.size[high - 1]
            row = self.row[first:last]
            found[np.arange(first, last) - self.start[row], row - low] = self.code[first:last]
            return found

    def masks(places, codes):
        """``masks[title * codes + code]``: the places of the code in the title, as 64-bit words."""
        width, rows = places.shape
        found = np.zeros((rows, codes, -(-width // 64)), np.uint64)
        titles = np.arange(rows)
        for k in range(width):
            found[titles, places[k], k >> 6] |= np.uint64(1 << (k & 63))
        found[:, 0] = 0
        return np.ascontiguousarray(np.moveaxis(found, 2, 0)).reshape(-1, rows * codes)

    # below[k]: the first k of 64 places
    below = np.array([(1 << k) - 1 for k in range(65)], np.uint64)

    def matched_before(state, end):
        """How many places before ``end`` are matched."""
        found = 0
        for w, v in enumerate(state):
            low = below.take(end if len(state) == 1 else end - 64 * w, mode="clip")
            found = found + np.bitwise_count(~v & low).astype(np.int64)
        return found

    def kept(mask, codes, places, la, lb, at, of, least):
        """Which pairs have a longest common subsequence of ``least`` or more, by the table of whole texts.

        ``mask`` has the titles of ``at`` and ``places`` those of ``of``; ``la``, ``lb`` are the lengths of each pair.
        """
        which = np.arange(len(at))
        base = at * codes
        state = [np.full(len(at), every) for _ in mask]
        last = int(lb.max())
        for k in range(last):
            spot = places[k].take(of)
            spot += base
            carry = None
            for w, own in enumerate(mask):
                v = state[w]
                hit = v & own.take(spot)
                total = v + hit
                if len(mask) > 1:
                    over = total < v
                    if carry is not None:
                        total = total + carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                state[w] = total | (v - hit)
            done = k + 1
            if done == last or (done >= 16 and done % 4 == 0):
                # texts from these places on are equally long, so the best that can follow begins there
                rest = np.minimum(np.maximum(lb - done, 0), la)
                able = matched_before(state, la - rest) + rest >= least
                if done == last or np.count_nonzero(able) < 0.8 * len(able):
                    which, of, base, la, lb, least = (x[able] for x in (which, of, base, la, lb, least))
                    state = [v[able] for v in state]
                    if not len(which):
                        break
        return which

    def survivors(a, b, same):
        """Pairs ``at, of`` that the bounds leave, by blocks of rows."""
        ratio = cutoff / (200 - cutoff)
        margin = 0.01 + 1e-6 * float(a.size[-1] + b.size[-1])
        codes = int(max(a.code.max(), b.code.max())) + 1
        for low in range(0, len(a.keys), rows_left):
            high = min(low + rows_left, len(a.keys))
            begin = int(np.searchsorted(b.size, a.size[low] * ratio - 1e-6))
            stop = int(np.searchsorted(b.size, a.size[high - 1] / ratio + 1e-6, "right"))
            if same:
                begin = max(begin, low)
            left = np.column_stack([a.unary[low:high], -a.spare[low:high], np.ones(high - low)]).astype(np.float32)
            short = a.size[high - 1] <= longest
            places_a = a.block(low, high) if short else None
            mask_a = None
            for first in range(begin, stop, rows_right):
                end = min(first + rows_right, stop)
                right = np.column_stack([b.unary[first:end], np.ones(end - first), -b.spare[first:end]]).astype(np.float32)
                at, of = np.divmod(np.flatnonzero((left @ right.T).ravel() >= -margin), end - first)
                la, lb = a.size[low:high][at], b.size[first:end][of]
                fits = np.abs(la - lb) <= share * (la + lb) + 1e-9
                if same:
                    fits &= of + first > at + low
                at, of, la, lb = (x[fits] for x in (at, of, la, lb))
                if not (short and b.size[end - 1] <= longest):
                    yield at + low, of + first
                    continue
                places_b = b.block(first, end)
                # the side of fewer 64-bit words is the one that is held as masks
                turned = -(-places_b.shape[0] // 64) < -(-places_a.shape[0] // 64)
                if turned:
                    mask = masks(places_b, codes)
                else:
                    mask = mask_a = masks(places_a, codes) if mask_a is None else mask_a
                held = np.zeros((end - first) * hashes, bool)
                for k in range(len(b.hash)):
                    own = np.flatnonzero(b.long[k, first:end])
                    held[own * hashes + b.hash[k, first:end][own]] = True
                for part in range(0, len(at), chunk):
                    i, j, li, lj = (x[part : part + chunk] for x in (at, of, la, lb))
                    common = np.zeros(len(i), np.int64)
                    for k in range(len(a.hash)):
                        common += held.take(j * hashes + a.hash[k, low:high].take(i)) * a.long[k, low:high].take(i)
                    least = np.ceil(cutoff * (li + lj) / 200 - 1e-9).astype(np.int64) - common
                    if turned:
                        which = kept(mask, codes, places_a, lj, li, j, i, least)
                    else:
                        which = kept(mask, codes, places_b, li, lj, i, j, least)
                    yield i[which] + low, j[which] + first

    def matched(a, b, at, of):
        out = np.zeros(len(at), np.int64)
        long = np.maximum(a.size[at], b.size[of]) > longest
        for k in np.flatnonzero(long):
            out[k] = one(a.keys[at[k]], b.keys[of[k]])
        short = np.flatnonzero(~long)
        for part in range(0, len(short), chunk):
            some = short[part : part + chunk]
            (ia, i), (ib, j) = (np.unique(x[some], return_inverse=True) for x in (at, of))
            out[some] = many([a.keys[k] for k in ia], [b.keys[k] for k in ib], i, j)
        return out

    def compared(table):
        found = []
        for tile in range(table.num_rows):
            ba, xa, bb, xb = (table.column(c)[tile].as_py() for c in ("ba", "xa", "bb", "xb"))
            a, b = (Side(table.column(c)[tile].values) for c in ("a", "b"))
            many_chars = max(int(a.chars.max()), int(b.chars.max())) + 1
            often = np.bincount(a.chars, minlength=many_chars) + np.bincount(b.chars, minlength=many_chars)
            used = np.flatnonzero(often)
            codes = np.zeros(many_chars, np.int64)
            # 0 is no character; the most common ones have a bucket each
            codes[used[np.argsort(-often[used], kind="stable")]] = np.arange(1, len(used) + 1)
            for side in (a, b):
                side.coded(codes)
            top = min(levels, int(max(a.counts.max(), b.counts.max())))
            share_set = np.array([(a.counts > t).sum(0) + (b.counts > t).sum(0) for t in range(top)]) / (len(a.keys) + len(b.keys))
            tells = (share_set * (1 - share_set)).ravel()
            best = np.argsort(-tells, kind="stable")[:most_bits]
            level, bucket = np.divmod(best[tells[best] > 0.002], buckets)
            for side in (a, b):
                side.bits(bucket, level)
                side.words()
            left = [(np.zeros(0, np.int64),) * 2, *survivors(a, b, one_table and (ba, xa) == (bb, xb))]
            at, of = map(np.concatenate, zip(*left))
            length, total = matched(a, b, at, of), a.size[at] + b.size[of]
            good = 200.0 * length / total >= cutoff
            found.append([x[good] for x in (a.nodes[at], b.nodes[of], length, total)])
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], ["x", "y", "matched", "total"])

    return compared
