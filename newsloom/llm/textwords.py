"""Words of a text and their hashes, found with array operations instead of a loop."""

import numpy as np

# Letters and digits make words, and so does every byte of a character beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN_WORD[128:] = True
_VALUE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_powers = {}


def _power(base, n):
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mix(x):
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words(text):
    """``starts, ends`` (bytes of the lower-cased UTF-8 text) and ``hashes`` of the words."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _power(_BASE, len(raw)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts]
    return starts, ends, mix(hashes)


def grams(hashes, n):
    """A hash for each run of ``n`` words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + hashes[k : k + m]
    return mix(out)


class HashSet:
    """Membership of many hashes in a set, most of which are not in it."""

    BITS = 20

    def __init__(self, hashes):
        self.sorted = np.unique(np.asarray(hashes, np.uint64))
        self._maybe = np.zeros(1 << self.BITS, bool)
        self._maybe[self.sorted >> np.uint64(64 - self.BITS)] = True

    def positions(self, hashes):
        """Where ``hashes`` holds members."""
        at = np.flatnonzero(self._maybe[hashes >> np.uint64(64 - self.BITS)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        return at[self.sorted[k] == hashes[at]]


def char_spans(text, spans):
    """Character offsets in ``text`` of byte spans in its lower-cased UTF-8 form.

    Exact where lower-casing keeps the number of characters, else bounded by the text's length.
    """
    raw = text.lower().encode("utf-8", "surrogatepass")
    size = len(text)
    return [
        tuple(min(size, len(raw[:x].decode("utf-8", "surrogatepass"))) for x in span) for span in spans
    ]
