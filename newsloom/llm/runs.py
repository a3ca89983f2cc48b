"""Sorted runs of strings: front coding, and merging that never compares a known prefix again."""

import numpy as np


def common_prefix(a, b, known=0):
    """Length of the common prefix of two byte strings that agree on ``known`` bytes."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(keys):
    """Sorted byte strings as ``(prefix lengths, lengths of the rests, rests)``; bytes each."""
    shared, previous = [], b""
    for key in keys:
        shared.append(common_prefix(previous, key))
        previous = key
    rests = [key[n:] for key, n in zip(keys, shared)]
    return (
        np.array(shared, "<u2").tobytes(),
        np.array([len(r) for r in rests], "<u2").tobytes(),
        b"".join(rests),
    )


def front_decode(shared, lengths, rests):
    """The keys of a run and their common prefixes with the key before."""
    shared = np.frombuffer(shared, "<u2").tolist()
    ends = np.cumsum(np.frombuffer(lengths, "<u2"), dtype=np.int64).tolist()
    keys, previous, start = [], b"", 0
    for n, end in zip(shared, ends):
        previous = previous[:n] + rests[start:end]
        keys.append(previous)
        start = end
    return keys, shared


def merge(runs):
    """Merge runs of ``(keys, common prefixes)`` with a loser tree.

    Yields ``(run, index, common prefix with the key yielded before)`` in key order. Every
    contender carries the length of its common prefix with the last winner. Of two contenders
    the one that shares more with it is the smaller, without looking at the keys; only on equal
    lengths are keys compared, from that length on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    keys = [r[0] for r in runs] + [[]] * (leaves - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (leaves - len(runs))
    sizes = [len(k) for k in keys]
    at = [0] * leaves
    known = [0] * leaves  # common prefix of each run's head with the last winner
    losers = [0] * leaves

    def duel(a, b):
        """The winner first; the loser's ``known`` is set against the winner."""
        if at[a] >= sizes[a]:
            return b, a
        if at[b] >= sizes[b]:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = keys[a][at[a]], keys[b][at[b]]
        n = common_prefix(x, y, known[a])
        if n < len(x) and n < len(y):
            a_wins = x[n] < y[n]
        else:  # one is a prefix of the other; equal keys go by run
            a_wins = a < b if len(x) == len(y) else n == len(x)
        if a_wins:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node):
        if node >= leaves:
            return node - leaves
        winner, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if leaves > 1 else 0
    for _ in range(sum(sizes)):
        index = at[winner]
        yield winner, index, known[winner]
        at[winner] = index + 1
        if index + 1 < sizes[winner]:
            known[winner] = prefixes[winner][index + 1]
        node = (winner + leaves) // 2
        while node:
            winner, losers[node] = duel(winner, losers[node])
            node //= 2
