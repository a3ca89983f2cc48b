"""Benchmark decontamination by edit distance (operator 3).

A passage of a document leaks an item if it turns into the item by edits of at most
``TOLERANCE`` of the item's words (lower-cased, punctuation apart). The CGK random walk maps a
window of words to a longer sequence so that edit distance becomes Hamming distance: it copies
the current word and then stays or moves on by a random bit of (step, word). Each walk is sampled at
``SAMPLED`` steps; windows of the item's size that agree with the item in all samples of some walk
are candidates, whose edit distance is then computed exactly. Edits put more of a long walk out
of step than of a short one, so the number of walks grows with the item (``tables``): at the full
tolerance, deletions included, over 0.99 of the leaks of items of 5 to 200 words are found.

Windows that cannot be near any item are not walked, which loses nothing: d edits change at most
q * d of the n - q + 1 runs of q words, so a window within the tolerance keeps the others, all of
them different runs of the item, each within d places of where it belongs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.tables import documents
from newsloom.llm.textwords import HashSet, char_spans, grams, mix, words

TOLERANCE = 0.2
#: Samples of a walk, steps of a walk for each word of the item, and windows walked at once.
SAMPLED = 2
STRETCH = 3
WINDOWS = 1024
SEED = 11
#: Words of a text searched at once; what a task holds for them is bounded by the items of a pass.
CHUNK = 1024
#: Items searched for in one pass over the documents; more are searched in further passes.
ITEMS = 10_000

SCHEMA = (
    "doc_id long, item_id long, distance int, n_words int, similarity double, "
    "start_char int, end_char int"
)


def tables(n):
    """Walks for an item of ``n`` words."""
    return 16 + n // 4


def walk_keys(hashes, starts, n, seed=SEED):
    """Keys (one row per window, one column per walk) of windows of ``n`` words of a sequence.

    ``starts`` may lie outside the sequence; places outside hold no word (0).
    """
    if len(starts) > WINDOWS:
        parts = np.array_split(starts, -(-len(starts) // WINDOWS))
        return np.vstack([walk_keys(hashes, part, n, seed) for part in parts])
    many = tables(n)
    sampled = np.random.default_rng([seed, n]).integers(0, n * STRETCH, (many, SAMPLED))
    padded = np.concatenate([hashes, np.zeros(1, np.uint64)])
    walk = np.arange(many, dtype=np.uint64) << np.uint64(32)
    at = np.zeros((len(starts), many), np.int64)
    low = np.maximum(0, -starts)[:, None]
    high = np.minimum(n, len(hashes) - starts)[:, None]
    symbols = np.zeros((SAMPLED, len(starts), many), np.uint64)
    for step in range(int(sampled.max()) + 1):
        word = padded[np.where((at >= low) & (at < high), starts[:, None] + at, len(hashes))]
        for table, k in np.argwhere(sampled == step):
            symbols[k, :, table] = word[:, table]
        coin = (word ^ (walk + np.uint64(step + 1))) * np.uint64(0x9E3779B97F4A7C15)
        at += ((coin ^ (coin >> np.uint64(29))) >> np.uint64(17) & np.uint64(1)).astype(np.int64)
    keys = np.zeros((len(starts), many), np.uint64)
    for k in range(SAMPLED):
        keys = mix(keys * np.uint64(31) + symbols[k] + np.uint64(k + 1))
    return keys


def supported_starts(starts, places, d, least):
    """Where a window may start: ``least`` different runs of the item lie within ``d`` places of their own.

    ``starts`` (in order) say where each run found would have the window start, ``places`` its place in the item.
    """
    # a run counts for the starts from its own less d to its own plus d
    events = sorted([(s - d, 1, p) for s, p in zip(starts, places)] + [(s + d + 1, 0, p) for s, p in zip(starts, places)])
    held, here, found = {}, None, []
    for at, enters, place in events:
        if len(held) >= least and here is not None and at > here:
            found.append(np.arange(here, at))
        here = at
        n = held.get(place, 0) + (1 if enters else -1)
        if n:
            held[place] = n
        else:
            del held[place]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def edit_distance_within(item, region):
    """Least edits that make some run of ``region`` into ``item``; ``(distance, start, end)``."""
    n = len(region)
    cost = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    index = np.arange(n + 1)
    for k, word in enumerate(item):
        best = cost + 1  # a word of the item is missing
        came = origin.copy()
        swap = cost[:-1] + (region != word)
        use = swap < best[1:]
        best[1:][use] = swap[use]
        came[1:][use] = origin[:-1][use]
        # words put in: the least of best[j] + (i - j) over j <= i
        lifted = best - index
        low = np.minimum.accumulate(lifted)
        first = np.maximum.accumulate(np.where(lifted == low, index, -1))
        keep = lifted == low
        came = np.where(keep, came, came[first])
        cost, origin = low + index, came
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


class Items:
    """Items prepared for search: their runs of words, allowed edits and walk keys."""

    def __init__(self, rows):
        self.ids, self.hashes, self.sizes, self.edits, self.least = [], [], [], [], []
        runs = {}  # (length of run) -> list of (hash, item, place)
        for item_id, text in rows:
            own = words(text or "")[2]
            n = len(own)
            if not n:
                continue
            d = int(TOLERANCE * n)
            q = max(q for q in (1, 2, 3) if q == 1 or n - q + 1 - q * d >= 1)
            k = len(self.ids)
            self.ids.append(item_id)
            self.hashes.append(own)
            self.sizes.append(n)
            self.edits.append(d)
            self.least.append(n - q + 1 - q * d)
            runs.setdefault(q, []).extend((h, k, p) for p, h in enumerate(grams(own, q).tolist()))
        self.runs = {}
        for q, found in runs.items():
            found.sort()
            self.runs[q] = (
                HashSet([f[0] for f in found]),
                np.array([f[0] for f in found], np.uint64),
                np.array([f[1] for f in found]),
                np.array([f[2] for f in found]),
            )
        self.keys = [walk_keys(h, np.zeros(1, np.int64), len(h))[0] for h in self.hashes]
        self.reach = max((n + 3 * d + 1 for n, d in zip(self.sizes, self.edits)), default=0)

    def supported(self, hashes):
        """``{item: starts}``: where enough of its runs lie in about the right place."""
        found = {}
        for q, (members, sorted_, items, places) in self.runs.items():
            runs = grams(hashes, q)
            at = members.positions(runs)
            if not len(at):
                continue
            low = np.searchsorted(sorted_, runs[at], "left")
            many = np.searchsorted(sorted_, runs[at], "right") - low
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            item, place = items[entry], places[entry]
            start = np.repeat(at, many) - place
            order = np.lexsort((start, item))
            item, start, place = item[order], start[order], place[order]
            cut = np.flatnonzero(np.diff(item)) + 1
            bounds = np.concatenate([[0], cut, [len(item)]])
            for k, low, high in zip(item[bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                least = self.least[k]
                if high - low < least:
                    continue
                near = supported_starts(start[low:high].tolist(), place[low:high].tolist(), self.edits[k], least)
                if len(near):
                    found[k] = near
        return found

    def leaks(self, hashes):
        """``(item, distance, first word, end word)`` of each item found."""
        best = {}
        # chunks overlap by the longest passage, so each passage lies in one of them
        for at in range(0, max(1, len(hashes)), CHUNK):
            for k, distance, a, b in self._nearest(hashes[at : at + CHUNK + self.reach]):
                if k not in best or distance < best[k][0]:
                    best[k] = (distance, at + a, at + b)
        return [(k, *found) for k, found in sorted(best.items())]

    def _nearest(self, hashes):
        if not len(hashes):
            return
        for k, starts in self.supported(hashes).items():
            n, d = self.sizes[k], self.edits[k]
            agree = (walk_keys(hashes, starts, n) == self.keys[k]).any(axis=1)
            best = None
            done = None
            for start in starts[agree].tolist():
                if done is not None and start <= done:
                    continue  # the region already compared holds this window
                low, high = max(0, start - d), min(len(hashes), start + n + 3 * d + 1)
                done = start + d
                distance, a, b = edit_distance_within(self.hashes[k], hashes[low:high])
                if distance <= d and (best is None or distance < best[1]):
                    best = (k, distance, low + a, low + b)
            if best:
                yield best


def _search(docs, items):
    def of_batches(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                starts, ends, hashes = words(text)
                for k, distance, a, b in items.leaks(hashes):
                    span = (int(starts[a]), int(ends[b - 1])) if b > a else (0, 0)
                    n = items.sizes[k]
                    rows.append(
                        (doc_id, items.ids[k], distance, n, 1.0 - distance / n, *char_spans(text, [span])[0])
                    )
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.mapInArrow(of_batches, SCHEMA)


def _passes(benchmark):
    """The items in blocks of about ``ITEMS``, prepared; equal ids stay in one block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null"
    )
    after = None
    while True:
        block = items if after is None else items.where(F.col("item_id") > after)
        rows = block.orderBy("item_id").limit(ITEMS).collect()
        full = len(rows) == ITEMS
        if full:
            rows = block.where(F.col("item_id") <= rows[-1][0]).collect()
        if rows:
            yield Items([tuple(r) for r in rows])
            after = rows[-1][0]
        if not full:
            return


def leaks(docs, benchmark):
    """One row per document and item it holds: the nearest passage and its edit distance in words.

    Items and documents without words match nothing; equal rows are reported each. Items are
    searched for in passes of ``ITEMS``, so what a task holds does not grow with the benchmark.
    """
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for items in _passes(benchmark):
        found = found.unionByName(_search(documents(docs), items))
    return found


def keep(docs, benchmark):
    """The rows of ``docs``, all columns, whose text holds no item."""
    at = docs.columns.index("text")

    def without(items):
        def of_batches(batches):
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([not items.leaks(words(t or "")[2]) for t in texts], pa.bool_()))

        return of_batches

    for items in _passes(benchmark):
        docs = docs.mapInArrow(without(items), docs.schema)
    return docs
