"""Repeated substrings by a distributed merge sort of suffixes (operator 2).

A byte is removed if a string of ``LENGTH`` = 200 bytes that covers it also starts anywhere
else. Only suffixes at content-chosen places are sorted: the *anchor* of a 200-byte window is
the place in it whose 32 bytes have the least hash, the first of several. Equal windows have
their anchors at equal places, so a window is repeated only if its anchor's 32 bytes occur at
another anchor, and two windows are equal exactly if they lie at the same distance from their
anchors, agree on the bytes from the anchor on, and on the bytes before it. So:

1. Each text gives its anchors; those whose 32 bytes (by hash) no other anchor has are dropped.
2. Each task sorts the suffixes at its remaining anchors into a run, folding equal ones into
   one, cuts the run at common splitters and sends every piece front coded.
3. Each receiving task merges the pieces with a loser tree, which gives the suffix order and
   the common prefix of neighbours. Windows that start ``o`` bytes before their anchors are
   equal if no common prefix below ``200 - o`` separates their suffixes and the ``o`` bytes
   before the anchors agree, which the same ordering of those bytes tells.
4. What is repeated goes back to the places a suffix stands for, and to the texts.

All suffixes with the same 32 bytes meet in one task, folded. Where these 32 bytes are very
frequent (``HOT``), each window length before the anchor is treated in one of eight ranges
(0, 1, 2-3, 4-7, ...), and suffixes meet only if they agree on all that every window of the
range must share; what they can then differ in is a few bytes, so folding keeps them few.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from newsloom.llm.runs import front_code, front_decode, merge
from newsloom.llm.tables import documents
from newsloom.workspace import write_through

LENGTH = 200
#: Bytes hashed at a place of a window.
SEED_BYTES = 32
#: Anchors that share their bytes with more others than this are hot.
HOT = 100_000
#: Suffixes sorted at once, and about as many merged at once.
RUN = 100_000
MERGED = 40_000

_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEPS = [pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(5)]
_LOW = np.uint64(0xFFFFFFFF)


def anchors(raw, length=LENGTH):
    """Anchors of all windows of ``raw`` (uint8): ``place, first window, last window, hash``."""
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    h = _VALUES[raw]
    for k, step in enumerate(_STEPS):
        h = h[: -(1 << k)] * np.uint64(step) + h[1 << k :]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the hash above, the place below: the least is the first place of the least hash
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    wide, span = length - SEED_BYTES + 1, 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: span - wide], low[wide - span :])
    place = (low & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return place[first], first, last, h[place[first]]


def _keyed(docs):
    """Documents with the hash of their text; equal rows share both and count as two starts."""
    return documents(docs).withColumn("_text", F.xxhash64("text"))


ANCHOR = "doc_id long, _text long, hash long, place int, low short, high short, start long"


def _anchor_rows(batches, length):
    for batch in batches:
        keys, parts = [], []
        for doc_id, mark, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "_text", "text"))):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            place, first, last, hashes = anchors(raw, length)
            if not len(place):
                continue
            keys.append((doc_id, mark, len(place)))
            # the leading bytes, of one place in 64, for the splitters
            start = np.full(len(place), -1, np.int64)
            for k in np.flatnonzero((hashes & np.uint64(63)) == 0).tolist():
                start[k] = _leading(raw[place[k] :].tobytes())
            parts.append((hashes.view(np.int64), place, place - last, place - first, start))
        if not keys:
            continue
        counts = [k[2] for k in keys]
        columns = [np.repeat([k[0] for k in keys], counts), np.repeat([k[1] for k in keys], counts)]
        columns += [np.concatenate([p[k] for p in parts]) for k in range(5)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c).cast(t) for c, t in zip(columns, kinds)],
            names=[c.split()[0] for c in ANCHOR.split(", ")],
        )


def _leading(key):
    """The first eight bytes as a non-negative long, in order."""
    return int.from_bytes(key[:8].ljust(8, b"\0"), "big") >> 1


def ranges(low, high):
    """The parts of ``low..high`` in 0, 1, 2-3, 4-7, ..."""
    out, a = [], 0
    while a <= high:
        b = max(0, 2 * a - 1) if a else 0
        if b >= low:
            out.append((max(a, low), min(b, high)))
        a = b + 1
    return out


RUN_SCHEMA = (
    "part int, run long, shared binary, lengths binary, rests binary, before_lengths binary, "
    "before binary, many binary, first_item long, item long, doc_id long, _text long, place int"
)


def _run_rows(batches, splits, parts, length):
    """Runs cut at the splitters (``part`` set) and the places of their items (``item`` set)."""
    task = TaskContext.get().partitionId()
    turn, held = 0, {}  # (after, before, part) -> places

    def told():
        nonlocal turn, held
        base = (task << 40) + (turn << 24)
        order = sorted(held, key=lambda k: (k[2], k[0]))
        rows = []
        cut = 0
        while cut < len(order):
            end = cut
            while end < len(order) and order[end][2] == order[cut][2]:
                end += 1
            own = order[cut:end]
            rows.append(
                (own[0][2], base, *front_code([k[0] for k in own]),
                 np.array([len(k[1]) for k in own], "<u2").tobytes(), b"".join(k[1] for k in own),
                 bytes(len(held[k]) > 1 for k in own), base + cut)
            )
            cut = end
        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6 + [pa.int64()]
        runs = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        runs += [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays(runs, names=names)
        counts = [len(held[k]) for k in order]
        places = [p for k in order for p in held[k]]
        columns = [pa.nulls(len(places), t) for t in kinds]
        columns.append(pa.array(np.repeat(np.arange(len(order)) + base, counts), pa.int64()))
        columns += [
            pa.array([p[k] for p in places], t)
            for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        turn, held = turn + 1, {}

    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("doc_id", "_text", "text", "found")))
        for doc_id, mark, text, found in rows:
            raw = text.encode("utf-8", "surrogatepass")
            # equal rows have listed their common anchors once each
            for place, low, high, hot in {tuple(a.values()) for a in found}:
                for a, b in ranges(low, high) if hot else [(low, high)]:
                    after = raw[place : place + length - a]
                    before = raw[place - b : place][::-1]
                    if hot:
                        common = _common(after, before, b, length)
                        part = parts + int.from_bytes(hashlib.blake2b(common, digest_size=6).digest()) % parts
                    else:
                        part = int(np.searchsorted(splits, _leading(after), "right"))
                    held.setdefault((after, before, part), []).append((doc_id, mark, place))
            if len(held) >= RUN:
                yield from told()
    if held:
        yield from told()


def _base(b):
    """The least value of the range that ``b`` is in."""
    return 1 << (b.bit_length() - 1) if b else 0


def _common(after, before, b, length):
    """What all windows of the range that ``b`` is in share, however far the anchor itself reaches."""
    base = _base(b)
    end = min(2 * base - 1, length - SEED_BYTES) if base else 0
    return after[: length - end] + b"%d" % b.bit_length() + before[:base]


FOUND_SCHEMA = "item long, low int, high int"


def _merged(table, length):
    """Repeated windows of one part: ``item, low, high``, the distances before the anchor."""
    runs, before, many, ids = [], [], [], []
    columns = {c: table[c].to_pylist() for c in table.column_names}
    for k in range(table.num_rows):
        keys, shared = front_decode(columns["shared"][k], columns["lengths"][k], columns["rests"][k])
        runs.append((keys, shared))
        ends = np.cumsum(np.frombuffer(columns["before_lengths"][k], "<u2"), dtype=np.int64).tolist()
        blob = columns["before"][k]
        before.append([blob[a:b] for a, b in zip([0, *ends[:-1]], ends)])
        many.append(columns["many"][k])
        ids.append(columns["first_item"][k])
    item, weight, prefix, low, lefts = [], [], [], [], []
    for run, index, n in merge(runs):
        item.append(ids[run] + index)
        weight.append(1 + many[run][index])
        prefix.append(n)
        low.append(length - len(runs[run][0][index]))
        lefts.append(before[run][index])
    runs = before = None
    prefix, low, weight = np.array(prefix), np.array(low), np.array(weight)
    high = np.array([len(x) for x in lefts])
    # the order of what stands before the anchors, and the common prefixes in that order
    order = sorted(range(len(lefts)), key=lefts.__getitem__)
    shared = np.array(np.frombuffer(front_code([lefts[k] for k in order])[0], "<u2"), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    out = []
    for o in range(int(high.max()) + 1):
        here = np.flatnonzero((low <= o) & (o <= high))
        if not len(here):
            continue
        after_class = np.cumsum(prefix < length - o)[here]
        before_class = np.cumsum(shared < o)[rank[here]]
        both = after_class * (len(order) + 1) + before_class
        _, inverse = np.unique(both, return_inverse=True)
        repeated = here[np.bincount(inverse, weights=weight[here])[inverse] > 1]
        out.append(np.stack([repeated, np.full(len(repeated), o)]))
    found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    found = found[:, np.lexsort(found[::-1])]
    # neighbouring distances of one item as a range
    new = np.ones(found.shape[1], bool)
    new[1:] = (np.diff(found[0]) != 0) | (np.diff(found[1]) != 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(new) - 1]]) if len(first) else first
    return pa.table(
        {
            "item": pa.array(np.array(item, np.int64)[found[0, first]]),
            "low": pa.array(found[1, first], pa.int32()),
            "high": pa.array(found[1, last], pa.int32()),
        }
    )


def spans(docs, length=LENGTH, hot=HOT):
    """``doc_id, _text, spans``: byte ranges ``(start, end)`` covered by repeated windows.

    One row for each text that has any; equal rows (same id and text) share theirs. ``length``
    must be from 32 to 255 bytes.
    """
    keyed = _keyed(docs)
    every = write_through(
        keyed.mapInArrow(lambda batches: _anchor_rows(batches, length), ANCHOR), "anchors"
    )
    shared = every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that Spark can split a hot hash in the join
    shared = write_through(shared, "hashes")
    kept = every.join(shared, "hash").select(
        "doc_id", "_text", "place", "low", "high", "start", (F.col("n") > hot).alias("hot")
    )
    kept = write_through(kept, "shared-anchors")
    parts = max(1, -(-kept.count() // MERGED))
    cuts = kept.where("start >= 0").select(
        F.percentile_approx("start", [k / parts for k in range(1, parts)] or [0.5], 10_000)
    )
    splits = np.array((cuts.first()[0] or []) if parts > 1 else [], np.int64)
    found = kept.groupBy("doc_id", "_text").agg(
        F.collect_list(F.struct("place", "low", "high", "hot")).alias("found")
    )
    runs = write_through(
        keyed.join(found, ["doc_id", "_text"]).mapInArrow(
            lambda batches: _run_rows(batches, splits, parts, length), RUN_SCHEMA
        ),
        "runs",
    )
    repeated = (
        runs.where("part is not null")
        .select("part", "shared", "lengths", "rests", "before_lengths", "before", "many", "first_item")
        .groupBy("part")
        .applyInArrow(lambda table: _merged(table, length), FOUND_SCHEMA)
    )
    places = runs.where("item is not null").select("item", "doc_id", "_text", "place")
    # windows from high to low bytes before the anchor cover one range of bytes
    span = F.struct(
        (F.col("place") - F.col("high")).alias("start"),
        (F.col("place") - F.col("low") + length).alias("end"),
    )
    return places.join(repeated, "item").groupBy("doc_id", "_text").agg(
        F.collect_set(span).alias("spans")
    )


def _merge_spans(found):
    out = []
    for start, end in sorted((s["start"], s["end"]) for s in found or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut(text, found):
    """Bytes, merged spans and kept bytes of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    merged = _merge_spans(found)
    edges = [0, *(x for s in merged for x in s), len(raw)]
    return raw, merged, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove(docs, length=LENGTH, hot=HOT):
    """Every document without its repeated bytes.

    ``doc_id, n_bytes, n_removed, spans`` (array of ``start, end``), ``kept`` (binary). A null
    or empty text stays empty; equal rows repeat each other; an empty table gives no rows.
    """
    found = spans(docs, length, hot)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept binary"

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans"))):
                raw, merged, kept = _cut(text, own)
                rows.append((doc_id, len(raw), len(raw) - len(kept), merged, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    joined = _keyed(docs).join(found, ["doc_id", "_text"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, schema)


def clean(docs, length=LENGTH, hot=HOT):
    """The rows of ``docs``, all columns, with repeated bytes cut out of ``text``; ``n_chars``,
    where there is such a column, is counted anew.

    A character that loses some of its bytes goes. A text of which nothing but white space is
    left goes with its row; other rows stay, empty texts and rows without id as they are.
    """
    found = spans(docs, length, hot).toDF("_doc", "_key", "_spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64(text) == F.col("_key"))
    joined = docs.join(found, same, "left").select(*docs.columns, "_spans")
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for batch in batches:
            texts, fine = batch.column(at).to_pylist(), []
            counts = batch.column(chars).to_pylist() if chars is not None else None
            for k, own in enumerate(batch.column(len(batch.schema) - 1).to_pylist()):
                if own:
                    texts[k] = _cut(texts[k], own)[2].decode("utf-8", "ignore")
                    if counts:
                        counts[k] = len(texts[k])
                fine.append(not own or bool(texts[k].strip()))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema[at].type)
            if counts:
                columns[chars] = pa.array(counts, batch.schema[chars].type)
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield out.filter(pa.array(fine, pa.bool_()))

    return joined.mapInArrow(cut, docs.schema)
