"""Drawing documents so that their features come out as in a target text (operator 13).

A document's features are its words and pairs of neighbouring words, each hashed to one of 10,000
buckets. The logarithm of how much more frequent a bucket is in the target gives it a gain, the mean gain
of its features a document its weight, and weight plus a pseudo-random term its score. The highest scores
are drawn: the lowest drawn score is found by bisection, each round one job that counts the persisted
scores beyond a few thresholds, then the last drawn id among equal scores in the same way. The drawn rows are
dealt out by ranges of score, so that a rank is a place in a range plus the rows of the ranges before.

A null text has no words. Rows without an id are left out. Rows that repeat an id and a score are ordered by
their number of features and drawn up to the exact number. Empty tables give empty results or, for an
empty target, gains of a target without features. Further columns are ignored.
"""

import hashlib
import math
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.tables import documents
from newsloom.workspace import write_through

BUCKETS = 10_000
#: Bytes of text whose words are hashed at once; a longer text takes several rounds.
ROUND_BYTES = 1 << 20
#: Thresholds counted by one job.
PIVOTS = 15

# Digits, lower-case letters and all bytes beyond ASCII make words; A-Z becomes a-z, the rest a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SPACE = 32
#: Longer words are hashed one by one.
_TABLED = 63


def _byte_table():
    """What eight shifts make of each byte of a CRC-32 register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _zero_tables():
    """``[n][k][b]``: what n zero bytes make of byte b at place k of a CRC-32 register."""
    tables = np.empty((_TABLED + 2, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(tables)):
        tables[n] = _BYTES[tables[n - 1] & 255] ^ (tables[n - 1] >> 8)
    return tables


_BYTES = _byte_table()
_ZEROS = _zero_tables()


def _shifted(crc, n):
    """The checksums ``crc`` as they are ``n`` bytes later, without those bytes."""
    places = [_ZEROS[n, k, (crc >> np.uint32(8 * k)) & 255] for k in range(4)]
    return places[0] ^ places[1] ^ places[2] ^ places[3]


def _checksums(raw, text, starts, sizes):
    """CRC-32 of each word of ``text``, byte by byte for all words at once; ``raw`` is the text as an array."""
    out = np.empty(len(starts), np.uint32)
    longest_first = np.argsort((_TABLED + 1 - np.minimum(sizes, _TABLED + 1)).astype(np.uint8), kind="stable")
    short = longest_first[sizes[longest_first] <= _TABLED]
    for w in longest_first[: len(longest_first) - len(short)]:
        out[w] = zlib.crc32(text[starts[w] : starts[w] + sizes[w]])
    at, left = starts[short], sizes[short]
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    # words of at least k + 1 bytes come first
    reaching = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
    for k, n in enumerate(reaching):
        crc[:n] = _BYTES[(crc[:n] ^ raw[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out[short] = ~crc
    return out


def feature_buckets(texts):
    """The buckets of the features of texts (UTF-8), in rounds of bounded size.

    Yields ``(words, owners, buckets)``: the index of its text for each word, for each feature, and the
    bucket of each feature.
    """
    held, size = [], 0
    for owner, raw in enumerate(texts):
        for piece, begins in _pieces(raw):
            held.append((owner, piece, begins))
            size += len(piece)
            if size >= ROUND_BYTES:
                yield _round(held)
                held, size = [], 0
    if held:
        yield _round(held)


def _round(held):
    owners, pieces, begins = zip(*held)
    text = b" ".join(pieces).translate(_FOLD) + b" "
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], raw != _SPACE])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    piece = np.searchsorted(begin, starts, "right") - 1
    owner = np.array(owners)[piece]
    first = np.ones(len(starts), bool)
    first[1:] = piece[1:] != piece[:-1]
    # a piece that continues a text begins with the last word of the piece before
    ones = np.flatnonzero(~(first & ~np.array(begins)[piece]))
    seconds = np.flatnonzero(~first)
    firsts = seconds - 1
    crc = _checksums(raw, text, starts, sizes)
    pairs = np.empty(len(seconds), np.uint32)
    short = sizes[seconds] <= _TABLED
    a, b = firsts[short], seconds[short]
    spaced = crc[b] ^ _shifted(np.full(len(b), zlib.crc32(b" "), np.uint32), sizes[b])
    pairs[short] = _shifted(crc[a], sizes[b] + 1) ^ spaced
    for k in np.flatnonzero(~short):
        w = seconds[k]
        pairs[k] = zlib.crc32(b" " + text[starts[w] : ends[w]], int(crc[firsts[k]]))
    buckets = np.concatenate([crc[ones], pairs]).astype(np.int64) % BUCKETS
    return owner[ones], np.concatenate([owner[ones], owner[seconds]]), buckets


def _pieces(raw):
    """A text in pieces of bounded size: ``(bytes, whether the text begins here)``, cut between words."""
    if len(raw) <= ROUND_BYTES:
        yield raw, True
        return
    folded, at, last = raw.translate(_FOLD), 0, b""
    while at < len(folded):
        end = folded.find(b" ", at + ROUND_BYTES)
        end = len(folded) if end < 0 else end
        piece = folded[at:end].strip(b" ")
        if piece:
            yield (last + b" " + piece, False) if last else (piece, True)
            last = piece[piece.rfind(b" ") + 1 :]
        at = end


def bucket_counts(texts):
    """How many features of all ``text`` values fall into each bucket: at most 10,000 rows ``bucket, n``."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raws = batch["text"].cast(pa.binary()).to_pylist()
            for _, _, buckets in feature_buckets(raws):
                total += np.bincount(buckets, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    read = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = read.mapInArrow(count, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source, target):
    """The gain of each bucket, from the bucket counts of all documents and of the target."""
    of = []
    for counts in (source, target):
        dense = [0] * BUCKETS
        for r in counts.collect():  # bounded by the buckets
            dense[r["bucket"]] = r["n"]
        of.append(dense)
    s, t = of
    all_s, all_t = sum(s) + BUCKETS, sum(t) + BUCKETS
    ratio = (float(y + 1) * all_s / (float(x + 1) * all_t) for x, y in zip(s, t))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id, seed):
    """The pseudo-random part of a score."""
    h = int(hashlib.sha256(b"%d:%d" % (seed, doc_id)).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs, gain, seed):
    """``doc_id, n_words, n_features, weight, score`` of every document."""

    def scored(batches):
        for batch in batches:
            raws = batch["text"].cast(pa.binary()).to_pylist()
            words, features, total = (np.zeros(len(raws), np.int64) for _ in range(3))
            for ones, owners, buckets in feature_buckets(raws):
                words += np.bincount(ones, minlength=len(raws))
                features += np.bincount(owners, minlength=len(raws))
                np.add.at(total, owners, gain[buckets])
            weight = total // np.maximum(features, 1)
            random = np.array([noise(d, seed) for d in batch["doc_id"].to_pylist()], np.int64)
            columns = [batch["doc_id"], *(pa.array(c) for c in (words, features, weight, weight + random))]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "n_words", "n_features", "weight", "score"]
            )

    return documents(docs).mapInArrow(
        scored, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def least_reaching(rows, column, wanted):
    """The smallest value of a whole-number column that ``wanted`` rows do not exceed, and how many are below it.

    Each round is one exact counting job for several thresholds; the range shrinks 16-fold. None where
    there are fewer rows.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if wanted < 1 or n < wanted:
        return None
    # at least `wanted` rows are at most `high`, fewer are below `low`
    below = 0
    while low < high:
        pivots = sorted({low + (high - low) * k // (PIVOTS + 1) for k in range(1, PIVOTS + 1)} - {high})
        counts = rows.agg(*(F.count_if(F.col(column) <= F.lit(p)) for p in pivots)).first()
        for pivot, n in zip(pivots, counts):
            if n >= wanted:
                high = pivot
                break
            low, below = pivot + 1, n
    return low, below


def draw(docs, target, percent, least_words, seed):
    """All documents with their score; the ``percent`` highest scores have a ``rank`` from 1 on.

    Only documents of ``least_words`` words or more count and are drawn. Columns ``doc_id, n_words,
    n_features, weight, score, rank``.
    """
    spark = docs.sparkSession
    texts = documents(docs)
    gain = gains(bucket_counts(texts), bucket_counts(target))
    scored = write_through(score(docs, gain, seed), "scores")
    keyed = scored.withColumn("_key", -F.col("score"))
    counted = keyed.where(F.col("n_words") >= least_words)
    number = counted.count() * percent // 100
    cut = least_reaching(counted, "_key", number)
    unranked = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select("*", unranked)
    key, below = cut
    tied = counted.where(F.col("_key") == key)
    last_id, _ = least_reaching(tied, "doc_id", number - below)
    within = (F.col("_key") < key) | ((F.col("_key") == key) & (F.col("doc_id") <= last_id))
    drawn = within & (F.col("n_words") >= least_words)
    order = ["_key", "doc_id", "n_features", "weight"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = keyed.where(drawn).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # the number holds the range in its upper bits and the place in the range in its lower 33
    placed = write_through(in_order.withColumn("_place", F.monotonically_increasing_id()), "drawn")
    ranges = placed.groupBy(F.shiftright("_place", 33).alias("_range")).agg(F.count("*").alias("n"))
    before, offsets = 0, []
    for r in ranges.orderBy("_range").collect():  # one row per range
        offsets.append((r["_range"], before))
        before += r["n"]
    offsets = spark.createDataFrame(offsets, "_range long, _before long")
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("_range", F.shiftright("_place", 33)).join(F.broadcast(offsets), "_range").select(
        *scored.columns, F.when(rank <= number, rank).alias("rank")
    )
    return ranked.unionByName(keyed.where(~drawn).select(*scored.columns, unranked))


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPLIT = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH words AS (
    SELECT doc_id AS id, false AS target, {_SPLIT} AS w FROM documents
    UNION ALL SELECT item_id, true, {_SPLIT} FROM benchmark),
listed AS (
    SELECT id, target, len(w) AS n_words,
           list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS features
    FROM words),
each AS (
    SELECT id, target, feature, count(*) AS n
    FROM (SELECT id, target, unnest(features) AS feature FROM listed) GROUP BY ALL),
steps AS (
    SELECT list(c ORDER BY b) AS s FROM (
        SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
        FROM (SELECT unnest(range(256)) AS b))),
hexed AS (SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM each)),
hashed AS (
    SELECT feature, xor(list_reduce(
               list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT),
               lambda c, x: xor(c >> 8, s[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM hexed, steps),
bucketed AS (SELECT id, target, bucket, n FROM each JOIN hashed USING (feature)),
counts AS (
    SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::BIGINT AS s, coalesce(sum(n) FILTER (target), 0)::BIGINT AS t
    FROM bucketed GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT + 10000 AS all_s, sum(t)::BIGINT + 10000 AS all_t FROM counts),
gain AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * all_s) / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain
    FROM counts, totals),
weighed AS (
    SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
    FROM bucketed JOIN gain USING (bucket) WHERE NOT target GROUP BY id),
scored AS (
    SELECT id AS doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || sha256('7:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM listed LEFT JOIN weighed USING (id) WHERE NOT target),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) OVER (PARTITION BY n_words >= 20) * 25 // 100 AS drawn
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank
FROM ranked"""
