"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8.

First the fingerprints: documents whose five-word fingerprints differ in two bits at most are found by
covering masks, compared exactly, and linked, with those of an equal MinHash value. That joins up most copies at little cost, but a fingerprint
of 64 bits cannot find all such pairs: at 0.8 two of them differ in ten bits on average. So candidates
for the rest come from prefixes, and no pair is missed: where all sets are put in one order, two sets of
that similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of their n. The order has
shingles that a sample shows to be frequent last, so common lines bring few together; any order gives
the same result. A pair is taken up at its first common shingle if what follows in both can still make
up the similarity.

Before any text moves, a pair's parity bitmaps are compared: bit k of a bitmap tells whether the set has an odd
number of shingles that hash to k, so two bitmaps differ in no more bits than the sets differ in shingles.
Large sets would fill a bitmap of fixed size with even odds, and any two would pass; they have a second one, of at
least a bit a shingle. Pairs that pass are compared exactly, on the whole sets, made from the texts. A text with many pairs is sent to
several tasks, once for each share of its pairs, and stands ahead of the texts it is compared with.

Documents with equal sets meet once, as one node. Members of a bucket are compared with one of them
first; what is linked so far is one component, and then only members of different components are paired,
so a large group of copies does not pair up all its members. A common line can bring many groups into one bucket, and its
one member then links few of them, so texts with an equal MinHash value are compared with the first of them before.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import simhash
from newsloom.llm.components import roots
from newsloom.llm.simhash import SEED, words
from newsloom.llm.tables import documents, slices, text_batches
from newsloom.operators.membership import key_filter, members
from newsloom.workspace import write_through

SHINGLE = 5
SIMILARITY = 0.8
#: Rounds in which a bucket's members are compared with one of them; then all that is left is paired.
STARS = 2
#: Texts that are compared with one copy of another, on average.
TOGETHER = 64
#: Texts to compare that are sent at a time.
COMPARED = 100
#: Documents sampled for the order of shingles, and frequent shingles told.
SAMPLE = 4000
FREQUENT = 50_000
#: Words of a parity bitmap, 64 bits each.
PARITY = [f"p{k}" for k in range(16)]
#: MinHash values of a set: the least product of its hashes with each odd number.
MINHASHES = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]
#: Words of the shorter bitmap that goes along with a bucket's members where all of them are paired.
FOLDED = [f"q{k}" for k in range(4)]


def shingles(text, shingle=SHINGLE, seed=SEED):
    """The distinct hashes of the text's shingles, sorted; a short text is one shingle."""
    own = words(text).split(b" ")
    n = max(1, len(own) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(own[k : k + shingle]), seed) for k in range(n)], np.uint64))


def prefix(hashes, least, frequent, ranks):
    """The first shingles of a set, frequent ones (sorted, with their ranks) last."""
    n = len(hashes)
    size = n - math.ceil(least * n - 1e-9) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, ranks[at], 0)
        hashes = hashes[np.argsort(rank, kind="stable")]
    return hashes[:size]


def similarity(a, b):
    """Exact Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _frequent(plain, shingle, seed):
    """Frequent shingles of a sample, sorted, and the number of sampled documents with each."""
    share = min(1.0, SAMPLE / max(1, plain.count()))
    drawn = plain.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def of_batches(batches):
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                own = pa.array(shingles(text, shingle, seed).view(np.int64))
                yield pa.RecordBatch.from_arrays([own], names=["h"])

    counted = drawn.select("text").distinct().mapInArrow(of_batches, "h long").groupBy("h").agg(F.count("*").alias("n"))
    rows = counted.where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["n"].to_numpy()[order]


def fingerprint(hashes):
    """64 bits, each set if it is in over half the hashes, as a signed long."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def parity(hashes):
    """The parity bitmap of a set, as signed longs."""
    bits = 64 * len(PARITY)
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def wide_parity(hashes):
    """The parity bitmap of a large set in at least a bit a shingle (a power of two), as bytes; None of other sets."""
    bits = 64 * len(PARITY)
    if 2 * len(hashes) <= bits:
        return None
    bits = max(bits, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def differing(a, b):
    """Bits in which two wide bitmaps differ; the longer one is folded to the length of the other."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(a), len(b))
    fold = lambda x: np.bitwise_xor.reduce(x.reshape(-1, n), axis=0)
    return int(np.bitwise_count(fold(a) ^ fold(b)).sum())


def minhashes(hashes):
    """The MinHash values of a set, as signed longs."""
    return np.array([(hashes * np.uint64(k)).min() for k in MINHASHES], np.uint64).view(np.int64)


SET_SCHEMA = "doc_id long, mark long, node long, size int, prefix array<long>, fp long, wide binary, least array<long>, " + ", ".join(
    f"{p} long" for p in PARITY
)


def _set_rows(batches, shingle, seed, least, frequent, ranks):
    for batch in slices(batches):
        nodes, sizes, prefixes, fps, wides, leasts, bitmaps = [], [], [], [], [], [], []
        for text in batch["text"].to_pylist():
            own = shingles(text, shingle, seed)
            nodes.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True))
            sizes.append(len(own))
            prefixes.append(prefix(own, least, frequent, ranks).view(np.int64))
            fps.append(fingerprint(own))
            wides.append(wide_parity(own))
            leasts.append(minhashes(own))
            bitmaps.append(parity(own))
        columns = [batch["doc_id"], batch["mark"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32())]
        columns += [pa.array(prefixes, pa.list_(pa.int64())), pa.array(fps, pa.int64()), pa.array(wides, pa.binary())]
        columns.append(pa.array(leasts, pa.list_(pa.int64())))
        bitmaps = np.array(bitmaps, np.int64).reshape(-1, len(PARITY))
        columns += [pa.array(np.ascontiguousarray(bitmaps[:, k])) for k in range(len(PARITY))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "size", "prefix", "fp", "wide", "least", *PARITY])


def _rows_to_compare(close, texts):
    """``a, share, b, text``: of each pair of ``close(x, y)`` the text of b, and ahead of them (b null) that of a.

    Of two nodes the one with more pairs is a. Its pairs are dealt out to shares of about ``TOGETHER``, and its
    text goes along once for each, so neither a row nor a task grows with the pairs of one node.
    """
    degrees = close.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    both = close.join(degrees.toDF("x", "x_n"), "x").join(degrees.toDF("y", "y_n"), "y")
    swapped = F.col("y_n") > F.col("x_n")
    pairs = both.select(
        F.when(swapped, F.col("y")).otherwise(F.col("x")).alias("a"),
        F.when(swapped, F.col("x")).otherwise(F.col("y")).alias("b"),
        F.ceil(F.greatest("x_n", "y_n") / TOGETHER).alias("shares"),
    )
    pairs = write_through(
        pairs.select("a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"), "b"), "compared"
    )
    heads = pairs.select("a", "share").distinct().select(F.col("a").alias("node"), "a", "share", F.lit(None).cast("long").alias("b"))
    wanted = heads.unionByName(pairs.select(F.col("b").alias("node"), "a", "share", "b"))
    rows = wanted.join(texts, "node").select("a", "share", "b", "text")
    return rows.repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))


def _compared(batches, shingle, seed, least):
    """The similar pairs of such rows; a share's rows may come in several batches."""
    ahead = own = None
    for batch in slices(batches):
        a, b = [], []
        for x, share, y, text in zip(*(batch[c].to_pylist() for c in ("a", "share", "b", "text"))):
            hashes = shingles(text, shingle, seed)
            if y is None:
                ahead, own = (x, share), hashes
            elif ahead != (x, share):
                raise ValueError("the text to compare with is not ahead of the others")
            elif similarity(own, hashes) >= least:
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _mixed(buckets, links):
    """Buckets whose members are in more than one component, under their new roots."""
    found = roots(links).toDF("_node", "_root")
    rows = buckets.join(found, F.col("node") == F.col("_node"), "left").select(
        "node", "size", "at", "key", F.coalesce("_root", "root").alias("root")
    )
    rows = write_through(rows, "members")
    mixed = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    return write_through(rows.join(mixed.select("key"), "key"), "buckets")


def _centers(buckets, turn):
    """The member that a bucket's others are compared with; most buckets of a group have the same."""
    order = F.struct(F.xxhash64("node", F.lit(turn)), *buckets.columns)
    first = buckets.groupBy("key").agg(F.min(order).alias("c"))
    return first.select("key", *(F.col(f"c.{c}").alias(f"_{c}") for c in ("node", "size", "at", "root")))


def _others(buckets):
    """Of each bucket the members outside its largest component: every pair of components has one."""
    sizes = buckets.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("_most"))
    names = [F.col(c).alias(f"_{c}") for c in ("node", "size", "at", "root", *FOLDED)]
    return write_through(buckets.join(largest, "key").where("root <> _most").select("key", *names), "others")


def _folded(buckets, sets):
    """Members of buckets with the folded bitmap of their sets."""
    step = len(FOLDED)
    folds = [F.expr(" ^ ".join(PARITY[k::step])).alias(q) for k, q in enumerate(FOLDED)]
    return write_through(buckets.join(sets.select("node", *folds), "node"), "folded")


def _alike(sets):
    """Pairs ``x, y`` of nodes to try first: fingerprints within two bits, one node of each fingerprint; equal MinHash values."""
    first = write_through(sets.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = sets.select("fp", "node").join(first, "fp").where("node <> first").selectExpr("first as x", "node as y")
    linked = simhash.links(first).toDF("a", "b")
    near = linked.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    values = sets.select("node", F.posexplode("least").alias("turn", "value"))
    firsts = values.groupBy("turn", "value").agg(F.min("node").alias("x"), F.count("*").alias("n")).where("n > 1")
    equal = values.join(firsts.drop("n"), ["turn", "value"]).where("node <> x").selectExpr("x", "node as y")
    return same.unionByName(near).unionByName(equal).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _bound(least, a, b):
    """The shingles in which two similar sets of these sizes differ at most."""
    return (1 - least) / (1 + least) * (F.col(a) + F.col(b)) + 1e-6


def _close(pairs, sets, least):
    """The pairs whose sizes and parity bitmaps leave the similarity possible."""
    side = lambda name, p: sets.select(
        F.col("node").alias(name), F.col("size").alias(f"{p}_size"), *[F.col(c).alias(f"{p}_{c}") for c in PARITY]
    )
    both = pairs.join(side("y", "b"), "y").join(side("x", "a"), "x")
    possible = F.expr(" + ".join(f"bit_count(a_{c} ^ b_{c})" for c in PARITY)) <= _bound(least, "a_size", "b_size")
    sizes = F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size") - 1e-6
    fits = both.where(sizes & possible).select("x", "y", _bound(least, "a_size", "b_size").alias("most"))
    fits = write_through(fits, "fits")
    # the wide bitmaps of other sets are not shuffled
    asked = key_filter(fits.select(F.explode(F.array("x", "y")).alias("node")), "xxhash64(node)")
    wide = members(sets.where("wide is not null").select("node", "wide"), asked, "xxhash64(node)")
    both = fits.join(wide.toDF("x", "a"), "x", "left").join(wide.toDF("y", "b"), "y", "left")
    return both.select("x", "y", "most", "a", "b").mapInArrow(_fitting, "x long, y long")


def _fitting(batches):
    """The pairs of ``x, y, most, a, b`` whose wide bitmaps a, b, if both have one, differ in ``most`` bits at most."""
    for batch in slices(batches):
        rows = zip(*(batch[c].to_pylist() for c in ("most", "a", "b")))
        fine = [a is None or b is None or differing(a, b) <= most for most, a, b in rows]
        yield batch.select(["x", "y"]).filter(pa.array(fine, pa.bool_()))


def links(sets, texts_of, shingle=SHINGLE, seed=SEED, least=SIMILARITY):
    """Links ``a, b`` that join up all pairs of ``sets(node, size, prefix, fp, ...)`` as similar as ``least``.

    ``texts_of`` gives ``node, text`` for the nodes it is told.
    """
    rows = sets.select("node", "size", F.posexplode("prefix").alias("at", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = write_through(shared, "shared")
    # most shingles are in one prefix only; their rows are not shuffled again
    held = members(rows, key_filter(shared, "xxhash64(key)"), "xxhash64(key)")
    buckets = write_through(held.join(shared, "key").withColumn("root", F.col("node")), "buckets")
    if buckets.isEmpty():
        return None
    # at the first common shingle nothing before it is shared
    possible = 1 + F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) - 1
    needed = least / (1 + least) * (F.col("size") + F.col("_size")) - 1e-6
    apart = F.expr(" + ".join(f"bit_count({q} ^ _{q})" for q in FOLDED)) <= _bound(least, "size", "_size")
    found = done = None
    for turn in range(-1, STARS + 1):
        if turn < 0:
            pairs = _alike(sets)
        else:
            fits = (F.col("root") != F.col("_root")) & (possible >= needed)
            if turn == STARS:
                buckets, fits = _folded(buckets, sets), fits & apart
            against = _centers(buckets, turn) if turn < STARS else _others(buckets)
            pairs = buckets.join(against, "key").where(fits)
            pairs = pairs.select(F.least("_node", "node").alias("x"), F.greatest("_node", "node").alias("y")).distinct()
            # what has been compared is not compared again
            pairs = pairs.join(done, ["x", "y"], "left_anti")
        pairs = write_through(pairs, "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        close = write_through(_close(pairs, sets, least), "close")
        texts = write_through(texts_of(close.select(F.explode(F.array("x", "y")).alias("node")).distinct()), "texts")
        near = _rows_to_compare(close, texts).mapInArrow(
            lambda rows: _compared(rows, shingle, seed, least), "a long, b long"
        )
        with text_batches(near.sparkSession, COMPARED):
            near = write_through(near, "near")
        found = near if found is None else found.unionByName(near)
        if turn < STARS:
            buckets = _mixed(buckets, found)
            if buckets.isEmpty():
                break
    return found


def keep_first(docs, shingle=SHINGLE, seed=SEED, least=SIMILARITY):
    """The rows of ``docs``, all columns, that come first (smallest ``doc_id``) in their component.

    Null and empty texts have equal sets. Ids are taken to be unique: of rows with equal id and text
    one stays; rows without id go.
    """
    with text_batches(docs.sparkSession):
        first = _first(documents(docs), shingle, seed, least)
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col("_first"), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def _first(plain, shingle, seed, least):
    """The smallest id of each component, as ``_first``, written."""
    frequent, ranks = _frequent(plain, shingle, seed)
    plain = plain.withColumn("mark", F.xxhash64("text"))
    marked = write_through(
        plain.mapInArrow(lambda rows: _set_rows(rows, shingle, seed, least, frequent, ranks), SET_SCHEMA), "sets"
    )
    nodes = marked.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("c"))
    nodes = write_through(nodes.select("node", F.col("c.doc_id").alias("doc_id"), F.col("c.mark").alias("mark")), "nodes")
    sets = marked.join(nodes, ["node", "doc_id", "mark"], "left_semi").dropDuplicates(["node"])
    sets = write_through(sets, "nodes")

    def texts_of(wanted):
        own = write_through(nodes.join(wanted, "node", "left_semi"), "wanted")
        # other texts are not shuffled
        held = members(plain, key_filter(own, "xxhash64(doc_id)"), "xxhash64(doc_id)")
        return held.join(own, ["doc_id", "mark"]).select("node", "text").dropDuplicates(["node"])

    near = links(sets, texts_of, shingle, seed, least)
    first = nodes.select("node", "doc_id")
    if near is not None:
        rooted = nodes.join(roots(near).toDF("_node", "root"), F.col("node") == F.col("_node"), "left")
        first = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("doc_id").alias("doc_id"))
    return write_through(first.select(F.col("doc_id").alias("_first")).distinct(), "first", lasts=True)
