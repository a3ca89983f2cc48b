"""SimHash near-duplicates by covering locality-sensitive hashing (operator 4).

Fingerprints that differ in at most ``RADIUS`` = 2 bits are linked. Each bit is given one of
the 7 nonzero vectors of 3 bits, and table v keeps the bits whose vector has an odd product
with v. For any two positions there is a v that is even on both, so two fingerprints within
the radius agree on all that some table keeps: no pair is missed. A bucket with many distinct
fingerprints is covered anew on the bits its table dropped; after the last level at most
``2 ** 6`` distinct fingerprints can share a bucket, so no bucket grows with the corpus.
Documents with equal fingerprints meet once, as one node.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from newsloom.llm.components import roots
from newsloom.llm.tables import documents
from newsloom.operators.skew import attach
from newsloom.workspace import write_through

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Distinct fingerprints compared at once.
BUCKET = 64


def words(text):
    """Lower-cased (A-Z) bytes of the words, joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def fingerprint(text, shingle=SHINGLE, seed=SEED):
    """The 64-bit fingerprint; 0 for a text without words."""
    joined = words(text)
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    n = max(1, len(starts) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)  # little endian
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > n))


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs, shingle=SHINGLE, seed=SEED):
    """``doc_id, fp``: the fingerprint as a signed long."""

    def of_batches(batches):
        for batch in batches:
            found = [fingerprint(t, shingle, seed) for t in batch["text"].to_pylist()]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], fps], names=["doc_id", "fp"])

    return documents(docs).mapInArrow(of_batches, "doc_id long, fp long")


def covering(bits):
    """Seven lists of bits; for any two of ``bits`` one list has neither."""
    vector = {b: 1 + k % 7 for k, b in enumerate(bits)}
    return [[b for b in bits if (vector[b] & v).bit_count() % 2] for v in range(1, 8)]


def _tables():
    """Levels of masks: each level has seven for each mask of the one before, the dropped bits covered."""
    level, levels = [[]], []
    while True:
        level = [
            kept + more
            for kept in level
            for more in covering([b for b in range(64) if b not in kept])
        ]
        levels.append([sum(1 << b for b in kept) for kept in level])
        if max(64 - len(kept) for kept in level) <= BUCKET.bit_length() - 1:
            return levels


def _signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct):
    """Links ``a, b`` that join up all of the ``fp`` column's values within the radius.

    Within a bucket a spanning forest of its links stands for all of them.
    """
    rows = distinct.select("fp", F.lit(0).alias("above"))
    found = None
    for masks in _tables():
        mask = F.array(*[F.lit(_signed(m)) for m in masks])
        rows = rows.select(
            "fp", F.explode(F.sequence(F.col("above") * 7, F.col("above") * 7 + 6)).alias("at")
        ).withColumn("key", F.col("fp").bitwiseAND(mask[F.col("at")]))
        rows = write_through(rows, "tables")
        sizes = rows.groupBy("at", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = rows.join(sizes, ["at", "key"])
        buckets = (
            shared.where(F.col("n") <= BUCKET)
            .groupBy("at", "key")
            .agg(F.collect_list("fp").alias("fps"))
            .select("fps")
        )
        here = buckets.mapInArrow(_forests, "a long, b long")
        found = here if found is None else found.unionByName(here)
        rows = write_through(
            shared.where(F.col("n") > BUCKET).select("fp", F.col("at").alias("above")), "buckets"
        )
        if rows.isEmpty():
            break
    return found


def _forests(batches):
    for batch in batches:
        a, b = [], []
        for fps in batch["fps"].to_pylist():
            own = np.array(fps, np.int64)
            near = np.bitwise_count(own.view(np.uint64)[:, None] ^ own.view(np.uint64)) <= RADIUS
            open_ = list(range(1, len(own)))
            group = [0]
            while group or open_:
                at = group.pop() if group else open_.pop()
                for k in [k for k in open_ if near[at, k]]:
                    a.append(fps[at])
                    b.append(fps[k])
                    open_.remove(k)
                    group.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs, shingle=SHINGLE, seed=SEED):
    """``doc_id, fingerprint, component_id`` for every document.

    A null or empty text has fingerprint 0 and is linked like any other; equal rows give equal
    rows; an empty table gives no rows.
    """
    marked = write_through(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = write_through(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes"
    )
    rooted = nodes.join(roots(links(nodes)), F.col("fp") == F.col("node"), "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select(
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n", "component_id"
    )
    rows = marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return attach(rows, named, "fingerprint", "n", total, F.col("doc_id")).select(
        "doc_id", "fingerprint", "component_id"
    )


def keep_first(docs, shingle=SHINGLE, seed=SEED):
    """The rows of ``docs``, all columns, that come first (smallest ``doc_id``) in their component.

    Ids are taken to be unique: of rows with equal id and text one stays; rows without id go.
    """
    near = near_duplicates(docs, shingle, seed)
    first = near.where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col("_first"), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
