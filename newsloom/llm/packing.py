"""Best-fit packing of documents into sequences of a fixed capacity (operator 6).

Of documents above a third of the capacity at most two fit a sequence, so they are matched in
pairs: the largest one with the largest that still fits. Smaller documents then go, largest
first, to the tightest remaining gap. How good a place is depends on lengths alone, so the plan
is made from the number of pieces of each length (at most ``capacity`` counts, whatever the
corpus), in whole groups of equal sequences, and each piece finds its place by its rank among
the pieces of its length.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.llm.tables import documents, slices
from newsloom.llm.tokens import encoder
from newsloom.workspace import write_through

CAPACITY = 2048
END_ID = 0
#: Pieces of a length ranked in one task at most; its pieces are dealt to all tasks anyway.
RANKED = 200_000


def pieces(docs, vocabulary, capacity=CAPACITY, end_id=END_ID, with_ids=False):
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document's ids are those of its text and ``end_id``; only longer ones than ``capacity``
    are cut. A null or empty text has the end id alone. ``ids`` are little-endian unsigned
    32-bit integers.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches):
        ids_of = encoder(vocabulary, spaces_matter=False)
        for batch in slices(batches):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), ids_of.encode_all(batch["text"].to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(part)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
            keep = len(columns) if with_ids else len(columns) - 1
            yield pa.RecordBatch.from_arrays(columns[:keep], names=list(out)[:keep])
        ids_of.forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return documents(docs).mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def plan(counts, capacity=CAPACITY):
    """Places for ``counts[length]`` pieces of each length.

    Returns rows ``(length, rank, n, sequence, offset)``: the pieces of that length with ranks
    from ``rank`` to ``rank + n - 1`` go to the sequences from ``sequence`` on, one each.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    used = [0] * (capacity + 1)
    gaps = [[] for _ in range(capacity + 1)]  # by free room: groups (first sequence, how many)
    rows, opened = [], 0

    def place(length, n, sequence, offset):
        rows.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            partner = min(capacity - length, length)
            while partner > third and left[partner] < 1 + (partner == length):
                partner -= 1
            if partner <= third:
                n = left[length]
                place(length, n, opened, 0)
                gaps[capacity - length].append((opened, n))
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                place(length, n, opened, 0)
                place(partner, n, opened, length)
                gaps[capacity - length - partner].append((opened, n))
            opened += n
    for length in range(third, 0, -1):
        while left[length]:
            room = length
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:
                n = -(-left[length] // (capacity // length))
                gaps[capacity].append((opened, n))
                opened += n
                continue
            first, many = gaps[room].pop()
            n = min(many, left[length])
            place(length, n, first, capacity - room)
            if many > n:
                gaps[room].append((first + n, many - n))
            gaps[room - length].append((first, n))
    return rows


def _ranked(found):
    """Adds ``_rank``, from 0 among the pieces of a length, without a task for a whole length."""
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(tasks, found.count() // RANKED)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    return (
        salted.withColumn("_k", F.row_number().over(within) - 1)
        .join(sizes, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_k"))
        .drop("_k", "_before", "_salt")
    )


def pack(docs, vocabulary, capacity=CAPACITY, end_id=END_ID, with_ids=False):
    """Every piece with its place: ``sequence_id`` and ``offset``, gapless from 0.

    Equal ``doc_id`` rows are packed each; their ranks then follow no fixed order. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    found = write_through(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity`
    places = spark.createDataFrame(
        plan(counts, capacity),
        "_length long, _from long, _n long, _sequence long, `offset` long",
    )
    fits = (
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_from"))
        & (F.col("_rank") < F.col("_from") + F.col("_n"))
    )
    placed = _ranked(found).join(F.broadcast(places), fits)
    return placed.select(
        *found.columns,
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        "offset",
    )
