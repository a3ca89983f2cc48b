"""Exact duplicates by progressive refinement (operator 12): length, hash of the start, full hash.

Documents are told apart by their length in bytes first, then by a hash of their first characters.
Only documents that share both with another one have their whole content hashed and grouped. Texts
never move: the pairs of length and start that are shared make a filter of bounded size, and the
second scan of the texts tests it in place. All steps are built-in functions.

Texts are equal when they are identical after lower-casing A-Z alone. A null text is an empty one.
Rows that repeat an id are documents of their own; of rows that repeat id and text one is kept. A
missing id counts as smaller than any other. An empty table gives no rows; further columns are ignored.
"""

import string

from pyspark.sql import functions as F

from newsloom.operators.membership import key_filter, mark_members
from newsloom.operators.skew import attach
from newsloom.workspace import write_through

#: Characters whose hash is the second key.
START_CHARS = 64

_SHARED = "xxhash64(size, start)"


def lower_ascii(text):
    """``text`` with A-Z, and no other letter, in lower case."""
    # the quick path is right for texts of ASCII characters only
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _measured(docs):
    """The two cheap keys of each document, beside its id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).alias("size"),
        F.xxhash64(lower_ascii(F.substring(text, 1, START_CHARS))).alias("start"),
    )


def shared_starts(docs):
    """Pairs of length and hash of the start that more than one document has: ``size, start``."""
    keys = write_through(_measured(docs).select("size", "start"), "lengths")
    several = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    sizes = write_through(several(keys, "size"), "shared-lengths")
    return write_through(several(keys.join(sizes, "size", "left_semi"), "size", "start"), "shared-starts")


def find(docs, digest=False):
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays; ``keep_id`` is its id and ``group_size``
    the number of equal texts. ``text_sha256`` is the full hash, in hexadecimal digits, of the text in
    lower case; null where the text was alone by its length or start and so never hashed, unless
    ``digest`` asks for all of them.
    """
    known = key_filter(shared_starts(docs), _SHARED)
    marked = mark_members(_measured(docs), known, _SHARED, "read")
    full = F.sha2(lower_ascii(F.col("text")), 256)
    rows = write_through(
        marked.select("doc_id", "read", (full if digest else F.when(F.col("read"), full)).alias("text_sha256")),
        "full-hashes",
    )
    # repeated rows are one here, with their number
    ids = write_through(
        rows.where("read").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n")), "hashed-ids"
    )
    groups = ids.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    shared = attach(
        ids, groups.where("group_size > 1"), "text_sha256", "group_size", rows.count(), "doc_id"
    ).select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    grouped = shared.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (
            F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
        ).alias("kept"),
        "text_sha256",
    )
    alone = rows.where("not read").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return grouped.unionByName(alone)


SQL = f"""
WITH hashed AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
    FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)"""
