"""A corpus from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but
the last return the columns of ``documents``; each result is written as Parquet and reread.

Ids are taken to be unique; further columns pass through. Null and empty texts are scored as texts
without matches, are near-duplicates of each other (one stays), hold no repeats or leaks, and are
packed as their end id. Of rows with equal id and text one stays; rows without id leave with the
near-duplicates. An empty table gives an empty result.
"""

import public_tokenizers
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, nearcopies, packing, repeats, toxicity
from newsloom.llm.tables import table
from newsloom.workspace import passing_tables, write_through

#: Documents that score so high are rejected.
TOXIC = 0.7


def toxic_documents(spark, docs, sf_dir):
    """Rejects documents scored as toxic; learns from labelled rows whose crc32 mod 3 is not 1."""
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model, _ = toxicity.train(docs, table(spark, sf_dir, "labels"), seen)
    return toxicity.keep(docs, model, TOXIC)


def near_copies(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group of near-duplicates (five words, 0.8)."""
    # what is returned reads the smallest ids alone; the other tables would take disk from later stages
    with passing_tables(spark):
        return nearcopies.keep_first(docs)


def repeated_passages(spark, docs, sf_dir):
    """Cuts strings of 200 bytes and more that occur anywhere else."""
    return repeats.clean(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Rejects documents that hold a benchmark item or a close edit of one."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """Pieces of token ids with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]

# Learned scores, fingerprints, suffixes, edit distances and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), name)
    return docs
