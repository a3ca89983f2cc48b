"""Reading only the columns an operator needs, under names of its own."""

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.shipping import ship


def documents(docs):
    """``doc_id`` and ``text`` alone; a null text is an empty one, a row without id is left out."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("doc_id is not null")


def table(spark, sf_dir, name):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back():
    """Returns a worker's freed memory to its machine: the worker goes on with the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def slices(batches, rows=1000):
    """Arrow batches in pieces of ``rows`` rows, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


@contextmanager
def text_batches(spark, rows=1000):
    """Within it, Spark sends ``rows`` rows at a time to Python: both sides hold fewer long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
