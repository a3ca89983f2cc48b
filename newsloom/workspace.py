"""Intermediate tables in the shared folder the session names.

Reused or iterated results are written as Parquet rather than kept in executor memory:
a lost executor then costs a re-read instead of the whole lineage, later steps read only
the columns they need, and a row count comes from the file footers.
"""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

_local_roots = {}
_passing = ContextVar("passing", default=None)


def shared_folder(spark):
    """The session's checkpoint folder, however it was set; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="newsloom-")
    return _local_roots[context.applicationId]


def new_path(spark, label):
    """A path under the shared folder that nothing else uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/newsloom/{app}/{label}-{uuid.uuid4().hex}"


@contextmanager
def passing_tables(spark):
    """Tables written within are deleted at its end, but those that last; nothing read later may need them."""
    paths = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_through(df, label, lasts=False):
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    paths = _passing.get()
    if paths is not None and not lasts:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
