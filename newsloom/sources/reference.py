"""Reference lists: a wide, ragged CSV with group names as header and members below."""

from functools import reduce

from pyspark.sql import functions as F


def read_wide(spark, path):
    """The list as it is, every cell a string. Only the header is read to get the schema."""
    return spark.read.csv(path, header=True)


def group_names(wide):
    """Names of the groups; one without members counts as well."""
    return wide.columns


def members(wide, groups=None):
    """``grp, member`` rows of the given groups; only their columns are read."""
    groups = wide.columns if groups is None else groups
    return wide.unpivot([], [F.col(f"`{g}`") for g in groups], "grp", "member").dropna()


def select_terms(wide, chosen):
    """Members of the chosen groups, with repeats; a name that is no group stands for itself."""
    groups = [c for c in chosen if c in wide.columns]
    names = [(c,) for c in chosen if c not in wide.columns]
    spark = wide.sparkSession
    parts = [spark.createDataFrame(names, "term string")] if names else []
    if groups:
        parts.append(members(wide, groups).select(F.col("member").alias("term")))
    if not parts:
        return spark.createDataFrame([], "term string")
    return reduce(lambda a, b: a.unionAll(b), parts)
