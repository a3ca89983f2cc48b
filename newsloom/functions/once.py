"""Evaluate expensive columns a single time."""

from pyspark.sql import functions as F


def computed_once(df, **columns):
    """Add ``columns`` in a step of their own.

    Catalyst moves a filter below the projection that defines its columns by repeating their
    expressions. A filter on the output of a generator stays above it and reads the result.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(made)))
