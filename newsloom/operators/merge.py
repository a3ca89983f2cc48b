"""One article per link."""

from pyspark.sql import functions as F

_FIRST = ["seq", "title", "source", "published", "published_local", "published_at"]


def merge_by_link(hits):
    """Merge tagged entries by link: first-seen fields and the sets of both tags.

    ``hits`` has either the arrays ``regions`` and ``industries`` or one pair of ``wilayah``
    and ``usaha`` per row. One aggregation with map-side combining: a link that holds many
    rows shrinks to one row per task before the shuffle, and a set never outgrows the terms.
    """
    one = F.min(F.struct(*_FIRST)).alias("_first")
    if "regions" in hits.columns:
        union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
        merged = hits.groupBy("link").agg(one, union("regions"), union("industries"))
    else:
        merged = hits.groupBy("link").agg(
            one,
            F.sort_array(F.collect_set("wilayah")).alias("regions"),
            F.sort_array(F.collect_set("usaha")).alias("industries"),
        )
    return merged.select("link", "_first.*", "regions", "industries")
