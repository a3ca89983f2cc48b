"""Publisher addresses of the links."""

from pyspark.sql import functions as F

from newsloom.operators.membership import key_filter, members
from newsloom.schemas import STATUS_REDIRECT, STATUS_RESOLVED
from newsloom.workspace import write_through


def addresses(resolution, links):
    """The resolved address of each link: ``link, _known``.

    A filter of the ``links`` at hand is applied where the resolutions are read, so those of other links
    are neither shuffled nor aggregated. A link that was tried more than once counts once.
    """
    known = write_through(key_filter(links, "xxhash64(link)"), "links")
    resolved = F.coalesce("status", F.lit(False)) & F.col("decoded_url").isNotNull()
    wanted = members(resolution.where(resolved).select("link", "decoded_url"), known, "xxhash64(link)")
    return wanted.groupBy("link").agg(F.min("decoded_url").alias("_known"))


def resolve_urls(articles, resolution=None):
    """Add ``url`` and ``status``: the resolved address, or the link itself.

    The articles are written once, for their links are needed before the addresses are read. Without
    ``resolution`` the step is skipped and every link stays as it is.
    """
    if resolution is None:
        return articles.withColumns({"url": F.col("link"), "status": F.lit(STATUS_REDIRECT)})
    articles = write_through(articles, "merged")
    known = addresses(resolution, articles.select("link"))
    return (
        # the addresses grow with the articles, and are not to be broadcast
        articles.join(known.hint("merge"), "link", "left")
        .withColumn("url", F.coalesce("_known", "link"))
        .withColumn(
            "status",
            F.when(F.col("_known").isNotNull(), F.lit(STATUS_RESOLVED)).otherwise(F.lit(STATUS_REDIRECT)),
        )
        .drop("_known")
    )
