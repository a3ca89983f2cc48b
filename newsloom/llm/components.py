"""Connected components of links, as joins and aggregations alone."""

from pyspark.sql import functions as F

from newsloom.workspace import write_through


def roots(links):
    """``node, root`` for every node of ``links(a, b)`` (long); nodes of a component share a root.

    Each round every node is renamed to the neighbour (or itself) that comes first in an order
    drawn anew for the round, and links are renamed with it. Every link between a node and its
    new name stays a link, so components are kept, and all but the nodes chosen by some
    neighbour vanish: the number of rounds grows with the logarithm of the nodes. Each round is
    a table in the shared folder, so a lost executor costs a re-read.
    """
    spark = links.sparkSession
    left = write_through(links.where("a <> b").distinct(), "links")
    named = None
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("v"))  # noqa: E731, B023
        names = both.groupBy(F.col("a").alias("v")).agg(F.min(order("b")).alias("first"))
        names = write_through(
            names.select("v", F.least("first", order("v"))["v"].alias("to")), "names"
        )
        renamed = (
            left.join(names.toDF("a", "a_to"), "a")
            .join(names.toDF("b", "b_to"), "b")
            .select(
                F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")
            )
        )
        left = write_through(renamed.where("a <> b").distinct(), "links")
        if named is None:
            named = names.toDF("node", "root")
        else:
            known = named.join(names.toDF("root", "to"), "root", "left")
            named = write_through(
                known.select("node", F.coalesce("to", "root").alias("root")), "roots"
            )
        turn += 1
    return spark.createDataFrame([], "node long, root long") if named is None else named
