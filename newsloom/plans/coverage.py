"""Similar coverage kept up to date as feed batches come in.

The state has every word set with its leader, and the leaders once more with the features that a
comparison needs. New word sets meet the leaders, and only those that meet none are compared with each
other; known ones just count. The result is that of clustering all batches at once.
"""

from pyspark.sql import functions as F

from newsloom.operators.similarity import (
    covered_by_titles,
    follow_in_order,
    keyed_titles,
    title_nodes,
    with_features,
    with_sizes,
)
from newsloom.schemas import SIMILARITY_THRESHOLD
from newsloom.versions import Versions, merge_small
from newsloom.workspace import write_through

_SETS = "key string, node long, leader long"
_COUNTS = "key string, n long"
#: Parts of the state that are merged, of each size class.
FAN_IN = 8


class CoverageState:
    """Clusters of all titles seen so far, under one path.

    A batch is named and counts once. Batches usually come in the order of their ``seq``; where one holds
    a title that belongs before known ones, the word sets from its place on are clustered again, and
    those before it keep their leaders.
    """

    def __init__(self, spark, path, threshold=SIMILARITY_THRESHOLD):
        self.spark, self._versions, self._threshold = spark, Versions(spark, path), threshold

    def _read(self, state, kind, schema):
        return self._versions.read([p["name"] for p in state.get(kind, [])], schema)

    def _part(self, df, kind):
        name = self._versions.write(df, kind)
        return {"name": name, "rows": self.spark.read.parquet(f"{self._versions.path}/{name}").count()}

    def _grown(self, state, kind, df):
        """The parts of a kind with one more; those of a size class are merged when there are many."""
        schema = df.schema

        def merged(several):
            rows = self._versions.read([p["name"] for p in several], schema)
            if kind == "counts":
                rows = rows.groupBy("key").agg(F.sum("n").alias("n"))
            return self._part(rows, kind)

        return merge_small([*state.get(kind, []), self._part(df, kind)], FAN_IN, merged)

    def add(self, rows, batch):
        """Take in the rows ``seq, title`` of a batch."""
        nodes = write_through(title_nodes(rows, self._threshold), "nodes")

        def changed(state):
            if batch in state.get("batches", []):
                return None
            sets = self._read(state, "sets", _SETS)
            known = sets.select("key", F.col("node").alias("_node"))
            met = write_through(nodes.join(known, "key", "left").select(*nodes.columns, "_node"), "met")
            # a set that is new, or begins earlier than it did, takes a new place in the order
            moved = met.where("_node is null or node < _node")
            first, last = moved.agg(F.min("node")).first()[0], sets.agg(F.max("node")).first()[0]
            state = {
                **state,
                "batches": [*state.get("batches", []), batch],
                "counts": self._grown(state, "counts", met.select("key", "n")),
            }
            if first is None:
                return state
            if last is not None and first < last:
                return self._again(state, moved, first, nodes.schema)
            fresh = write_through(moved.select(*nodes.columns), "fresh")
            leading = self._read(state, "leading", nodes.schema) if state.get("leading") else None
            placed = self._placed(fresh, leading)
            return {
                **state,
                "sets": self._grown(state, "sets", placed.select("key", "node", "leader")),
                "leading": self._grown(state, "leading", placed.where("node = leader").select(*nodes.columns)),
            }

        self._versions.change(changed)

    def _placed(self, nodes, leading):
        led = follow_in_order(nodes, leading, self._threshold)
        return write_through(nodes.join(led, "node"), "placed")

    def _again(self, state, moved, first, schema):
        """The state with all word sets from the place ``first`` on clustered again."""
        sets = self._read(state, "sets", _SETS)
        now = sets.join(moved.select("key", F.col("node").alias("_now")), "key", "full").select(
            "key", F.coalesce("_now", "node").alias("node"), F.when(F.col("_now").isNull(), F.col("leader")).alias("leader")
        )
        now = write_through(now, "now")
        later = with_features(now.where(F.col("node") >= first).select("key", "node", F.lit(1).cast("long").alias("n")), self._threshold)
        leading = self._read(state, "leading", schema).where(F.col("node") < first)
        placed = self._placed(write_through(later.select(*schema.names), "later"), write_through(leading, "leading"))
        before = now.where(F.col("node") < first).select("key", "node", "leader")
        leads = placed.where("node = leader").select(*schema.names)
        return {
            **state,
            "sets": [self._part(before.union(placed.select("key", "node", "leader")), "sets")],
            "leading": [self._part(leading.union(leads), "leading")],
        }

    def clusters(self):
        """``key, n, leader, size`` of every word set."""
        _, state = self._versions.current()
        counts = self._read(state, "counts", _COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
        return with_sizes(self._read(state, "sets", _SETS).join(counts, "key").select("key", "n", "leader"))

    def coverage(self, rows):
        """``rows`` with ``leader`` and ``similar``, as ``similar_coverage`` gives them over all batches."""
        return covered_by_titles(rows, write_through(keyed_titles(rows), "titles"), self.clusters())
