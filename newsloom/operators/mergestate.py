"""Articles merged by link over many batches, without reading the entries of earlier ones.

The state is the merged articles, in buckets by the hash of the link. A batch is merged by itself, then
with the buckets that it touches, which are written anew; all others keep their files and are not read.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.merge import merge_by_link
from newsloom.versions import Versions

BUCKETS = 256
_S, _NTZ = T.StringType(), T.TimestampNTZType()
MERGED = T.StructType([
    T.StructField("link", _S),
    T.StructField("seq", T.LongType()),
    T.StructField("title", _S),
    T.StructField("source", _S),
    T.StructField("published", _S),
    T.StructField("published_local", _NTZ),
    T.StructField("published_at", _NTZ),
    T.StructField("regions", T.ArrayType(_S)),
    T.StructField("industries", T.ArrayType(_S)),
])


class MergeState:
    """The merged articles of all batches under one path.

    The number of buckets is that of the first batch. A batch is named; added again under the same name
    it changes nothing. ``articles()`` equals ``merge_by_link`` over the entries of all batches.
    """

    def __init__(self, spark, path, buckets=BUCKETS):
        self._versions, self._buckets = Versions(spark, path), buckets

    def _read(self, state, buckets=None):
        held = state.get("buckets", {})
        chosen = held if buckets is None else {b: held[b] for b in map(str, buckets) if b in held}
        names = [f"{part}/bucket={b}" for b, part in sorted(chosen.items())]
        return self._versions.read(names, MERGED)

    def add(self, hits, batch):
        """Merge the entries of a batch, tagged as for ``merge_by_link``, into the state."""

        def changed(state):
            if batch in state.get("batches", []):
                return None
            of = state.get("of", self._buckets)
            bucket = F.pmod(F.xxhash64("link"), F.lit(of)).alias("bucket")
            alone = merge_by_link(hits).select(*MERGED.names, bucket).repartition(of, "bucket")
            part = self._versions.write(alone, "batch", "bucket")
            new = self._versions.read([part], T.StructType([*MERGED.fields, T.StructField("bucket", T.IntegerType())]))
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `of`
            earlier = self._read(state, touched)
            if state.get("buckets", {}).keys() & set(map(str, touched)):
                both = merge_by_link(earlier.unionByName(new.drop("bucket")))
                whole = both.select(*MERGED.names, bucket).repartition(len(touched), "bucket")
                part = self._versions.write(whole, "merged", "bucket")
            return {
                "of": of,
                "batches": [*state.get("batches", []), batch],
                "buckets": {**state.get("buckets", {}), **{str(b): part for b in touched}},
            }

        self._versions.change(changed)

    def articles(self):
        return self._read(self._versions.current()[1])
