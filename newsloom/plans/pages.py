"""A report stored in its order, so that any page is read from one or two of its files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.plans.report import in_order
from newsloom.schemas import PAGE_ROWS, SNAPSHOT, SORT_COLUMN
from newsloom.versions import Versions

# The place of a row within its range fills the lower bits of Spark's row number.
_PLACES = 33
_STORED = T.StructType([*SNAPSHOT.fields, T.StructField("_place", T.LongType())])


class PagedReport:
    """A report under one path. ``store`` replaces it; readers of the earlier one are not disturbed."""

    def __init__(self, spark, path):
        self.spark, self._versions = spark, Versions(spark, path)

    def store(self, report, files=None):
        """Store a report that still has its ``seq``, in ``files`` ranges of its order."""
        order = [F.desc_nulls_last(SORT_COLUMN), F.asc("seq")]
        ranges = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = report.select(*[f"`{c}`" for c in SNAPSHOT.names])
        numbered = (
            rows.repartitionByRange(ranges, *order)
            .sortWithinPartitions(*order)
            .withColumn("_row", F.monotonically_increasing_id())
            .select(
                *[f"`{c}`" for c in SNAPSHOT.names],
                F.col("_row").bitwiseAND((1 << _PLACES) - 1).alias("_place"),
                F.shiftright("_row", _PLACES).alias("range"),
            )
        )
        part = self._versions.write(numbered, "report", "range")
        schema = T.StructType([*_STORED.fields, T.StructField("range", T.IntegerType())])
        # one row per range
        counts = self._versions.read([part], schema).groupBy("range").count().orderBy("range").collect()
        before, directory = 0, []
        for r in counts:
            directory.append({"range": r["range"], "before": before, "rows": r["count"]})
            before += r["count"]
        self._versions.change(lambda state: {"part": part, "directory": directory})

    def rows(self):
        """How many rows the report has; nothing is read but the directory."""
        return sum(r["rows"] for r in self._versions.current()[1].get("directory", []))

    def page(self, number, rows=PAGE_ROWS):
        """Page ``number`` (from 0), in order: the same rows as ``plans.report.page``."""
        _, state = self._versions.current()
        low, high = number * rows, (number + 1) * rows
        found = None
        for r in state.get("directory", []):
            start, stop = max(low, r["before"]), min(high, r["before"] + r["rows"])
            if start < stop:
                place = F.col("_place")
                file = self._versions.read([f"{state['part']}/range={r['range']}"], _STORED)
                kept = file.where((place >= start - r["before"]) & (place < stop - r["before"]))
                found = kept if found is None else found.union(kept)
        if found is None:
            found = self._versions.read([], _STORED)
        return in_order(found.drop("_place"))
