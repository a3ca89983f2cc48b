"""Log of past runs and snapshots of their reports, kept as versions of immutable parts.

An append, a snapshot and a clear are new versions: readers of an earlier one finish undisturbed, and
an attempt that fails before its last step changes nothing. A run id is one run, however often it is logged.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.dates import duration_label, moment_label, period_label
from newsloom.functions.text import run_label
from newsloom.schemas import MAX_RUNS, RUN, SNAPSHOT
from newsloom.versions import Versions

#: Log parts that are merged into one.
MANY_PARTS = 32
_LOGGED = T.StructType([*RUN.fields, T.StructField("_version", T.LongType())])


def run_records(runs):
    """Log rows from ``run_id, run_at, regions, industries, start, end, rows, seconds``."""
    return runs.select(
        "run_id",
        "run_at",
        moment_label(F.col("run_at")).alias("waktu"),
        run_label(F.col("regions")).alias("wilayah"),
        run_label(F.col("industries")).alias("usaha"),
        period_label(F.col("start"), F.col("end")).alias("periode"),
        F.col("rows").cast("bigint").alias("jumlah"),
        duration_label(F.col("seconds")).alias("durasi"),
    )


class RunLog:
    """Runs kept under one path."""

    def __init__(self, spark, path):
        self.spark, self._versions = spark, Versions(spark, path)

    def append(self, records):
        """Log runs; of rows with the same ``run_id`` the one logged last counts, in any append or retry."""
        number, _ = self._versions.current()
        rows = records.select(*RUN.names, F.lit(number + 1).cast("long").alias("_version"))
        added = self._versions.write(rows, "log")

        def changed(state):
            parts = [*state.get("log", []), added]
            if len(parts) >= MANY_PARTS:
                parts = [self._versions.write(self._newest(parts), "log")]
            return {**state, "log": parts}

        self._versions.change(changed)

    def save_snapshot(self, run_id, report):
        """Keep the report of a run; it takes the place of an earlier one of that run only.

        ``report`` still has its ``seq``, so that the rows can be put in order again.
        """
        part = self._versions.write(report.select(*[f"`{c}`" for c in SNAPSHOT.names]), "snapshot")
        self._versions.change(
            lambda state: {**state, "snapshots": {**state.get("snapshots", {}), str(run_id): part}}
        )

    def _newest(self, parts):
        rows = self._versions.read(parts, _LOGGED)
        newest = rows.groupBy("run_id").agg(
            F.max(F.struct("_version", *[c for c in RUN.names if c != "run_id"])).alias("_row")
        )
        return newest.select("run_id", "_row.*").select(*_LOGGED.names)

    def all(self):
        _, state = self._versions.current()
        if not state.get("log"):
            return self.spark.createDataFrame([], RUN)
        return self._newest(state["log"]).select(*RUN.names)

    def recent(self, count=MAX_RUNS):
        """The newest runs, newest first."""
        return self.all().orderBy(F.desc("run_at"), F.desc("run_id")).limit(count)

    def load_snapshot(self, run_id):
        """The report of one run, with its ``seq``: only its part is read."""
        _, state = self._versions.current()
        part = state.get("snapshots", {}).get(str(run_id))
        return self._versions.read([part] if part else [], SNAPSHOT)

    def clear(self):
        """Forget every run. Tables that were read before stay readable."""
        self._versions.change(lambda state: {})

    def drop_unused(self, older_than):
        """Delete the parts of forgotten runs and failed attempts that are ``older_than`` seconds old."""
        _, state = self._versions.current()
        used = {*state.get("log", []), *state.get("snapshots", {}).values()}
        return self._versions.drop_unused(used, older_than)
