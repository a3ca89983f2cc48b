"""Landed feed entries."""

import uuid

from pyspark.sql import functions as F

from newsloom.functions.dates import parse_published
from newsloom.functions.text import text_or
from newsloom.schemas import ENTRY, LANDED, MISSING
from newsloom.versions import Versions, merge_small

#: Landed batches of similar size that are merged.
FAN_IN = 8


def read_feed(spark, path, source_format="json"):
    """Entries as landed, with the fixed schema: nothing is inferred, no pass is spent on it."""
    return spark.read.schema(ENTRY).format(source_format).load(path)


def normalize(raw):
    """Defaults for missing fields; entries without a link are dropped.

    A source that is an object, as feeds deliver it, counts by its title.
    """
    source = F.col("source")
    is_object = F.startswith(F.ltrim(source), F.lit("{"))
    titled = F.when(is_object, F.coalesce(F.get_json_object(source, "$.title"), F.lit(""))).otherwise(source)
    raw = raw.withColumn("source", titled)
    return raw.where(F.col("link") != "").select(
        "seq",
        text_or(F.col("title"), MISSING).alias("title"),
        F.coalesce("published", F.lit("")).alias("published"),
        "link",
        text_or(F.col("source"), MISSING).alias("source"),
    )


def entries(raw):
    """Normalised entries with parsed dates."""
    return parse_published(normalize(raw))


def land(raw, path, files_per_day=1, batch=None):
    """Add a batch of entries, partitioned by local day, so that a date range reads only its days.

    A batch that is landed again under the same name is there once. Each day is spread over
    ``files_per_day`` files by link, which keeps a busy day from ending up in one task. Batches of similar
    size are merged once there are ``FAN_IN`` of them, so a day has at most ``files_per_day`` files
    for each of ``FAN_IN - 1`` batches in each power of ``FAN_IN`` of rows.
    """
    versions = Versions(raw.sparkSession, path)
    batch = batch or uuid.uuid4().hex
    if batch in versions.current()[1].get("batches", []):
        return
    spread = F.pmod(F.xxhash64("link"), F.lit(files_per_day))

    def written(df):
        name = versions.write(df.select(*LANDED.names).repartition("day", spread), "entries", "day")
        return {"name": name, "rows": versions.read_partitioned([name], LANDED).count()}

    added = written(entries(raw).withColumn("day", F.to_date("published_local")))

    def changed(state):
        if batch in state.get("batches", []):
            return None
        merged = lambda several: written(versions.read_partitioned([p["name"] for p in several], LANDED))
        parts = merge_small([*state.get("parts", []), added], FAN_IN, merged)
        return {"batches": [*state.get("batches", []), batch], "parts": parts}

    versions.change(changed)


def read_landed(spark, path, start=None, end=None):
    """Entries written by ``land``; a range prunes the partitions, undated entries stay."""
    versions = Versions(spark, path)
    landed = versions.read_partitioned([p["name"] for p in versions.current()[1].get("parts", [])], LANDED)
    if start is not None:
        landed = landed.where(F.col("day").isNull() | (F.col("day") >= F.lit(start)))
    if end is not None:
        landed = landed.where(F.col("day").isNull() | (F.col("day") < F.lit(end)))
    return landed.drop("day")
