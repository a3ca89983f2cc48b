"""Landed link resolutions."""

from newsloom.schemas import RESOLUTION


def read_resolution(spark, path, source_format="parquet"):
    return spark.read.schema(RESOLUTION).format(source_format).load(path)
