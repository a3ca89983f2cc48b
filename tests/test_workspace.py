from types import SimpleNamespace

import pytest

from newsloom import workspace


def session(configured, master, was_set=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": configured}.get(key) or default),
        sparkContext=SimpleNamespace(
            master=master, applicationId="app-1", getCheckpointDir=lambda: was_set
        ),
    )


def test_shared_folder_comes_from_the_session():
    assert workspace.shared_folder(session("s3a://bucket/scratch/", "yarn")) == "s3a://bucket/scratch"
    assert workspace.shared_folder(session(None, "yarn", "hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        workspace.shared_folder(session(None, "yarn"))
    local = workspace.shared_folder(session(None, "local[8]"))
    assert local == workspace.shared_folder(session(None, "local[8]"))


def test_written_tables_keep_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "array(cast(id as string)) as labels")
    table = workspace.write_through(df, "check")
    assert table.schema.names == df.schema.names and table.count() == 10
    folder = workspace.shared_folder(spark).removeprefix("file:").lstrip("/")
    assert folder in table.inputFiles()[0]
