"""Exports of a report: the public columns, without the sort helper."""

from newsloom.schemas import RESULT_COLUMNS

_MARK = "\ufeff"
# Quotes are doubled and spaces kept, as spreadsheets expect.
_FORMAT = {
    "header": True,
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def public(report):
    return report.select(*[f"`{c}`" for c in RESULT_COLUMNS])


def write_csv(report, path, mode="errorifexists"):
    """CSV with header. The byte order mark makes spreadsheets read it as UTF-8."""
    table = public(report)
    first = table.columns[0]
    (
        table.withColumnRenamed(first, _MARK + first)
        .write.mode(mode)
        .options(emptyValue="", **_FORMAT)
        .csv(path)
    )


def read_csv(spark, path, schema):
    """An exported CSV, with the columns of ``schema`` by position."""
    return (
        spark.read.schema(schema)
        .options(multiLine=True, enforceSchema=True, **_FORMAT)
        .csv(path)
    )


def write_table(report, path, mode="errorifexists"):
    """The same rows as a Parquet table."""
    public(report).write.mode(mode).parquet(path)
