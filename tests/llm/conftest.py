import pytest

# columns that share names with those the operators use inside
CLASHING = ["part", "item", "hash", "fp", "key", "raw", "label", "start", "length", "n", "found", "spans"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with further columns if asked for."""

    def make(rows, clashing=False):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        if clashing:
            for name in CLASHING:
                frame = frame.selectExpr("*", f"'x' as `{name}`")
        return frame

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and odd characters."""
    passage = " ".join(f"word{k * k % 97}" for k in range(70))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, passage),
        (6, passage),
        (6, passage),
        (7, "lead " + passage + " tail"),
        (8, "a" * 900),
        (9, "naïve café — ünïcödé 文字 " * 30),
        (10, " ".join(f"long{k % 5000}" for k in range(60_000))),
        (11, "two  spaces and <|endoftext|> \n\n lines   end "),
        (12, "x\x00y\x00" * 80),
    ]
