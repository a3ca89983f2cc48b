"""Schemas and fixed values shared by the whole package."""

from pyspark.sql import types as T

_S = T.StringType()
_NTZ = T.TimestampNTZType()

# One landed feed entry. ``seq`` is the ingest order and makes "first seen" reproducible.
ENTRY = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("title", _S),
    T.StructField("published", _S),
    T.StructField("link", _S),
    T.StructField("source", _S),
])

# An entry with parsed dates, landed by local day.
LANDED = T.StructType([
    *ENTRY.fields,
    T.StructField("published_local", _NTZ),
    T.StructField("published_at", _NTZ),
    T.StructField("day", T.DateType()),
])

# Outcome of resolving a feed link to the publisher's address.
RESOLUTION = T.StructType([
    T.StructField("link", _S),
    T.StructField("decoded_url", _S),
    T.StructField("status", T.BooleanType()),
])

# ---- fixed values: result columns, labels, limits, stop words ----------------
RESULT_COLUMNS = [
    "Tanggal", "Judul", "Sumber", "Wilayah", "Usaha", "Liputan Serupa", "Status URL", "URL",
]
SORT_COLUMN = "TanggalSort"
STATUS_RESOLVED = "Asli"
STATUS_REDIRECT = "Redirect Google News"
MISSING = "-"
LABEL_SEPARATOR = ", "
WINDOW_DAYS = 30
SIMILARITY_THRESHOLD = 82
MAX_RUNS = 8
TOP_LABELS = 10
TOP_KEYWORDS = 15
PAGE_ROWS = 10
STOP_WORDS = [
    "yang", "dan", "di", "ke", "dari", "untuk", "pada", "dengan", "ini", "itu", "akan", "adalah",
    "atau", "juga", "dalam", "tidak", "ada", "oleh", "secara", "telah", "sudah", "bisa", "dapat",
    "para", "per", "sebagai", "saat", "kata", "tahun", "persen", "yaitu", "sebuah", "seorang",
    "hingga", "serta", "namun", "tetapi", "karena", "sehingga", "antara", "lebih", "kurang",
    "masih", "belum", "dua", "tiga", "satu", "empat", "lima", "kami", "kita", "mereka", "dia",
    "nya", "pun", "lah", "kah", "apa", "siapa", "bagaimana", "mengapa", "kapan", "dimana", "atas",
    "bawah", "menjadi", "jadi", "terkait", "usai", "resmi", "the", "and", "for", "of", "in", "to",
    "is", "on", "with", "as", "at", "by",
]
# ------------------------------------------------------------------------------

REPORT = T.StructType([
    T.StructField("Tanggal", _S),
    T.StructField(SORT_COLUMN, _NTZ),
    T.StructField("Judul", _S),
    T.StructField("Sumber", _S),
    T.StructField("Wilayah", _S),
    T.StructField("Usaha", _S),
    T.StructField("Liputan Serupa", T.IntegerType()),
    T.StructField("Status URL", _S),
    T.StructField("URL", _S),
])

# A stored report keeps the ingest order, which breaks ties in the order of its rows.
SNAPSHOT = T.StructType([T.StructField("seq", T.LongType()), *REPORT.fields])

RUN = T.StructType([
    T.StructField("run_id", _S),
    T.StructField("run_at", _NTZ),
    T.StructField("waktu", _S),
    T.StructField("wilayah", _S),
    T.StructField("usaha", _S),
    T.StructField("periode", _S),
    T.StructField("jumlah", T.LongType()),
    T.StructField("durasi", _S),
])


def empty_report(spark):
    """A report with no rows but the full schema."""
    return spark.createDataFrame([], REPORT)
