"""Quality classifier: random Fourier features, ridge, isotonic calibration (operator 8).

Each whole text becomes a few statistics. Random Fourier features of the standardised
statistics approximate a Gaussian kernel, so ridge regression on them is a kernel method whose
normal equations are a sum over rows: every task sums its own rows and Spark adds the sums, of
a size that depends on the number of features alone. Isotonic regression on the training rows
turns the ridge output into a rate.

Null and empty texts have statistics of zero and are scored like any others, equal rows score
alike, rows without id are left out, empty tables give no rows, and without labels every score
is one half. Columns beside id and text are not read.
"""

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.calibration import apply_isotonic, fit_isotonic
from newsloom.llm.tables import documents
from newsloom.workspace import write_through

#: Random features, kernel width in standard deviations, ridge strength for each training row.
FEATURES = 160
WIDTH = 2.5
RIDGE = 1e-4
SEED = 7
#: Standardised statistics are held to this many deviations.
REACH = 6.0

STATISTICS = (
    "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "pipes",
    "repeated_next", "distinct_words", "symbol_ends", "long_words", "repeated_lines",
    "words_per_line", "letters", "bang_words", "log_lines",
)

_UPPER = np.arange(65, 91)
_DIGITS = np.arange(48, 58)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~[]", np.uint8)
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)


def statistics(text):
    """The statistics of one text, as a list; all zero for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw.strip():
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = text.split()
    n = len(words) or 1
    lines = [x for x in text.split("\n") if x]
    ends = sum(w[-1] in "#$%&*|" for w in words)
    bangs = sum(w.endswith("!!") for w in words)
    distinct = len(set(words))
    return [
        float(np.log1p(n)),
        len(text) / n,
        counts[_UPPER].sum() / size,
        counts[_DIGITS].sum() / size,
        counts[_SYMBOLS].sum() / size,
        counts[_PUNCTUATION].sum() / size,
        counts[124] / n,
        sum(map(eq, words, words[1:])) / n,
        # of a text of this length one expects fewer distinct words the longer it is
        distinct / n**0.8,
        ends / n,
        sum(len(w) > 20 for w in words) / n,
        1.0 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        1.0 - counts[:65].sum() / size,
        bangs / n,
        float(np.log1p(len(lines))),
    ]


def with_statistics(docs):
    """``doc_id, stats`` (array of double) of every document."""

    def of_batches(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch["text"].to_pylist()]
            column = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], column], names=["doc_id", "stats"])

    return documents(docs).mapInArrow(of_batches, "doc_id long, stats array<double>")


class Model:
    """Standardisation, random features and weights; ``knots`` after calibration."""

    def __init__(self, mean, spread):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.directions = draw.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phases = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + len(mean) + 1)
        self.knots = None

    def features(self, stats):
        """Random features, the statistics themselves and a constant, one row each."""
        x = np.clip((stats - self.mean) / self.spread, -REACH, REACH)
        waves = np.sqrt(2.0 / FEATURES) * np.cos(x @ self.directions + self.phases)
        return np.hstack([waves, 0.1 * x, np.ones((len(x), 1))])

    def raw(self, stats):
        return self.features(stats) @ self.weights


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_ridge(training, model):
    """Sets the weights from ``stats, label``; each task adds up its part of the normal equations."""
    width = len(model.weights) + 1

    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if not len(batch):
                continue
            rows = np.hstack([
                model.features(_matrix(batch["stats"])),
                batch["label"].to_numpy()[:, None].astype(float),
            ])
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "value"]
        )

    parts = training.select("stats", "label").mapInArrow(sums, "cell long, value double")
    # at most `width` squared cells, whatever the number of rows
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(width * width)
    for r in cells:
        total[r["cell"]] = r["value"]
    total = total.reshape(width, width)
    rows = max(1.0, total[-2, -2])  # the constant feature squared
    left = total[:-1, :-1] + RIDGE * rows * np.eye(width - 1)
    model.weights = np.linalg.solve(left, total[:-1, -1])


def train(stats, labels, where):
    """The model from the labelled rows of ``stats`` that satisfy ``where``."""
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")
    ).where("label in (0, 1)")
    training = write_through(stats.where(where).join(marks, "doc_id"), "labelled")
    moments = training.select(
        *[f(F.col("stats")[k]).alias(f"{f.__name__}{k}") for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    ).first()
    values = np.array([0.0 if v is None else v for v in moments]).reshape(-1, 2)
    model = Model(values[:, 0], np.maximum(values[:, 1], 1e-9))
    if moments[0] is not None:
        fit_ridge(training, model)
    model.knots = fit_isotonic(_raw(training, model, "label"))
    return model


def _raw(stats, model, *more):
    def of_batches(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch["stats"])) if len(batch) else np.zeros(0)
            kept = [batch[c] for c in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(raw)], ["doc_id", *more, "raw"])

    kinds = "".join(f"{c} int, " for c in more)
    return stats.select("doc_id", *more, "stats").mapInArrow(of_batches, f"doc_id long, {kinds}raw double")


def score(stats, model):
    """``doc_id, score`` (0 to 1) of every row of ``stats``; empty texts are scored too.

    Without labelled rows every score is one half.
    """

    def calibrated(batches):
        for batch in batches:
            out = apply_isotonic(batch["raw"].to_numpy(), model.knots)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out)], ["doc_id", "score"])

    return _raw(stats, model).mapInArrow(calibrated, "doc_id long, score double")
