"""Toxicity by a weighted finite-state pattern grammar (operator 9).

Words are read into classes: insult, threat, target, negation, report. Small transducers, one
for each pattern, rewrite a clause's classes into weights; their product (one state per
combination of what was seen) reads a clause once and gives the score of its best reading, so
``you are an idiot`` scores more than ``idiot``, ``not an idiot`` less, and ``he called her an
idiot`` less still. A document's raw score is the sum over its clauses; isotonic calibration on
the training rows makes it a rate.

Null and empty texts score as texts without matches, equal rows score alike, rows without id are
left out of scores (``keep`` lets them through on their text), empty tables give no rows, and
without labels every score is near one half. Columns beside id and text are not read.

Insults are learned, since each language has its own and inflects them: words and word
beginnings that toxic training documents hold far more often than the others.
"""

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm.calibration import apply_isotonic, fit_isotonic
from newsloom.llm.tables import documents, slices, text_batches
from newsloom.workspace import write_through

#: Labelled documents of each label that the lexicon is learned from.
SAMPLE = 20_000
#: Entries of the learned lexicon, the strongest first; beginnings of 4 to 6 letters, or words.
LEXICON = 5000
SHORTEST, LONGEST = 4, 6
#: A stem is taken if toxic documents hold it so many times as often as the rest, in so many at least.
LIFT = 8.0
LEAST = 3
#: ... as often as this share of the most frequent stem, and as purely as this share of the purest,
#: or it explains toxic documents that no stronger stem does.
FREQUENT, PURE = 0.1, 0.85
#: ... and its share of toxic documents is so unlikely by chance (log-likelihood ratio; one in a
#: million). Beginnings to look into are taken from the lower value on.
UNLIKELY, WORTH_A_LOOK = 24.0, 10.0

# Closed word classes of four languages.
TARGETS = "you your youre u ur he she they them him her tu toi vous il elle ils du dich dir ihr sie er ella ellos usted ustedes te".split()
NEGATIONS = "not no never nobody isnt arent wasnt dont doesnt didnt without hardly ne pas jamais sans nicht kein keine nie niemals ohne nunca sin".split()
REPORTS = "said says say called calls quoted quote wrote writes claimed claims alleged reported according term word dit disait selon sagte nannte laut dijo llama palabra".split()
INSULTS = "idiot moron stupid dumb imbecile fool loser scum trash clown pathetic worthless disgusting ugly jerk bastard vermin abruti connard salaud dummkopf arschloch abschaum trottel estupido imbecil basura asqueroso".split()
THREATS = "kill murder hurt destroy beat burn shoot stab hang punch tuer mourir umbringen sterben matar morir".split()

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")

# ---- the grammar ------------------------------------------------------------------------------

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: How much of an insult's weight a clause keeps, by what else it holds.
TARGETED, PLAIN, DENIED, REPORTED = 1.5, 1.0, 0.4, 0.3
THREAT_WEIGHT = 1.0
#: Weight of an insult that is known but not learned.
KNOWN_WEIGHT = 2.0


def _seen(kind):
    """The transducer that passes from 0 to 1 when it reads ``kind``."""
    return {(0, c): int(c == kind) for c in range(6)} | {(1, c): 1 for c in range(6)}


def compose(*machines):
    """The product machine: states are tuples, one part for each machine."""
    start = (0,) * len(machines)
    arcs, open_ = {}, [start]
    while open_:
        state = open_.pop()
        for c in range(6):
            to = tuple(m[s, c] for m, s in zip(machines, state))
            if to not in {s for s, _ in arcs} and to != state:
                open_.append(to)
            arcs[state, c] = to
    return start, arcs


START, ARCS = compose(*(_seen(k) for k in (TARGET, NEGATION, REPORT)))


def factor(state):
    """The share of the weights that a clause ending in ``state`` keeps."""
    targeted, denied, reported = state
    out = TARGETED if targeted else PLAIN
    return out * (DENIED if denied else 1.0) * (REPORTED if reported else 1.0)


def clause_score(words, weight_of):
    """Weight of one clause (a list of lower-case words)."""
    state, insults, threats = START, 0.0, 0.0
    for word in words:
        weight = weight_of(word)
        kind = INSULT if weight else CLASSES.get(word, OTHER)
        insults += weight
        threats += THREAT_WEIGHT * (kind == THREAT)
        state = ARCS[state, kind]
    # a threat counts where it is aimed at somebody
    return factor(state) * (insults + (threats if state[0] else 0.0))


CLASSES = (
    dict.fromkeys(THREATS, THREAT)
    | dict.fromkeys(TARGETS, TARGET)
    | dict.fromkeys(NEGATIONS, NEGATION)
    | dict.fromkeys(REPORTS, REPORT)
)


class Grammar:
    """Scores texts with a lexicon ``{stem: weight}``; a stem ending in ``$`` is a whole word."""

    def __init__(self, lexicon):
        self._weights = lexicon
        self._find = ahocorasick.Automaton()
        for stem in lexicon:
            self._find.add_word(stem.rstrip("$"), len(stem.rstrip("$")))
        for word in THREATS:
            self._find.add_word(word, len(word))
        self._find.make_automaton()

    def weight(self, word):
        known = self._weights
        best = known.get(word + "$", 0.0)
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            best = max(best, known.get(word[:n], 0.0))
        return best

    def score(self, text):
        """Sum over the clauses that hold a stem at the start of a word."""
        text = text.lower()
        total, done = 0.0, -1
        for last, n in self._find.iter(text):
            first = last - n + 1
            if first <= done or (first and text[first - 1].isalpha()):
                continue
            begin = done + 1
            for m in CLAUSE_END.finditer(text, max(done + 1, first - 400), first):
                begin = m.end()
            if begin == done + 1 and first - begin > 400:
                ends = [m.end() for m in CLAUSE_END.finditer(text, begin, first)]
                begin = ends[-1] if ends else begin
            stop = CLAUSE_END.search(text, last + 1)
            done = stop.start() if stop else len(text)
            total += clause_score(WORD.findall(text, begin, done), self.weight)
        return total


# ---- learning -----------------------------------------------------------------------------------


def _stems(text, of=None):
    """Beginnings (without ``of``: of 4 letters; else longer ones and words that begin with one of it)."""
    found = set(WORD.findall(text.lower()))
    if of is None:
        return {w[:SHORTEST] for w in found if len(w) >= SHORTEST}
    out = set()
    for w in found:
        if w[:SHORTEST] in of:
            out.add(w + "$")
            out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def _count(training, of=None, ranks=None):
    """Documents of each label that hold each stem, counted in the task before the shuffle.

    With ``ranks`` a toxic document counts for the best ranked of its stems alone.
    """

    def tally(batches):
        from collections import Counter

        counts = [Counter(), Counter()]

        def told():
            rows = [(s, counts[0][s], counts[1][s]) for s in counts[0].keys() | counts[1].keys()]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                names=["stem", "clean", "toxic"],
            )

        for batch in slices(batches):
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                stems = _stems(text, of)
                if ranks is not None:
                    stems &= ranks.keys()
                    if label and stems:
                        stems = {min(stems, key=ranks.__getitem__)}
                counts[label].update(stems)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield told()
        yield told()

    rows = training.select("text", "label").mapInArrow(tally, "stem string, clean long, toxic long")
    return rows.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn_lexicon(training):
    """``{stem: weight}`` from ``text, label`` (0/1): ``INSULTS`` and at most ``LEXICON`` learned entries."""
    lexicon = {word + "$": KNOWN_WEIGHT for word in INSULTS}
    totals = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    clean, ones = totals.get(0, 0), totals.get(1, 0)
    if not ones or not clean:
        return lexicon

    def strongest(counts, lift, unlikely):
        rate = (F.col("clean") + 0.5) / (clean + 1.0)
        both = F.col("clean") + F.col("toxic")
        share = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (clean + ones) / (both * n))).otherwise(0.0)
        weight = F.log((F.col("toxic") + 0.5) / (ones + 1.0) / rate)
        return (
            counts.where(F.col("toxic") >= LEAST)
            .withColumn("weight", weight)
            .where(F.col("weight") > math.log(lift))
            .where(2 * (share("clean", clean) + share("toxic", ones)) > unlikely)
            # the purer of two stems for the same documents comes first
            .orderBy(F.desc(F.col("weight") ** 2 * F.col("toxic")), "stem")
            .limit(LEXICON)
        )

    # a beginning may be shared with harmless words; the words among them are told apart below
    likely = {r["stem"] for r in strongest(_count(training), 1.3, WORTH_A_LOOK).collect()}
    if not likely:
        return lexicon
    found = strongest(_count(training, likely), LIFT, UNLIKELY).collect()
    # copies of a toxic document make all of its words look toxic: a stem has to stand out among
    # the documents that no stronger one explains, or be about as frequent and pure as the best
    ranks = {r["stem"]: k for k, r in enumerate(found)}
    alone = {r["stem"] for r in strongest(_count(training, likely, ranks), LIFT, UNLIKELY).collect()}
    often = FREQUENT * max((r["toxic"] for r in found), default=0)
    pure = PURE * max((r["weight"] for r in found), default=0)
    found = [r for r in found if r["stem"] in alone or (r["toxic"] >= often and r["weight"] >= pure)]
    return lexicon | {r["stem"]: float(r["weight"]) for r in found}


def raw_scores(docs, lexicon):
    """``doc_id, raw`` for ``docs(doc_id, text)``."""

    def of_batches(batches):
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            raw = [math.log1p(grammar.score(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(raw, pa.float64())], names=["doc_id", "raw"]
            )

    return docs.select("doc_id", "text").mapInArrow(of_batches, "doc_id long, raw double")


def _marks(labels):
    return labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")
    ).where("doc_id is not null and label in (0, 1)")


def train(docs, labels, where):
    """The model ``(lexicon, knots)`` and the raw scores ``doc_id, raw`` of all documents.

    Learns from the labelled documents that satisfy ``where``: the lexicon from ``SAMPLE`` of
    each label at most, the first by hash of their ids, the calibration from all of them.
    """
    with text_batches(docs.sparkSession):
        return _train(documents(docs), _marks(labels).where(where))


def _train(docs, marks):
    # of equal texts one is learned from; only ids and hashes are moved
    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash")).join(marks, "doc_id")
    single = hashed.groupBy("hash", "label").agg(F.min("doc_id").alias("doc_id"))
    single = write_through(single.select("doc_id", "label"), "single")
    chosen = None
    for label in (0, 1):
        own = single.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = own if chosen is None else chosen.unionByName(own)
    # at most 2 * SAMPLE rows of two numbers
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, label int")
    lexicon = learn_lexicon(docs.join(F.broadcast(chosen), "doc_id"))
    raw = write_through(raw_scores(docs, lexicon), "raw-scores")
    return (lexicon, fit_isotonic(raw.join(marks, "doc_id"))), raw


def score(raw, model):
    """``doc_id, score`` (0 to 1) for raw scores; a null or empty text scores as one without matches."""

    def calibrated(batches):
        for batch in batches:
            out = apply_isotonic(batch["raw"].to_numpy(), model[1])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out)], ["doc_id", "score"])

    return raw.mapInArrow(calibrated, "doc_id long, score double")


def keep(docs, model, threshold):
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    lexicon, knots = model
    at = docs.columns.index("text")

    def of_batches(batches):
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            raw = [math.log1p(grammar.score(t or "")) for t in batch.column(at).to_pylist()]
            fine = apply_isotonic(np.array(raw), knots) < threshold
            yield batch.filter(pa.array(fine))

    return docs.mapInArrow(of_batches, docs.schema)
