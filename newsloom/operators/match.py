"""Which entries mention a region and an industry within the date range."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_published
from newsloom.functions.once import computed_once
from newsloom.functions.text import phrase_of, phrase_text
from newsloom.operators.membership import key_filter, members
from newsloom.operators.terms import clean
from newsloom.workspace import write_through

# Up to this many terms are tested within the scan; longer lists are joined.
INLINE_TERMS = 128
# Copies of the term list in the join, which split the entries that share a frequent phrase.
_SALTS = 16


def _phrases(terms):
    """Distinct terms with their phrase; a term without a letter or digit matches nothing."""
    cleaned = clean(terms).select("term", phrase_text(F.col("term")).alias("phrase"))
    return cleaned.where(F.trim("phrase") != "").distinct()


def _as_phrases(spark, terms):
    if isinstance(terms, DataFrame):
        return _phrases(terms.select("term"))
    return _phrases(spark.createDataFrame([(str(t),) for t in terms], "term string"))


def _short_list(terms):
    """``(phrase, term)`` pairs, or None when there are too many to be part of a plan."""
    if isinstance(terms, DataFrame):
        rows = _phrases(terms.select("term")).take(INLINE_TERMS + 1)
        pairs = [(r.phrase, r.term) for r in rows]
    else:
        cleaned = dict.fromkeys(str(t).strip() for t in terms)
        pairs = [(phrase_of(t), t) for t in cleaned if phrase_of(t).strip()]
    return None if len(pairs) > INLINE_TERMS else pairs


def in_range(df, start, end, day="published_local"):
    """Entries dated in ``[start, end)`` and undated ones.

    The half-open search windows tile this range, so no join with the windows is needed.
    A range that ends where it starts has no window and hence no entries at all.
    """
    if start == end:
        return df.where(F.lit(False))
    moment = F.col(day)
    lower = F.lit(start).cast("timestamp_ntz")
    upper = F.lit(end).cast("timestamp_ntz")
    return df.where(moment.isNull() | ((moment >= lower) & (moment < upper)))


def _match_inline(entries, regions, industries):
    if not (regions and industries):
        nothing = F.array().cast("array<string>")
        return entries.withColumns({"regions": nothing, "industries": nothing}).where(F.lit(False))
    padded = computed_once(entries, _text=phrase_text(F.col("title")))

    def mentioned(pairs):
        # a constant, folded into the plan
        options = F.from_json(
            F.lit(json.dumps([{"phrase": phrase, "term": term} for phrase, term in pairs])),
            "array<struct<phrase: string, term: string>>",
        )
        return F.filter(options, lambda option: F.contains("_text", option["phrase"]))["term"]

    # only the titles that mention a region are tested for industries
    some = computed_once(padded, regions=mentioned(regions)).where(F.size("regions") > 0)
    both = computed_once(some, industries=mentioned(industries)).where(F.size("industries") > 0)
    return both.drop("_text")


def _words(phrase):
    return F.split(F.trim(phrase), " ")


def anchored(terms, titles):
    """Where each phrase would be looked up: ``word, at, phrase, term, kind``.

    The anchor of a phrase is its word that the fewest of ``titles`` (``text``: arrays of words) hold. A phrase
    with a word that no title holds occurs nowhere and has none.
    """
    parts = terms.select("phrase", F.posexplode(_words(F.col("phrase"))).alias("at", "word")).distinct()
    parts = write_through(parts, "phrase-words")
    vocabulary = write_through(key_filter(parts.select("word").distinct(), "xxhash64(word)"), "vocabulary")
    said = titles.select(F.explode(F.array_distinct("text")).alias("word"))
    counts = members(said, vocabulary, "xxhash64(word)").groupBy("word").agg(F.count("*").alias("n"))
    rarest = (
        parts.join(counts, "word")
        .groupBy("phrase")
        .agg(F.min(F.struct("n", "at", "word")).alias("rarest"), F.count("*").alias("said"))
        .where(F.col("said") == F.size(_words(F.col("phrase"))))
        .select("phrase", "rarest.at", "rarest.word")
    )
    return terms.join(rarest, "phrase").select("word", "at", "phrase", "term", "kind")


def anchor_places(titles, anchors):
    """The places of ``titles`` that go through the join: ``_entry, text, at, word`` at words that are anchors."""
    known = write_through(key_filter(anchors.select("word").distinct(), "xxhash64(word)"), "anchor-words")
    places = titles.select("_entry", "text", F.posexplode("text").alias("_at", "word"))
    return members(places, known, "xxhash64(word)")


def _match_joined(entries, regions, industries):
    terms = regions.select("phrase", "term", F.lit("r").alias("kind")).union(
        industries.select("phrase", "term", F.lit("i").alias("kind"))
    )
    terms = write_through(terms, "terms")
    # entries are told apart by a number, so that repeated ones stay repeated
    entries = write_through(entries.withColumn("_entry", F.monotonically_increasing_id()), "entries")
    titles = computed_once(entries.select("_entry", "title"), text=_words(phrase_text(F.col("title"))))
    titles = titles.select("_entry", "text")
    anchors = write_through(anchored(terms, titles), "anchors")
    # a frequent anchor is split over the salts
    places = anchor_places(titles, anchors).withColumn(
        "_salt", F.pmod(F.xxhash64("_entry"), F.lit(_SALTS)).cast("int")
    )
    salted = anchors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    of_kind = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("term")))
    length = F.size(_words(F.col("phrase")))
    start = F.col("_at") - F.col("at") + 1
    said = F.array_join(F.slice("text", F.greatest(start, F.lit(1)), length), " ")
    found = (
        places.join(salted, ["word", "_salt"])
        .where((start >= 1) & (said == F.trim("phrase")))
        .groupBy("_entry")
        .agg(of_kind("r").alias("regions"), of_kind("i").alias("industries"))
        .where((F.size("regions") > 0) & (F.size("industries") > 0))
    )
    return entries.join(found, "_entry").drop("_entry")


def _mentioning(entries, regions, industries):
    """Entries that mention a region and an industry, with both lists as arrays."""
    short = [_short_list(regions), _short_list(industries)]
    if None not in short:
        return _match_inline(entries, *short)
    spark = entries.sparkSession
    return _match_joined(entries, _as_phrases(spark, regions), _as_phrases(spark, industries))


def match_entries(entries, regions, industries, start, end):
    """Dated entries in range that mention a region and an industry, with both as arrays.

    A short list becomes a literal, so matching is part of the scan and shuffles nothing.
    Longer lists are looked up at the rarest word of each phrase, so a title goes through the join
    only where such a word stands. Entries with dates (a landed
    feed) are cut to the range first; otherwise only the dates of matching entries are parsed.
    Both ways give the same rows; an entry that is repeated is matched each time.
    """
    if start > end:
        raise ValueError("the start date must not be after the end date")
    if "published_local" in entries.columns:
        return _mentioning(in_range(entries, start, end), regions, industries)
    return in_range(parse_published(_mentioning(entries, regions, industries)), start, end)


def match_articles(entries, regions, industries, start, end):
    """One row per entry and matching (region, industry) pair."""
    hits = match_entries(entries, regions, industries, start, end)
    return (
        hits.withColumn("wilayah", F.explode("regions"))
        .withColumn("usaha", F.explode("industries"))
        .drop("regions", "industries")
    )
