"""Column functions on text: all of them stay inside the JVM."""

import re

from pyspark.sql import functions as F

from newsloom.schemas import LABEL_SEPARATOR

# White space of any script, as text, and the characters that end a line.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(text):
    """Remove leading and trailing white space of any script."""
    return F.trim(text, F.lit(_SPACES))


def _plain_spaces(text):
    return F.translate(text, _SPACES, " " * len(_SPACES))


def split_on_space(text):
    """Non-empty words separated by white space."""
    return F.array_remove(F.split(_plain_spaces(text), " "), "")


def text_or(text, default):
    """``text``, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def split_terms(text):
    """Terms of a free text, separated by commas or line breaks."""
    return clean_terms(F.split(F.translate(text, _LINE_ENDS, "," * len(_LINE_ENDS)), ","))


def clean_terms(terms):
    """Strip every term of an array and drop the blank ones."""
    return F.array_remove(F.transform(terms, strip), "")


def title_key(title):
    """Exact-match key: lower case, ASCII letters and digits, single spaces."""
    # (?U) gives white space its meaning in any script
    kept = F.regexp_replace(F.lower(title), r"(?U)[^a-z0-9\s\x1c-\x1f]", "")
    return strip(F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f]+", " "))


def phrase_text(text):
    """Words in lower case, each between single spaces, so that phrases match whole words."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def phrase_of(term):
    """``phrase_text`` of a single string, for literals in a plan."""
    return f" {re.sub('[^a-z0-9]+', ' ', term.lower()).strip()} "


def ascii_words(text, least):
    """Runs of at least ``least`` ASCII letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{%d,}" % least), F.lit(0))


def join_labels(labels):
    """One text cell from an array of labels."""
    return F.array_join(labels, LABEL_SEPARATOR)


def split_labels(cell):
    """The labels of a text cell; a label that contains the separator comes apart."""
    return F.split(cell, LABEL_SEPARATOR)


def run_label(terms, shown=3):
    """The first terms, followed by how many others there are."""
    rest = F.size(terms) - shown
    tail = F.when(rest > 0, F.format_string(" +%d lainnya", rest)).otherwise(F.lit(""))
    return F.concat(join_labels(F.slice(terms, 1, shown)), tail)


def search_phrase(region, industry):
    """The two quoted phrases of one search."""
    return F.format_string('"%s" "%s"', region, industry)
