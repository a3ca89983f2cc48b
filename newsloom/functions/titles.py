"""Native features of a headline for the token-set comparison."""

from pyspark.sql import functions as F

from newsloom.functions.text import split_on_space


def token_set(title):
    """The distinct words of a title in code point order."""
    return F.sort_array(F.array_distinct(split_on_space(title)))


def joined_length(tokens):
    """Length of the tokens joined by single spaces."""
    return F.length(F.array_join(tokens, " "))
