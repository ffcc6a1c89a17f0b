"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, always among the stop words.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def default_stop_words() -> frozenset[str]:
    """The month names and Spark's English list."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(MONTHS) | frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def word_size(text: Column) -> Column:
    """Number of ASCII word runs."""
    return F.regexp_count(text, F.lit(r"\w+"))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, without it; the whole text if there is none."""
    return F.substring_index(text, ".", 1)


def snippet(text: Column, n: int = 100) -> Column:
    """The first ``n`` characters and ``...`` if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def display(title: Column, category: Column, text: Column) -> Column:
    """Title, category and text on lines of their own; a null category is left out."""
    return F.concat_ws("\n", title, category, text)


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case runs of three or more letters a-z, repeats kept, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    stop = sorted(stop_words)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found
