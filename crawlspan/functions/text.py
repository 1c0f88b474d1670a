"""Text, cost and JSON helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def truncate_label(value: Column) -> Column:
    """More than 80 characters become 77 and three dots."""
    return F.when(F.char_length(value) > 80, F.concat(F.substring(value, 1, 77), F.lit("..."))).otherwise(value)


def truncate_words(text: Column, n: int) -> Column:
    """The first n words and a mark, or the text unchanged."""
    words = word_list(text)
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(" [... truncated]"))).otherwise(text)


def compute_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price of a request by rates for a thousand tokens."""
    return (tokens_in * rate_in + tokens_out * rate_out) / 1000


def json_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()
