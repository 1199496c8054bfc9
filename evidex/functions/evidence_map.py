"""What a record is known by: a map from rule to the words that fired it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_fact(evidence: Column, rule: str, words: Column) -> Column:
    """The map with one rule's words set or replaced; of equal keys the later counts (``mapKeyDedupPolicy``)."""
    return F.map_concat(evidence, F.create_map(F.lit(rule), words))


def fact(evidence: Column, rule: str) -> Column:
    """The words of a rule, null where it did not fire."""
    return F.try_element_at(evidence, F.lit(rule))


def has_fact(evidence: Column, rule: str, words: str) -> Column:
    """Whether a rule fired with these words."""
    return F.map_contains_key(evidence, rule) & (fact(evidence, rule) == words)
