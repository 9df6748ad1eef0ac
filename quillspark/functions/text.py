"""Column expressions on text, each with its SQL twin for the oracle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


_TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def tokens(text: Column) -> Column:
    """Lower-case words; every Han character is a word of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(_TOKEN))


def tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def words(text: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(trim({text}), '\s+'), lambda w: w <> '')"


def matches(text: Column, lexicon: Sequence[str]) -> Column:
    """How many entries of a lexicon a text contains, each counted once."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in lexicon])


def matches_sql(text: str, lexicon: Sequence[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {quoted(w)}) THEN 1 ELSE 0 END" for w in lexicon) + ")"


def any_of(text: Column, lexicon: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in lexicon])


def any_of_sql(text: str, lexicon: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in lexicon) + ")"


def contained(text: Column, lexicon: Sequence[str]) -> Column:
    """The entries that a text contains, in the lexicon's order."""
    return F.filter(F.array(*[F.lit(w) for w in lexicon]), lambda w: F.contains(text, w))


def contained_sql(text: str, lexicon: Sequence[str]) -> str:
    return f"list_filter([{', '.join(quoted(w) for w in lexicon)}], lambda w: contains({text}, w))"


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"
