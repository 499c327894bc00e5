"""Typo and stem tiers of word comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lectern.functions.arabic import LEAST_STEM, light_stem

# --- fixed values: letters from which a query word may carry one or two edits -----
ONE_TYPO_LETTERS = 4
TWO_TYPO_LETTERS = 8
# -----------------------------------------------------------------------------------


def typo_budget(word: Column) -> Column:
    n = F.length(word)
    return F.when(n >= TWO_TYPO_LETTERS, 2).when(n >= ONE_TYPO_LETTERS, 1).otherwise(0)


def alignment_distance(a: str, b: str) -> int:
    """Optimal string alignment by a full table (words are short)."""
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int64)
    table[:, 0], table[0, :] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, table[i - 2, j - 2] + 1)
            table[i, j] = best
    return int(table[-1, -1])


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """The distance in full; for pairs of distinct words behind a prefilter, never for every row of a corpus."""
    return pd.Series([None if x is None or y is None else alignment_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def within_one_edit(a: Column, b: Column) -> Column:
    """Optimal string alignment of at most one, in closed form: what common prefix and suffix leave."""
    swap = (F.length(a) == F.length(b)) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: (F.left(a, i - 1) == F.left(b, i - 1)) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.substr(a, i + 2) == F.substr(b, i + 2)),
    )
    return (F.levenshtein(a, b, 1) >= 0) | swap


def comparable(query: Column, word: Column) -> Column:
    """What a typo match needs besides the distance; a transposition is two of Spark's edits."""
    budget = typo_budget(query)
    return (query == word) | ((budget > 0) & (F.abs(F.length(query) - F.length(word)) <= budget) & (F.left(query, F.lit(1)) == F.left(word, F.lit(1))) & (F.levenshtein(query, word, 4) >= 0) & (F.levenshtein(query, word, 4) <= 2 * budget))


def typo_cost(query: Column, word: Column, distance: Column) -> Column:
    """Edits, or null beyond the budget; ``distance`` is the alignment distance of comparable words."""
    return F.when(query == word, 0).when(comparable(query, word) & (distance <= typo_budget(query)), distance)


def stem_match(query: Column, word: Column) -> Column:
    stem = light_stem(query)
    return (query != word) & (F.length(stem) >= LEAST_STEM) & (stem == light_stem(word))


def word_cost(query: Column, strict: Column, word: Column, distance: Column) -> Column:
    """(stems, typos) or null: strict words match themselves; the stem tier only counts where the typo tier fails."""
    typos = typo_cost(query, word, distance)
    cost = lambda s, t: F.struct(s.cast("int").alias("stems"), t.cast("int").alias("typos"))
    return F.when(strict, F.when(query == word, cost(F.lit(0), F.lit(0)))).when(typos.isNotNull(), cost(F.lit(0), typos)).when(stem_match(query, word), cost(F.lit(1), F.lit(0)))
