"""Greedy one-to-one matching inside a row, as a fold over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def greedy_matches(truth: Column, guess: Column, cost: Callable[[Column, Column], Column], most: float) -> Column:
    """Indices into guess, in order of truth: each element of truth takes the free guess of least cost (first on ties),
    if its cost is at most `most`. A null cost forbids a pair; an element without a match adds nothing."""
    places = F.sequence(F.lit(0), F.size(guess) - 1)
    indexed = F.when(F.size(guess) > 0, F.arrays_zip(guess.alias("g"), places.alias("k"))).otherwise(F.array())
    return F.aggregate(
        truth,
        F.array().cast("array<int>"),
        lambda used, t: _take(used, _cheapest(indexed, used, t, cost), most),
    )


def _free(indexed: Column, used: Column) -> Column:
    return F.filter(indexed, lambda p: ~F.array_contains(used, p["k"]))


def _cheapest(indexed: Column, used: Column, t: Column, cost) -> Column:
    priced = F.transform(_free(indexed, used), lambda p: F.struct(cost(t, p["g"]).alias("c"), p["k"].alias("k")))
    return F.array_min(F.filter(priced, lambda p: p["c"].isNotNull()))


def _take(used: Column, best: Column, most: float) -> Column:
    return F.when(best["c"] <= most, F.array_append(used, best["k"])).otherwise(used)


def f1(matched: Column, n_guess: Column, n_truth: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where nothing matches, null where there is nothing on either side."""
    return F.when(n_guess + n_truth > 0, 2.0 * matched / (n_guess + n_truth))
