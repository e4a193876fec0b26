"""Ratings and weak labels read off a comment's tokens."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrade.fixed_values import DENIALS, RENAMED_RATINGS, VALID_RATINGS


def is_valid_rating(rating: Column, valid: Iterable[str] = VALID_RATINGS) -> Column:
    return rating.isin(list(valid))


def binary_rating(rating: Column, positive: str = "R") -> Column:
    return F.when(rating == positive, positive).otherwise("NOT_" + positive)


def current_rating(rating: Column, renamed: Mapping[str, str] = RENAMED_RATINGS) -> Column:
    """Rating under its present name."""
    pairs = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, rating), rating)


def denial_label(tokens: Column) -> Column:
    """NEGATIVE for a comment that is one denying word, else null."""
    first = F.lower(F.get(tokens, 0))
    return F.when((F.size(tokens) == 1) & first.isin(DENIALS), "NEGATIVE")


def grade(tokens: Column) -> Column:
    """Grade of the form `n / 10`: the first usable number in front of a `10`."""

    def at(i: Column) -> Column:
        before = F.get(tokens, i - 1).try_cast("int")
        leading = F.when(F.get(tokens, 1) == "10", 10)
        return F.when(
            F.get(tokens, i) == "10",
            F.when(i == 0, leading).otherwise(F.when(before < 11, before)),
        )

    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1))
    return F.get(F.filter(F.transform(places, at), lambda g: g.isNotNull()), 0)


def resolved_vote(denial: Column, grade: Column, flag: Column) -> Column:
    """(label, vote) of a comment: 1 for sensitive content, 0 for none, null without any vote.

    The order: a denial says 0; else a grade says whether it is in the upper half of the scale; else the
    film's flag of the dimension holds.
    """
    votes = [("denial", F.when(denial == "NEGATIVE", 0)), ("grade", (grade >= 5).cast("int")), ("flag", flag.cast("int"))]
    label = F.coalesce(*[v for _, v in votes])
    vote = F.coalesce(*[F.when(v.isNotNull(), name) for name, v in votes])
    return F.struct(label.alias("label"), vote.alias("vote"))


def dimension_flags(tokens: Column, keywords: Mapping[str, Iterable[str]]) -> list[Column]:
    """One boolean column per dimension: does the text use any of its keywords?"""
    return [
        F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])).alias(name)
        for name, words in keywords.items()
    ]
