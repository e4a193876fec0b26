"""Title similarity: the standard library's sequence ratio, evaluated on Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType


@arrow_udf(DoubleType())
def sequence_ratio(candidates: pa.Array, titles: pa.Array) -> pa.Array:
    """2 * matched characters / total characters, with the title as second sequence."""
    matcher = SequenceMatcher()
    seen = None
    out = []
    for candidate, title in zip(candidates.to_pylist(), titles.to_pylist()):
        if title != seen:
            matcher.set_seq2(title)
            seen = title
        matcher.set_seq1(candidate)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def relative_distance(a: Column, b: Column) -> Column:
    """Edit distance over the shorter length plus one."""
    return F.levenshtein(a, b) / (F.least(F.length(a), F.length(b)) + 1)


def character_tokens(title: Column, common: list[int] | None = None) -> Column:
    """One number per character, counting it among its equals; sorted, rare ones first.

    The common tokens of two titles count the characters they share. A token packs the
    code point, its number among equal characters, and its place in `common`, a list of
    frequent tokens from the less to the most frequent. Any list gives right results; one
    that fits the data lets fewer titles meet.
    """
    chars = F.array_sort(F.filter(F.split(title, ""), lambda c: c != ""))

    def numbered(sorted_chars: Column) -> Column:
        def token(c: Column, i: Column) -> Column:
            nth = i - F.array_position(sorted_chars, c) + 1
            return nth * 2**21 + F.ascii(c)

        return F.transform(sorted_chars, token)

    tokens = F.flatten(F.transform(F.array(chars), numbered))
    if not common:
        return F.array_sort(tokens)
    frequent = F.lit(common).cast("array<bigint>")
    return F.array_sort(F.transform(tokens, lambda t: F.array_position(frequent, t) * 2**42 + t))
