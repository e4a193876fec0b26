"""Token and title expressions. All of them stay in the JVM and need no shuffle."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegrade.fixed_values import ENGLISH_STOP_WORDS


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clean_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters and hyphens, longer than one character."""
    return find_all(F.lower(text), r"[\w-]{2,}")


def bag_of_words(sentences: Column) -> Column:
    """Cleaned tokens of all sentences in order; sentences carry a `words` array."""
    return clean_tokens(F.array_join(raw_words(sentences), " "))


def raw_words(sentences: Column) -> Column:
    return F.flatten(F.transform(sentences, lambda s: s["words"]))


def remove_stop_words(tokens: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    words = list(stop_words)
    return F.filter(tokens, lambda w: ~w.isin(words))


def counted_terms(tokens: Column) -> Column:
    """Array of (term, n) of one document, counted inside the row, without a shuffle.

    The sorted tokens fall into runs; a run starts where a token differs from the one
    before it, and its length is the distance to the next start.
    """
    runs = F.transform(
        F.array(F.sort_array(tokens)),
        lambda t: F.struct(
            t.alias("t"),
            F.filter(
                F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda i: (i == 0) | ~F.get(t, i).eqNullSafe(F.get(t, i - 1)),
            ).alias("starts"),
        ),
    )
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                r["starts"],
                lambda at, j: F.struct(
                    F.get(r["t"], at).alias("term"),
                    (F.coalesce(F.get(r["starts"], j + 1), F.size(r["t"])) - at)
                    .cast("long")
                    .alias("n"),
                ),
            ),
        )
    )


def comment_tokens(sentences: Column) -> Column:
    """Words of a comment given as a list of sentences; null for an empty list."""
    words = find_all(F.lower(F.array_join(sentences, " ")), r"\w+")
    return F.when(F.size(sentences) > 0, words)


def alpha_tokens(tokens: Column) -> Column:
    """Tokens that start with a letter."""
    return F.filter(tokens, lambda w: w.rlike("^[a-zA-Z]"))


def sentence_tag(category: Column, key: Column) -> Column:
    return F.concat_ws("_", category, key)


def strip_title(title: Column) -> Column:
    """Lower case without punctuation."""
    return F.regexp_replace(F.lower(title), r"\p{P}+", "")


def dated_title(title: Column, suffix: int = 6) -> Column:
    """Normalised title whose last characters hold a year in brackets."""
    kept = F.left(title, F.greatest(F.length(title) - suffix, F.lit(0)))
    return strip_title(F.btrim(kept, F.lit(" \t\n\r\x0b\x0c")))


def reason_tokens(reason: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Content words of a rating reason: what follows `for`, else all but two lead words."""
    drop = [*stop_words, *string.punctuation]
    blank = F.regexp_replace(F.lower(reason), r"[^\P{P}-]+", " ")
    split = F.filter(F.split(blank, r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"), lambda w: w != "")

    def content(words: Column) -> Column:
        after_for = F.array_position(words, "for").cast("int")
        kept = (
            F.when(after_for > 0, F.slice(words, after_for + 1, F.size(words)))
            .when(F.size(words) < 3, F.array().cast("array<string>"))
            .otherwise(F.slice(words, F.lit(3), F.size(words)))
        )
        return F.filter(kept, lambda w: ~w.isin(drop))

    return F.flatten(F.transform(F.array(split), content))


def craft_key(text: Column) -> Column:
    """Underscore-joined lower-case words."""
    return F.lower(F.array_join(find_all(text, r"\w+"), "_"))


def file_id(path: Column) -> Column:
    """Last path part up to its first dot."""
    return F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0]


def utf8_text(raw: Column) -> Column:
    """Bytes as text, with invalid UTF-8 sequences dropped."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
