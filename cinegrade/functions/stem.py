"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

# Suffixes of the published algorithm and what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP4 = {
    s: "" for s in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
}


def _shape(word: str) -> str:
    """The word as a string of v (vowel) and c (consonant)."""
    kinds: list[str] = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and kinds[-1:] == ["c"])
        kinds.append("v" if vowel else "c")
    return "".join(kinds)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace_longest(word: str, table: dict[str, str], least: int) -> str:
    """Replace the longest suffix in the table if what precedes it is long enough."""
    for n in range(min(7, len(word)), 1, -1):
        suffix = word[-n:]
        if suffix in table:
            stem = word[:-n]
            if suffix == "ion" and stem[-1:] not in ("s", "t"):
                return word
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def _plurals(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past_and_progressive(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = next((s for s in ("ed", "ing") if word.endswith(s)), None)
    if suffix is None or not _has_vowel(word[: len(word) - len(suffix)]):
        return word
    word = word[: len(word) - len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _doubled(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def _final_letters(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    """Stem of one lower-case word; words of one or two letters stay as they are."""
    if len(word) < 3:
        return word
    word = _past_and_progressive(_plurals(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(word, STEP2, 0)
    word = _replace_longest(word, STEP3, 0)
    word = _replace_longest(word, STEP4, 1)
    return _final_letters(word)


def _stem_values(words: pa.Array) -> pa.Array:
    """Stems a batch by way of its distinct words."""
    coded = words.dictionary_encode()
    stems = [None if w is None else porter_stem(w) for w in coded.dictionary.to_pylist()]
    return pa.array(stems, pa.string()).take(coded.indices)


@arrow_udf(StringType())
def stem_word(words: pa.Array) -> pa.Array:
    return _stem_values(words)


@arrow_udf(ArrayType(StringType()))
def stem_tokens(bags: pa.Array) -> pa.Array:
    """Stems every token of every bag; each distinct word of a batch is stemmed once."""
    if isinstance(bags, pa.ChunkedArray):
        bags = bags.combine_chunks()
    lengths = [0 if n is None else n for n in pc.list_value_length(bags).to_pylist()]
    offsets = [0]
    for n in lengths:
        offsets.append(offsets[-1] + n)
    stems = _stem_values(bags.flatten())
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), stems, mask=pc.is_null(bags)
    )
