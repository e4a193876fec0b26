"""Porter's suffix stripping as one SQL statement, an independent check of the stemmer.

Each step is a subquery over the one before. A word's shape writes vowels as `+` and
consonants as `.`; the measure counts its vowel-to-consonant changes.
"""

from __future__ import annotations

from cinegrade.functions.stem import STEP2, STEP3, STEP4


def _shape(x: str) -> str:
    marked = rf"regexp_replace({x}, '([^aeiouY])y', '\1Y', 'g')"
    return f"regexp_replace(regexp_replace({marked}, '[aeiouY]', '+', 'g'), '[^+]', '.', 'g')"


def _measure(x: str) -> str:
    return rf"len(regexp_extract_all({_shape(x)}, '\++\.+'))"


def _has_vowel(x: str) -> str:
    return f"contains({_shape(x)}, '+')"


def _short_end(x: str) -> str:
    return f"({_shape(x)} LIKE '%.+.' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _cut(n: int, x: str = "w") -> str:
    return f"left({x}, length({x}) - {n})"


def _suffix_step(table: dict[str, str], least: int) -> str:
    cases = []
    for suffix in sorted(table, key=len, reverse=True):
        stem = _cut(len(suffix))
        ok = f"{_measure(stem)} > {least}"
        if suffix == "ion":
            ok += f" AND right({stem}, 1) IN ('s', 't')"
        cases.append(
            f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {ok} THEN {stem} || '{table[suffix]}' ELSE w END"
        )
    return "CASE " + " ".join(cases) + " ELSE w END"


def stem_sql(vocab: str) -> str:
    """SQL giving (term, stem, n) for a query of (term, n)."""
    plurals = f"""CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)}
        WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_cut(1)} ELSE w END"""
    # the stripped form, or null where the step does not apply further
    stripped = f"""CASE WHEN ends_with(w, 'eed') THEN NULL
        WHEN ends_with(w, 'ed') AND {_has_vowel(_cut(2))} THEN {_cut(2)}
        WHEN ends_with(w, 'ed') THEN NULL
        WHEN ends_with(w, 'ing') AND {_has_vowel(_cut(3))} THEN {_cut(3)} END"""
    doubled = f"(length(r) > 1 AND right(r, 1) = left(right(r, 2), 1) AND right({_shape('r')}, 1) = '.')"
    repaired = f"""CASE
        WHEN r IS NULL THEN CASE WHEN ends_with(w, 'eed') AND {_measure(_cut(3))} > 0 THEN {_cut(1)} ELSE w END
        WHEN ends_with(r, 'at') OR ends_with(r, 'bl') OR ends_with(r, 'iz') THEN r || 'e'
        WHEN {doubled} AND right(r, 1) NOT IN ('l', 's', 'z') THEN {_cut(1, 'r')}
        WHEN {_measure('r')} = 1 AND {_short_end('r')} THEN r || 'e' ELSE r END"""
    final_y = f"CASE WHEN ends_with(w, 'y') AND {_has_vowel(_cut(1))} THEN {_cut(1)} || 'i' ELSE w END"
    final_e = f"""CASE WHEN ends_with(w, 'e') AND ({_measure(_cut(1))} > 1
        OR ({_measure(_cut(1))} = 1 AND NOT {_short_end(_cut(1))})) THEN {_cut(1)} ELSE w END"""
    final_l = f"CASE WHEN ends_with(w, 'll') AND {_measure('w')} > 1 THEN {_cut(1)} ELSE w END"
    return f"""
        WITH vocab AS ({vocab}),
        s0 AS (SELECT term, n, term AS w FROM vocab WHERE length(term) > 2),
        s1 AS (SELECT term, n, {plurals} AS w FROM s0),
        s2 AS (SELECT term, n, w, {stripped} AS r FROM s1),
        s3 AS (SELECT term, n, {repaired} AS w FROM s2),
        s4 AS (SELECT term, n, {final_y} AS w FROM s3),
        s5 AS (SELECT term, n, {_suffix_step(STEP2, 0)} AS w FROM s4),
        s6 AS (SELECT term, n, {_suffix_step(STEP3, 0)} AS w FROM s5),
        s7 AS (SELECT term, n, {_suffix_step(STEP4, 1)} AS w FROM s6),
        s8 AS (SELECT term, n, {final_e} AS w FROM s7)
        SELECT term, {final_l} AS stem, n FROM s8
        UNION ALL SELECT term, term AS stem, n FROM vocab WHERE length(term) <= 2"""
