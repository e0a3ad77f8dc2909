"""The Porter stemmer as SQL, to check searches on the stemmed index by.

It states the rules as patterns over vowels and consonants, apart from the stemmer of
``inkwell.functions.stem``, which counts them.
"""

from __future__ import annotations

from ..functions.stem import STEP_2, STEP_3, STEP_4

# c: a consonant and those after it; v: a vowel (y counts after a consonant) and those after it.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_FIRST = f"^(?:{_C}{_V}|[aeiou]+)"
_VOWEL = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"
_MANY, _TWO, _ONE = f"{_FIRST}{_C}", f"{_FIRST}{_C}{_V}{_C}", f"{_FIRST}{_C}(?:{_V})?$"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"


def _ends(end: str) -> str:
    return f"ends_with(w, '{end}')"


def _less(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _replaced(table: list[tuple[str, str]]) -> str:
    rows = sorted(table, key=lambda x: -len(x[0]))
    return "case " + " ".join(f"when {_ends(end)} then case when {_has(_less(len(end)), _MANY)} then {_less(len(end))} || '{new}' else w end" for end, new in rows) + " else w end"


def stems_sql(terms: str, name: str = "stems") -> str:
    """CTEs that end in ``name`` (term, stem) for the distinct values of ``term`` in ``terms``."""
    cut = f"case when {_ends('sses')} or {_ends('ies')} then {_less(2)} when {_ends('s')} and not {_ends('ss')} then {_less(1)} else w end"
    past = f"case when {_ends('eed')} then case when {_has(_less(3), _MANY)} then {_less(1)} else w end when {_ends('ed')} and {_has(_less(2), _VOWEL)} then {_less(2)} when {_ends('ing')} and {_has(_less(3), _VOWEL)} then {_less(3)} else w end"
    mended = f"case when w = was or ends_with(was, 'eed') then w when {_ends('at')} or {_ends('bl')} or {_ends('iz')} then w || 'e' when length(w) > 1 and right(w, 1) = substr(w, length(w) - 1, 1) and not regexp_matches(w, '[aeiouy]$') then case when regexp_matches(w, '[lsz]$') then case when {_has('w', _ONE)} and {_has('w', _SHORT)} then w || 'e' else w end else {_less(1)} end when {_has('w', _ONE)} and {_has('w', _SHORT)} then w || 'e' else w end"
    y = f"case when {_ends('y')} and {_has(_less(1), _VOWEL)} then {_less(1)} || 'i' else w end"
    ends = sorted(STEP_4, key=lambda x: -len(x))
    fourth = "case " + " ".join(f"when {_ends(e)} then case when {_has(_less(len(e)), _TWO)}{' and ' + _has(_less(len(e)), '[st]$') if e == 'ion' else ''} then {_less(len(e))} else w end" for e in ends) + " else w end"
    e = f"case when {_ends('e')} and ({_has(_less(1), _TWO)} or ({_has(_less(1), _ONE)} and not {_has(_less(1), _SHORT)})) then {_less(1)} else w end"
    l = f"case when {_ends('ll')} and {_has('w', _TWO)} then {_less(1)} else w end"
    ctes, last = [f"{name}_0 as (select term, w from (select distinct term, term as w from {terms}))"], f"{name}_0"
    for k, step in enumerate([cut, (past, mended), y, _replaced(STEP_2), _replaced(STEP_3), fourth, e, l], 1):
        if isinstance(step, tuple):
            ctes.append(f"{name}_{k}a as (select term, w as was, {step[0]} as w from {last})")
            ctes.append(f"{name}_{k} as (select term, {step[1]} as w from {name}_{k}a)")
        else:
            ctes.append(f"{name}_{k} as (select term, {step} as w from {last})")
        last = f"{name}_{k}"
    return ",\n".join([*ctes, f"{name} as (select term, case when length(term) <= 2 then term else w end as stem from {last})"])
