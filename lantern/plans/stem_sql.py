"""The stemmer as SQL, for the registered queries' counterparts.

Conditions are regular expressions over the word itself: ``C`` is a run of
consonants, ``V`` one of vowels.  A leading y, a consonant, is capital meanwhile.
"""

from __future__ import annotations

from lantern.functions import stems

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, ONE, MORE = f"^({C})?{V}{C}", f"^({C})?{V}{C}({V})?$", f"^({C})?{V}{C}{V}{C}"
VOWEL, SHORT = f"^({C})?[aeiouy]", f"^{C}[aeiouy][^aeiouwxy]$"


def _head(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _is(of: str, shape: str) -> str:
    return f"regexp_matches({of}, '{shape}')"


def _case(*pairs: tuple[str, str]) -> str:
    return "case " + " ".join(f"when {a} then {b}" for a, b in pairs) + " else w end"


def _ends(*ends: str) -> str:
    return "(" + " or ".join(f"ends_with(w, '{e}')" for e in ends) + ")"


def _rules(rules: dict[str, str], shape: str) -> str:
    return _case(*((_ends(e), f"case when {_is(_head(len(e)), shape)}{more} then {_head(len(e))} || '{new}' else w end") for e, new in rules.items() for more in [f" and right({_head(3)}, 1) in ('s', 't')" if e == "ion" else ""]))


def _steps() -> list[str]:
    double = "length(w) > 1 and right(w, 1) = substr(w, length(w) - 1, 1) and right(w, 1) not in ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')"
    cut = _case(
        (_ends("eed"), f"case when {_is(_head(3), SOME)} then {_head(1)} else w end"),
        (f"{_ends('ed')} and {_is(_head(2), VOWEL)}", f"'<' || {_head(2)}"),
        (f"{_ends('ing')} and not {_ends('ed')} and {_is(_head(3), VOWEL)}", f"'<' || {_head(3)}"),
    )
    # What was cut is marked by a sign in front until it is mended.
    mended = _case((_ends("at", "bl", "iz"), "w || 'e'"), (double, _head(1)), (f"{_is('w', ONE)} and {_is('w', SHORT)}", "w || 'e'"))
    return [
        "case when starts_with(w, 'y') then 'Y' || substr(w, 2) else w end",
        _case((_ends("sses", "ies"), _head(2)), (f"{_ends('s')} and not {_ends('ss')}", _head(1))),
        cut,
        f"case when starts_with(w, '<') then (select {mended} from (select substr(o, 2) as w)) else w end",
        _case((f"{_ends('y')} and {_is(_head(1), VOWEL)}", f"{_head(1)} || 'i'")),
        _rules(stems._STEP_2, SOME),
        _rules(stems._STEP_3, SOME),
        _rules(dict.fromkeys(stems._STEP_4, ""), MORE),
        _case((f"{_ends('e')} and ({_is(_head(1), MORE)} or {_is(_head(1), ONE)} and not {_is(_head(1), SHORT)})", _head(1))),
        _case((f"{_ends('ll')} and {_is('w', MORE)}", _head(1))),
        "replace(w, 'Y', 'y')",
    ]


def stemmed(words: str) -> str:
    """SQL of (term, stem) for a query that gives distinct lower-case ``term``."""
    out = f"select term, term as w from ({words}) where length(term) > 2"
    for step in _steps():
        out = f"select term, {step} as w from (select term, w, w as o from ({out}))"
    return f"select term, w as stem from ({out}) union all select term, term from ({words}) where length(term) <= 2"
