"""Strings of which a pattern's match must contain one, so that most texts need not meet the pattern."""

from __future__ import annotations

import re
import warnings

with warnings.catch_warnings():  # the parser of re has no public name
    warnings.simplefilter("ignore")
    from re import _constants as K
    from re import _parser

from .textprims import quoted

#: Characters of a class that are listed, and strings of a pattern, beyond which none are derived.
MOST_LISTED, MOST = 32, 400


def _class(members: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in members:
        if op is K.LITERAL:
            found.add(chr(value))
        elif op is K.RANGE and value[1] - value[0] < MOST_LISTED:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_LISTED else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set that fewer texts contain a string of: not ASCII, then longer, then fewer."""
    def rank(s: set[str]) -> tuple:
        return (all(not x.isascii() for x in s), min(map(len, s)), -len(s))

    if not a or not b:
        return a or b
    return a if rank(a) >= rank(b) else b


def _of(items) -> set[str] | None:
    best, run = None, ""
    for op, value in [*items, (None, None)]:
        if op is K.LITERAL:
            run += chr(value)
            continue
        best, run = _better(best, {run} if run else None), ""
        if op is K.IN:
            best = _better(best, _class(value))
        elif op is K.SUBPATTERN and not value[1] & K.SRE_FLAG_IGNORECASE:
            best = _better(best, _of(value[3]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _of(value[2]))
        elif op is K.BRANCH:
            each = [_of(b) for b in value[1]]
            if all(each):
                best = _better(best, set().union(*each))
    return best


def needles(pattern: str) -> list[str] | None:
    """Strings of which every match contains at least one; None where none can be told.

    What lies in lookaround or in a part that may be absent counts for nothing, and neither does a
    pattern that sets flags or that only Java reads.
    """
    if re.search(r"&&|\[\^?[^\]]*\[|\\[QE]", pattern):
        return None
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    if parsed.state.flags & (K.SRE_FLAG_IGNORECASE | K.SRE_FLAG_VERBOSE):
        return None
    found = _of(parsed)
    if not found or len(found) > MOST:
        return None
    return sorted(s for s in found if not any(o != s and o in s for o in found))


def guard(text: str, found: list[str]) -> str:
    """SQL: whether a text contains one of some strings."""
    return "(" + " OR ".join(f"contains({text}, {quoted(x)})" for x in found) + ")"


def counted(text: str, pattern: str) -> str:
    """SQL: matches of a pattern in a text, met only where one of its needles is."""
    found, count = needles(pattern), f"regexp_count({text}, {quoted(pattern)})"
    return f"(CASE WHEN {guard(text, found)} THEN {count} ELSE 0 END)" if found else count


def screen(found: list[str]) -> str:
    """A character class that some character of every string falls in, as one pass over a text: Hangul
    as a whole, of other strings the first character that is not a letter, digit or space."""
    rest = set()
    for x in found:
        if not re.search("[가-힣]", x):
            rest.add(next((c for c in x if not c.isalnum() and not c.isspace()), x[0]))
    return "[가-힣" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(rest)) + "]"
