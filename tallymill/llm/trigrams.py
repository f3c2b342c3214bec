"""Trigrams that any match of a regular expression must contain."""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

# Beyond so many strings, a part of an expression no longer counts as a list of strings.
MOST_STRINGS = 64

Query = list[frozenset[str]]
_ALWAYS: Query = [frozenset()]


def _simplest(query: Query) -> Query:
    """Without alternatives that another one implies."""
    different = sorted(set(query), key=lambda c: (len(c), sorted(c)))
    return [c for k, c in enumerate(different) if not any(d <= c for d in different[:k])]


def _both(one: Query, two: Query) -> Query:
    return _simplest([a | b for a, b in product(one, two)])


def _of_strings(strings: set[str]) -> Query:
    return _simplest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _characters(items: list) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 16:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 16 else None


def _part(kind, value) -> tuple[set[str] | None, Query]:
    """The strings that this part matches, if they can be listed; else what a match must have."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, _ALWAYS
    if kind is op.IN:
        return _characters(value), _ALWAYS
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), _ALWAYS
        return None, _simplest([c for strings, query in parts for c in (query if strings is None else _of_strings(strings))])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), _ALWAYS
        if least:
            return None, query if strings is None else _of_strings(strings)
        return None, _ALWAYS
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}, _ALWAYS
    return None, _ALWAYS


def _sequence(items) -> tuple[set[str] | None, Query]:
    strings, query, listed = {""}, _ALWAYS, True
    for kind, value in items:
        more, needed = _part(kind, value)
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, more)}
            continue
        listed = False
        query = _both(query, _of_strings(strings))
        strings = more if more is not None else {""}
        query = _both(query, needed)
    if listed:
        return strings, _ALWAYS
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """Alternatives, each a set of lower-cased trigrams: every match of `pattern` has all
    trigrams of one of them. Empty if nothing is certain, so that all texts must be read."""
    strings, query = _sequence(_parser.parse(pattern))
    query = query if strings is None else _of_strings(strings)
    return [] if frozenset() in query else query
