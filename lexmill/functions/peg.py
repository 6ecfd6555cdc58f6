"""Parsing expressions: ordered choice, sequence, repetition and predicates over a string, with backtracking.

An expression is a function of (text, position) that gives (end, values) or
None. Choice takes the first alternative that matches, so a malformed form
falls back to the next one at the same place.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

Result = tuple[int, list] | None
Expression = Callable[[str, int], Result]


def token(pattern: str, value: Callable[[regex.Match], object] | None = None) -> Expression:
    """A terminal; it yields `value` of the match, or nothing."""
    match = regex.compile(pattern).match

    def run(text: str, at: int) -> Result:
        m = match(text, at)
        return None if m is None else (m.end(), [value(m)] if value else [])

    return run


def sequence(*parts: Expression) -> Expression:
    def run(text: str, at: int) -> Result:
        values: list = []
        for part in parts:
            found = part(text, at)
            if found is None:
                return None
            at = found[0]
            values += found[1]
        return at, values

    return run


def choice(*parts: Expression) -> Expression:
    def run(text: str, at: int) -> Result:
        for part in parts:
            found = part(text, at)
            if found is not None:
                return found
        return None

    return run


def many(part: Expression) -> Expression:
    """Zero or more; stops at a match that takes no character."""

    def run(text: str, at: int) -> Result:
        values: list = []
        while True:
            found = part(text, at)
            if found is None or found[0] == at:
                return at, values
            at = found[0]
            values += found[1]

    return run


def nested(item: Expression, pairs: dict[str, str], alone: object) -> Expression:
    """Items, and items enclosed by `pairs` of marks at any depth; a mark without its partner yields `alone` at its place.

    At a mark the alternatives are, in this order: it closes the nearest open
    mark of its kind, it opens a pair, it stands alone. A pair whose partner
    never comes has failed, and the parser goes back to its opening mark and
    takes that alone. What stands behind the mark reads the same either way, so it is kept and not
    parsed again; open marks are held on a stack of their own. Each mark is
    put on it and taken off it once, so the time is linear in the text whatever the marks.
    Characters that neither an item nor a mark explains are passed over.
    """
    closing = frozenset(pairs.values())

    def run(text: str, at: int) -> Result:
        values: list = []
        open_: list[tuple[str, int]] = []  # the partner that is waited for, and the place of the mark among the values
        waited = dict.fromkeys(closing, 0)
        while at < len(text):
            found = item(text, at)
            if found is not None and found[0] > at:
                at = found[0]
                values += found[1]
                continue
            mark = text[at]
            at += 1
            if waited.get(mark):
                while True:
                    partner, place = open_.pop()
                    waited[partner] -= 1
                    if partner == mark:
                        values[place] = None
                        break
            elif mark in pairs:
                open_.append((pairs[mark], len(values)))
                waited[pairs[mark]] += 1
                values.append(alone)
            elif mark in closing:
                values.append(alone)
        return at, [v for v in values if v is not None]

    return run


def mapped(part: Expression, change: Callable[[list], list]) -> Expression:
    def run(text: str, at: int) -> Result:
        found = part(text, at)
        return None if found is None else (found[0], change(found[1]))

    return run
