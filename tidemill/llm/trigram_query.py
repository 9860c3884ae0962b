"""Boolean trigram queries of regular expressions.

A query is ``None`` (nothing is known: scan), a frozenset tagged ``("and", ...)`` or ``("or", ...)`` of queries, or a
three-byte string. It is a necessary condition: a text that matches the expression satisfies the query. Texts and
trigrams are folded (A-Z to a-z), so one index serves rules that ignore case and rules that don't.
"""

from __future__ import annotations

import re
from itertools import product

import re._constants as C
import re._parser as parser

#: Most strings that an exactly known part of an expression may stand for before it is turned into trigrams.
MAX_STRINGS = 32

Query = bytes | tuple | None


def all_of(parts: list[Query]) -> Query:
    known = {p for p in parts if p is not None}
    if not known:
        return None
    return known.pop() if len(known) == 1 else ("and", frozenset(known))


def any_of(parts: list[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    return parts[0] if len(set(parts)) == 1 else ("or", frozenset(parts))


def _of_string(s: str) -> Query:
    data = s.encode().lower()
    return all_of([data[i : i + 3] for i in range(len(data) - 2)])


def _of_strings(strings: frozenset[str]) -> Query:
    return any_of([_of_string(s) for s in sorted(strings)])


class _Part:
    """Either ``strings``: exactly these match; or ``query``: all that is known of a match."""

    def __init__(self, strings: frozenset[str] | None = None, query: Query = None):
        self.strings, self.query = strings, query

    def known(self) -> Query:
        return _of_strings(self.strings) if self.strings is not None else self.query


def _members(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < MAX_STRINGS:
            out.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return frozenset(out) if len(out) <= MAX_STRINGS else None


def _sequence(items) -> _Part:
    exact: frozenset[str] = frozenset({""})
    found: list[Query] = []
    whole = True
    for item in items:
        part = _item(*item)
        if part.strings is not None and len(exact) * len(part.strings) <= MAX_STRINGS:
            exact = frozenset(a + b for a, b in product(exact, part.strings))
            continue
        whole = False
        found.append(_of_strings(exact))
        exact = part.strings if part.strings is not None else frozenset({""})
        if part.strings is None:
            found.append(part.query)
    return _Part(strings=exact) if whole else _Part(query=all_of([*found, _of_strings(exact)]))


def _item(op, arg) -> _Part:
    if op is C.LITERAL:
        return _Part(strings=frozenset({chr(arg).lower() if arg < 128 else chr(arg)}))
    if op is C.IN:
        members = None if arg and arg[0][0] is C.NEGATE else _members(arg)
        return _Part(strings=members) if members else _Part()
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        if all(p.strings is not None for p in parts):
            strings = frozenset().union(*(p.strings for p in parts))
            if len(strings) <= MAX_STRINGS:
                return _Part(strings=strings)
        return _Part(query=any_of([p.known() for p in parts]))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        inner = _sequence(body)
        if inner.strings is not None and high != C.MAXREPEAT and sum(len(inner.strings) ** k for k in range(low, high + 1)) <= MAX_STRINGS:
            return _Part(strings=frozenset("".join(t) for k in range(low, high + 1) for t in product(inner.strings, repeat=k)))
        return _Part(query=inner.known() if low else None)
    if op is C.AT:
        return _Part(strings=frozenset({""}))
    return _Part()  # look-arounds, any character, back references


def trigram_query(pattern: str) -> Query:
    return _sequence(parser.parse(pattern, re.ASCII)).known()


def trigrams_of(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))
