"""From a regular expression to the Boolean query of trigrams that each of its matches must hold.

Patterns are parsed by Python's own parser.  An expression is turned into alternatives, each a
list of literal runs: a match of the expression contains, for at least one alternative, all its
runs in lower case.  A run of three or more characters gives its trigrams, which are joined by
AND; the alternatives are joined by OR.  An alternative without any trigram makes the whole
expression one that has none, to be scanned fully.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

MOST_ALTERNATIVES = 64
MOST_CLASS = 8

#: Between two runs: anything may stand here.
GAP = None


def _class_members(items) -> set[str] | None:
    """The lower-case characters of a class, or None where there are many."""
    found: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            found.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < MOST_CLASS:
            found |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CLASS else None


def _joined(left: list[tuple], right: list[tuple]) -> list[tuple]:
    out = [a + b for a in left for b in right]
    return out if len(out) <= MOST_ALTERNATIVES else [a + (GAP,) for a in left]


def _sequence(nodes) -> list[tuple]:
    """Alternatives, each a tuple of characters and gaps."""
    out: list[tuple] = [()]
    for op, arg in nodes:
        if op is c.LITERAL:
            part = [(chr(arg).lower(),)]
        elif op is c.IN:
            members = _class_members(arg)
            part = [(x,) for x in sorted(members)] if members else [(GAP,)]
        elif op is c.SUBPATTERN:
            part = _sequence(arg[3])
        elif op is c.BRANCH:
            part = [x for branch in arg[1] for x in _sequence(branch)]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, inner = arg
            once = _sequence(inner)
            if least == 0 and most == 1:
                part = [(), *once]
            elif least == 0:
                part = [(GAP,)]
            else:
                part = [()]
                for _ in range(min(least, 4)):
                    part = _joined(part, once)
                if most != least or least > 4:
                    part = [x + (GAP,) for x in part]
        elif op is c.AT:
            part = [()]
        else:
            part = [(GAP,)]
        out = _joined(out, part)
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of trigrams, or None if the pattern has to be scanned fully."""
    out = []
    for alternative in _sequence(parser.parse(pattern)):
        runs = "".join("\n\n" if x is GAP else x for x in alternative).split("\n\n")
        grams = sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})
        if not grams:
            return None
        out.append(grams)
    # an alternative that asks for all that another asks for is covered by it
    ways = {frozenset(x) for x in out}
    return sorted(sorted(x) for x in ways if not any(y < x for y in ways))


def check(pattern: str) -> None:
    """Raises for what differs between the engines that run it."""
    re.compile(pattern)
    if "\\w" in pattern or "\\d" in pattern or "\\s" in pattern:
        raise ValueError(f"write the class out: {pattern}")
