"""Text of a statement to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

from millrace.errors import ParseError

# The words that can't be names; they may be written in any case.
KEYWORDS = frozenset(
    "AND ASC BY CREATE DELETE DESC DISTINCT FROM GROUP HAVING INDEX INSERT INT INTO KEY LIMIT ON OR ORDER PRIMARY SELECT SET TABLE TEXT UPDATE VALUES WHERE".split()
)
LARGEST = 2**63 - 1

_RULES = re.compile(
    r"""(?P<blank>\s+)
    |(?P<number>\d+)
    |(?P<word>[^\W\d]\w*)
    |'(?P<text>[^']*)(?:'|\Z)
    |(?P<sign>!=|>=|<=|[=><*(),;])""",
    re.X,
)


class Token(NamedTuple):
    kind: str  # keyword, word, number, text, sign or end
    value: str | int
    at: int

    def __str__(self) -> str:
        return "end of statement" if self.kind == "end" else f"'{self.value}'"


def tokens(statement: str) -> list[Token]:
    """All tokens and an ``end``. A text runs to the next quote, or to the end if there is none; it knows no escapes."""
    out, at = [], 0
    while at < len(statement):
        m = _RULES.match(statement, at)
        if m is None:
            raise ParseError(f"unexpected character {statement[at]!r} at position {at}")
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "word" and value.upper() in KEYWORDS:
            out.append(Token("keyword", value.upper(), at))
        elif kind == "number":
            if int(value) > LARGEST:
                raise ParseError(f"number {value} does not fit into 64 bits")
            out.append(Token("number", int(value), at))
        elif kind != "blank":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", at)]
