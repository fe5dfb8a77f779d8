"""Tokens of the query language and of Turtle."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\s]*>)
  | (?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<pname>(?:[^\W\d_][\w\-]*)?:(?:[\w\-%]+(?:\.+[\w\-%]+)*)?)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
  | (?P<name>[^\W\d]\w*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[=<>!+\-*/{}()\[\].,;|^])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class TokenError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise TokenError(f"unexpected character {text[at]!r} at {at}")
        if found.lastgroup != "skip":
            out.append(Token(found.lastgroup, found[0], at))
        at = found.end()
    return [*out, Token("end", "", at)]


def unquote(text: str) -> str:
    body = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]

    def plain(m: re.Match) -> str:
        code = m[1]
        return chr(int(code[1:], 16)) if code[0] in "uU" else _ESCAPE.get(code, code)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", plain, body, flags=re.DOTALL)
