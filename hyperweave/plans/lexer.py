"""Tokens of the statement language: words, numbers, quoted texts, references and signs. Comments run from -- to the line's end."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)|(?P<text>'(?:[^']|'')*')|(?P<variable>\$[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*)|(?P<sign><>|!=|<=|>=|[-+*/=<>(){}\[\],.:;@|])"""
)


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int

    def is_(self, *words: str) -> bool:
        return self.kind in ("word", "sign") and self.value.upper() in words


class SyntaxProblem(ValueError):
    """A statement that can't be read, with the place where reading stopped."""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup or ""
        if kind != "space":
            value = m.group()
            out.append(Token(kind, value[1:-1].replace("''", "'") if kind == "text" else value, at))
        at = m.end()
    out.append(Token("end", "", at))
    return out
