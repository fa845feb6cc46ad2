"""Strings with captures, sets and letter cases put in."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\$(\d)|\{([^{}]+)\}|%([uUlL])")


def expand(text: str, captures: list[str], tags_of: Callable[[str], list[str]]) -> str:
    """``$1`` is a capture, ``{SET}`` the matched tags joined by ``_``; ``%u %l`` change the next letter, ``%U %L`` all that follow."""
    out, case = "", ""
    at = 0

    def put(piece: str) -> None:
        nonlocal out, case
        if not piece:
            return
        if case in ("u", "l"):
            first = piece[0].upper() if case == "u" else piece[0].lower()
            piece, case = first + piece[1:], ""
        elif case:
            piece = piece.upper() if case == "U" else piece.lower()
        out += piece

    for m in _PART.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        if m[1]:
            k = int(m[1]) - 1
            put(captures[k] if 0 <= k < len(captures) else "")
        elif m[2]:
            put("_".join(tags_of(m[2])))
        else:
            case = m[3]
    put(text[at:])
    return out


def expand_column(template: str, text: Column, pattern: str) -> Column:
    """``template`` with the captures of ``pattern`` in ``text``; case marks act on the captures that follow them."""
    pieces: list[Column] = []
    case, at = "", 0
    for m in _PART.finditer(template):
        if m.start() > at:
            pieces.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[3]:
            case = m[3]
        elif m[1]:
            found = F.regexp_extract(text, pattern, int(m[1]))
            if case == "u":
                found, case = F.concat(F.upper(F.substring(found, 1, 1)), found.substr(F.lit(2), F.length(found))), ""
            elif case == "l":
                found, case = F.concat(F.lower(F.substring(found, 1, 1)), found.substr(F.lit(2), F.length(found))), ""
            elif case:
                found = F.upper(found) if case == "U" else F.lower(found)
            pieces.append(found)
    if at < len(template):
        pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)
