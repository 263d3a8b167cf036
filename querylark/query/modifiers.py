"""The run of inline modifiers at a query's end: return, limit, offset, sort, array, matches, min() and max()."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_NAME = re.compile(r"[\w.\-]+")


@dataclass
class Modifiers:
    query: str
    limit: int | None = None
    offset: int | None = None
    fields: list[str] | None = None
    sort: tuple[str, bool] | None = None  # name, descending
    array: int | None = None
    matches: bool | None = None
    least: list[str] = field(default_factory=list)
    most: list[str] = field(default_factory=list)


class _NoRun(Exception):
    pass


def _opens(token: str) -> bool:
    return token in ("return", "limit", "offset", "sort", "array", "matches") or token.startswith(("min(", "max("))


def _names(text: str) -> list[str]:
    names = [n.strip() for n in text.split(",") if n.strip()]
    if not names or not all(_NAME.fullmatch(n) for n in names):
        raise _NoRun
    return names


def _run(tokens: list[str]) -> Modifiers:
    out, i, seen = Modifiers(""), 0, set()

    def word(at: int) -> str:
        if at >= len(tokens):
            raise _NoRun
        return tokens[at]

    while i < len(tokens):
        t = tokens[i]
        if t[:4] in ("min(", "max("):
            text = t[4:]
            while not text.endswith(")"):
                if not text.endswith(","):
                    raise _NoRun
                i += 1
                text += word(i)
            (out.least if t.startswith("min") else out.most).extend(_names(text[:-1]))
            i += 1
            continue
        if t in seen or not _opens(t):
            raise _NoRun
        seen.add(t)
        if t in ("limit", "offset", "array"):
            if not re.fullmatch(r"\+?[0-9]+", word(i + 1)):
                raise _NoRun
            setattr(out, t, int(tokens[i + 1]))
            i += 2
        elif t == "matches":
            said = {"on": True, "true": True, "off": False, "false": False}.get(word(i + 1))
            if said is None:
                raise _NoRun
            out.matches = said
            i += 2
        elif t == "sort":
            name, colon, order = word(i + 1).partition(":")
            i += 2
            if not colon and i < len(tokens) and tokens[i].lower() in ("asc", "desc"):
                order = tokens[i]
                i += 1
            if not _NAME.fullmatch(name) or (colon or order) and order.lower() not in ("asc", "desc"):
                raise _NoRun
            out.sort = (name, order.lower() == "desc")
        else:  # return: up to the next clause
            end = i + 1
            while end < len(tokens) and not _opens(tokens[end]):
                end += 1
            own = tokens[i + 1 : end]
            if any(not a.endswith(",") and not b.startswith(",") for a, b in zip(own, own[1:])):
                raise _NoRun
            out.fields = _names("".join(own))
            i = end
    return out


def split(text: str) -> Modifiers:
    """The query and its modifiers. Keywords count only in an unbroken run to the end with some query before it; the longest run
    wins, and anything else is query text."""
    tokens = text.split()
    for start in range(1, len(tokens)):
        if _opens(tokens[start]):
            try:
                found = _run(tokens[start:])
            except _NoRun:
                continue
            found.query = " ".join(tokens[:start])
            return found
    return Modifiers(text)
