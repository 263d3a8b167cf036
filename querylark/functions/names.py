"""What names say: which identify a document, which are alike, how a value may be spelled. Driver-side, over a few names."""

from __future__ import annotations

import re

_RANKED = [({w}, None) for w in reversed("md5 sha1 sha224 sha256 sha384 sha512".split())]
_HASHES = set("hash digest checksum fingerprint".split())
_UUIDS = ("uuid", "guid")
_IDS = set("id uid identifier".split())
_KEYS = set("key pk".split())
_COUNTERS = set("seq sequence seqno serial no nr num number rownum".split())
UNNAMED = 13


def words(name: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())


def id_rank(name: str) -> int:
    """0 to 13; the lower, the more a name says that its field identifies a document."""
    low, own = name.lower(), words(name)
    if low == "id":
        return 0
    for i, (names, _) in enumerate(_RANKED):
        if names & set(own):
            return 1 + i
    if _HASHES & set(own):
        return 7
    if set(_UUIDS) & set(own) or low.endswith(_UUIDS):
        return 8
    if own and own[-1] in _IDS or low.endswith("id"):
        return 9
    if (_IDS | _KEYS) & set(own):
        return 10
    if _COUNTERS & set(own):
        return 11
    return 12 if "id" in low else UNNAMED


def _tokens(name: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Z]?[^A-Z_.\-\s:/\\]*", name) if t]


def _alike(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a))


def similarity(a: str, b: str) -> float:
    """The larger of token F1 and Dice of padded trigrams."""
    x, y = _tokens(a), _tokens(b)
    hit = sum(any(_alike(t, u) for u in y) for t in x)
    f1 = 2 * hit / len(x) * hit / len(y) / (hit / len(x) + hit / len(y)) if hit else 0.0
    g, h = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (f"_{a.lower()}_", f"_{b.lower()}_"))
    dice = 2 * len(g & h) / (len(g) + len(h)) if g and h else 0.0
    return max(f1, dice)


def suggestions(name: str, known: list[str], most: int = 3, least: float = 0.25) -> list[str]:
    scored = sorted((-similarity(name, k), len(k), k) for k in known)
    return [k for s, _, k in scored if -s >= least][:most]


def spellings(value: str) -> list[str]:
    """As given, lower, first letter, every word, upper."""
    out = [value, value.lower(), value[:1].upper() + value[1:].lower(), " ".join(w[:1].upper() + w[1:].lower() for w in value.split(" ")), value.upper()]
    return list(dict.fromkeys(out))


def compose_id(parts: list) -> str | None:
    return None if any(p is None or p == "" for p in parts) else "|".join(map(str, parts))
