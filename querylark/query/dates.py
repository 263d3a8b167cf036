"""Date literals and cells, to whole seconds UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

LEAST, MOST = -9_223_372_036, 9_223_372_036
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
MONTHS |= {m[:3]: i for m, i in list(MONTHS.items())}
_CLOCK = r"(?:[ T](?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:\.\d+)?)?)?"
_MONTH = r"(?P<b>[A-Za-z]{3,9})"
_FORMS = [
    re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_CLOCK}"),
    re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"),
    re.compile(rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}){_CLOCK.replace('[ T]', ' ')}"),
    re.compile(rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}){_CLOCK.replace('[ T]', ' ')}"),
    re.compile(rf"{_MONTH} (?P<d>\d{{1,2}}),? (?P<y>\d{{4}})"),
    re.compile(rf"(?P<d>\d{{1,2}}) {_MONTH} (?P<y>\d{{4}})"),
    re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?"),
]
_OFFSET = re.compile(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})[Tt ](?P<H>\d{2}):(?P<M>\d{2}):(?P<S>\d{2})(?:\.\d+)?(?P<z>[Zz]|[+-]\d{2}:\d{2})")
_MAIL = re.compile(rf"(?:[A-Za-z]{{3}}, )?(?P<d>\d{{1,2}}) {_MONTH} (?P<y>\d{{4}}) (?P<H>\d{{2}}):(?P<M>\d{{2}})(?::(?P<S>\d{{2}}))? (?P<z>[+-]\d{{4}}|GMT|UT|Z)")


def _seconds(g: dict) -> int | None:
    month = MONTHS.get(g["b"].lower()) if g.get("b") else int(g.get("m") or 1)
    if month is None:
        return None
    try:
        at = datetime(int(g["y"]), month, int(g.get("d") or 1), int(g.get("H") or 0), int(g.get("M") or 0), int(g.get("S") or 0), tzinfo=UTC)
    except ValueError:
        return None
    zone = g.get("z")
    if zone and zone[0] in "+-":
        at -= timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:])) * (1 if zone[0] == "+" else -1)
    return int((at - _EPOCH).total_seconds())


def parse(text: str) -> int | None:
    """Seconds since 1970 of a date in any accepted form, clamped; None if it is none. Slashes are month first, dots day first."""
    for form in (_OFFSET, _MAIL, *_FORMS):
        if (m := form.fullmatch(text)) and (s := _seconds(m.groupdict())) is not None:
            return clamp(s)
    if re.fullmatch(r"\d{10,11}", text) and 946_684_800 <= int(text) <= 10_000_000_000:
        return clamp(int(text))
    if m := re.fullmatch(r"(?P<y>\d{4})(?:-(?P<m>\d{2}))?", text):
        s = _seconds(m.groupdict())
        return None if s is None else clamp(s)
    return None


def clamp(seconds: int) -> int:
    return max(LEAST, min(MOST, seconds))


def rfc3339(seconds: int) -> str:
    return (_EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
