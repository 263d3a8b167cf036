"""Addresses as 32 hexadecimal digits of their IPv6 form, so that string order is address order."""

from __future__ import annotations

import ipaddress

V4 = "0" * 20 + "ffff"
V4_LOW, V4_HIGH = V4 + "0" * 8, V4 + "f" * 8


def key(text: str) -> str | None:
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return V4 + f"{int(a):08x}" if a.version == 4 else f"{int(a):032x}"


def block(text: str) -> tuple[str, str] | None:
    """First and last key of a CIDR block; host bits don't count."""
    if "/" not in text:
        return None
    try:
        n = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None
    if n.version == 4:
        return V4 + f"{int(n.network_address):08x}", V4 + f"{int(n.broadcast_address):08x}"
    return f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}"


def is_v4(k: str) -> bool:
    return k.startswith(V4)


def prefix_block(text: str) -> str | None:
    """The CIDR block that a dotted prefix such as 10.1. stands for, to be named in a note."""
    parts = [p for p in text.rstrip("*").split(".") if p]
    if not 1 <= len(parts) <= 3 or not all(p.isdigit() and int(p) < 256 for p in parts):
        return None
    return ".".join([*parts, *["0"] * (4 - len(parts))]) + f"/{8 * len(parts)}"
