"""Byte-exact edits: replace spans of a file and copy everything else as it is."""

from __future__ import annotations

import re
from collections.abc import Iterable

Edit = tuple[int, int, bytes]


def splice(source: bytes, edits: Iterable[Edit]) -> bytes:
    """``source`` with each (start, end, new) applied.

    Edits may come in any order; those at one place keep their order. A span that is
    reversed, outside the file or overlaps another is an error.
    """
    parts: list[bytes] = []
    at = 0
    for start, end, new in sorted(edits, key=lambda e: e[0]):
        if not 0 <= start <= end <= len(source):
            raise ValueError(f"edit {start}..{end} lies outside the file of {len(source)} bytes")
        if start < at:
            raise ValueError(f"edit {start}..{end} overlaps the one before, which ends at {at}")
        parts += (source[at:start], new)
        at = end
    return source if not parts else b"".join((*parts, source[at:]))


_ATTRIBUTE = re.compile(r"""(?:(?<=\s)|^)([A-Za-z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*')""")
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def escape_attribute(value: str) -> str:
    """A value for use between double quotes."""
    return re.sub(r'[&<>"]', lambda m: _ESCAPES[m[0]], value)


def unescape_attribute(value: str) -> str:
    """A quoted value as meant; what was escaped twice is decoded once."""
    return re.sub(r"&(amp|lt|gt|quot|apos);", lambda m: _NAMED[m[1]], value)


def _find(raw: str, name: str) -> re.Match | None:
    return next((m for m in _ATTRIBUTE.finditer(raw) if m[1] == name), None)


def get_attribute(raw: str, name: str) -> str | None:
    """The value of an attribute in the raw text of a start tag."""
    found = _find(raw, name)
    return unescape_attribute(found[2][1:-1]) if found else None


def set_attribute(raw: str, name: str, value: str) -> str:
    """Raw attributes with one set; order, spacing and quoting of the others stay."""
    found = _find(raw, name)
    if not found:
        return f'{raw} {name}="{escape_attribute(value)}"'
    return raw[: found.start(2) + 1] + escape_attribute(value) + raw[found.end(2) - 1 :]


def drop_attribute(raw: str, name: str) -> str:
    """Raw attributes without one, and without the blank before it."""
    found = _find(raw, name)
    if not found:
        return raw
    start = found.start() - 1 if found.start() and raw[found.start() - 1].isspace() else found.start()
    return raw[:start] + raw[found.end() :]
