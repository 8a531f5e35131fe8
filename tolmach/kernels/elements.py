"""A file's elements as one flat table with byte spans.

Readers of file formats are written as selections from this table, so parsing, checking
of well-formedness and spans live in one place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.entities import name2codepoint

from .markup import _XML_NAMES

_TOKEN = re.compile(
    rb"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<pi>.*?)\?>|<!(?P<decl>(?:[^<>\[\"']|\"[^\"]*\"|'[^']*'|\[.*?\]|<[^<>]*>)*)>"
    rb"|</(?P<close>[^\s<>/]+)\s*>|<(?P<open>[^\s<>/!?][^\s<>/]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*?)(?P<empty>/?)>",
    re.DOTALL,
)
_ATTR = re.compile(rb"""([^\s=<>"'/]+)\s*=\s*("[^"]*"|'[^']*')""")
_AMPERSAND = re.compile(rb"&(?:#[0-9]+|#x[0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));|&")


class ParseError(ValueError):
    """A file that cannot be read as its format."""


@dataclass(slots=True)
class Element:
    """One element: spans are half-open byte ranges of the file."""

    name: str
    parent: int
    start: int
    attrs: tuple[int, int]
    inner: tuple[int, int] = (0, 0)
    end: int = 0
    children: list[int] = field(default_factory=list)


def _check_text(text: bytes) -> None:
    for m in _AMPERSAND.finditer(text):
        name = m[1].decode() if m[1] else None
        if len(m[0]) == 1 or name and name not in _XML_NAMES and name not in name2codepoint:
            raise ParseError(f"invalid character entity {m[0].decode()!r}")


def elements(source: bytes) -> list[Element]:
    """All elements in the order of their start tags; malformed markup is an error."""
    found: list[Element] = []
    stack: list[int] = []
    at = 0
    while (mark := source.find(b"<", at)) >= 0:
        _check_text(source[at:mark])
        m = _TOKEN.match(source, mark)
        if not m:
            raise ParseError(f"malformed markup at byte {mark}")
        at = m.end()
        if m["open"] is not None:
            attrs_end = m.end() - 1 - len(m["empty"])
            item = Element(m["open"].decode().rpartition(":")[2], stack[-1] if stack else -1, mark, (m.start("attrs"), attrs_end), (at, at), at)
            _check_text(m["attrs"])
            if stack:
                found[stack[-1]].children.append(len(found))
            if not m["empty"]:
                stack.append(len(found))
            found.append(item)
        elif m["close"] is not None:
            name = m["close"].decode().rpartition(":")[2]
            if not stack or found[stack[-1]].name != name:
                raise ParseError(f"unexpected </{name}> at byte {mark}")
            item = found[stack.pop()]
            item.inner, item.end = (item.inner[0], mark), at
    _check_text(source[at:])
    if stack:
        raise ParseError(f"<{found[stack[-1]].name}> is not closed")
    return found


def attributes(source: bytes, item: Element) -> dict[str, str]:
    """Attributes by local name, references decoded; of a repeated name the first counts."""
    from .markup import plain_text

    out: dict[str, str] = {}
    for m in _ATTR.finditer(source, *item.attrs):
        out.setdefault(m[1].decode().rpartition(":")[2], plain_text(m[2][1:-1].decode()) or "")
    return out


def newline_of(source: bytes) -> str:
    """The line end that a file uses first."""
    at = source.find(b"\n")
    return "\r\n" if at > 0 and source[at - 1 : at] == b"\r" else "\n"


def indent_before(source: bytes, at: int) -> str:
    """Blanks between the start of the line and ``at``; none if anything else stands there."""
    line = source[source.rfind(b"\n", 0, at) + 1 : at]
    return line.decode() if b"\n" in source[:at] and not line.strip(b" \t") else ""
