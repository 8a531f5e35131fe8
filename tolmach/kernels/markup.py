"""Fragments of inner XML: visible text, well-formedness, inline elements, placeholders.

Plain Python without Spark; the functions in ``functions.markup`` run these over Arrow
batches. A fragment is parsed by expat inside a wrapper element; named HTML references,
which expat does not know, are rewritten to numeric ones first.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint
from xml.parsers import expat

_XML_NAMES = frozenset(("amp", "lt", "gt", "quot", "apos"))
_REFERENCE = re.compile(r"<!\[CDATA\[.*?\]\]>|&([A-Za-z][A-Za-z0-9]*);", re.DOTALL)
#: Inline elements of XLIFF 1.2 that stand for markup or a variable (fixed values).
INLINE = frozenset(("x", "bx", "ex", "g", "ph", "bpt", "ept", "it"))


def _numeric(match: re.Match) -> str:
    name = match[1]
    if name is None or name in _XML_NAMES or name not in name2codepoint:
        return match[0]
    return f"&#{name2codepoint[name]};"


_START_TAG = re.compile(r"<([^\s<>/!?]+)((?:\s+[^\s=<>\"'/]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))+)(\s*/?)>")
_ATTRIBUTE = re.compile(r"\s+([^\s=<>\"'/]+)\s*=\s*(?:\"[^\"<]*\"|'[^'<]*')")


def _once(fragment: str) -> str:
    """A fragment in whose start tags each attribute stands once, the last of a name staying: expat refuses repeated ones."""

    def kept(tag: re.Match) -> str:
        last = {m[1]: m[0] for m in _ATTRIBUTE.finditer(tag[2])}
        return f"<{tag[1]}{''.join(last.values())}{tag[3]}>"

    return _START_TAG.sub(kept, fragment)


def _parse(fragment: str, text: list[str] | None = None, starts: list[tuple[str, dict]] | None = None) -> str | None:
    """Feeds the given lists; the error of a malformed fragment, or None. Lists keep what came before an error."""
    kept = [len(x) if x is not None else 0 for x in (text, starts)]
    error = _feed(fragment, text, starts)
    if error is not None and error.code == expat.errors.codes[expat.errors.XML_ERROR_DUPLICATE_ATTRIBUTE]:
        for x, n in zip((text, starts), kept, strict=True):
            if x is not None:
                del x[n:]
        error = _feed(_once(fragment), text, starts)
    return None if error is None else f"translation is not well-formed XML: {error}"


def _feed(fragment: str, text: list[str] | None, starts: list[tuple[str, dict]] | None) -> expat.ExpatError | None:
    parser = expat.ParserCreate("utf-8")
    depth = 0

    def start(name: str, attributes: dict) -> None:
        nonlocal depth
        depth += 1
        if starts is not None and depth > 1:
            starts.append((name.rpartition(":")[2], attributes))

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler = start, end
    if text is not None:
        parser.CharacterDataHandler = text.append
    try:
        parser.Parse(f"<w>{_REFERENCE.sub(_numeric, fragment)}</w>".encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as error:
        return error
    return None


def plain_text(fragment: str | None) -> str | None:
    """What a reader sees: character data with references decoded. A malformed fragment comes back as it is."""
    if fragment is None or ("<" not in fragment and "&" not in fragment and "\r" not in fragment):
        return fragment
    text: list[str] = []
    return fragment if _parse(fragment, text=text) else "".join(text)


def fragment_error(fragment: str | None) -> str | None:
    """Why a fragment is not well-formed, or None; the wrapper must close once, at the end."""
    return None if fragment is None else _parse(fragment)


def quoted(text: str) -> str:
    """A text in double quotes, with what is not printable escaped as in findings' messages."""
    out = []
    for c in text:
        if c in '"\\':
            out.append("\\" + c)
        elif c == " " or c.isprintable() and not c.isspace():
            out.append(c)
        elif c in "\a\b\f\n\r\t\v":
            out.append(repr(c)[1:-1] if c not in "\a\b\f\v" else {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v"}[c])
        else:
            out.append(f"\\x{ord(c):02x}" if ord(c) < 0x80 else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}")
    return '"' + "".join(out) + '"'


def _inline_names(starts: list[tuple[str, dict]]) -> list[str]:
    found = []
    for name, attributes in starts:
        if name in INLINE:
            ident = next((v for k, v in reversed(attributes.items()) if k.rpartition(":")[2] == "id"), "")
            found.append(f"<{name} id={quoted(ident)}>" if ident else f"<{name}>")
    return found


def inline_elements(fragment: str | None) -> list[str]:
    """Names of inline elements in order, with their id where they have one; up to the first error."""
    if not fragment or "<" not in fragment:
        return []
    starts: list[tuple[str, dict]] = []
    _parse(fragment, starts=starts)
    return _inline_names(starts)


# Placeholder syntaxes (fixed values): the two dialects differ in what a number after the sign means.
_LENGTH = "(?:hh|h|ll|l|L|z|j|t|q)?"
_NAMED = r"%\([A-Za-z_][A-Za-z0-9_]*\)[-+#0]*[0-9.]*[diouxXeEfgGaAcs@]"
_PLACED = rf"%[0-9]+\$[-+#0]*[0-9.]*{_LENGTH}[@diouxXeEfgGaAcsp]"
_PRINTF = rf"%[-+#0]*[0-9.*]*{_LENGTH}[@diouxXeEfgGaAcsp]"
_ARGUMENT = r"%L?[0-9]{1,2}"
_COUNT = "%n"
PERCENT = {
    "generic": "|".join(("%%", _NAMED, _PLACED, _PRINTF, _ARGUMENT, _COUNT)),
    "qt": "|".join(("%%", _PLACED, _ARGUMENT, _COUNT, _NAMED, _PRINTF)),
}
_SCAN = {dialect: re.compile(rf"({pattern})|\{{") for dialect, pattern in PERCENT.items()}
_IDENT = r"[A-Za-z_][A-Za-z0-9_.]*"
_DOUBLE = re.compile(r"\{\{(.*?)\}\}", re.DOTALL)
_TIGHT = re.compile(rf"(?:{_IDENT}|[0-9]+)\Z")
_NAME = re.compile(rf"{_IDENT}\Z")
_MESSAGE = re.compile(rf"({_IDENT})\s*,")


def _group_end(text: str, at: int) -> int:
    """Where the brace group that opens at ``at`` ends, or -1."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


def _brace(text: str, at: int) -> tuple[str, int]:
    """The placeholder of a brace group, or "", and where to go on."""
    if text.startswith("{{", at):
        group = _DOUBLE.match(text, at)
        if not group:
            return "", at + 1
        name = group[1].strip()
        return ("{{" + name + "}}" if _NAME.match(name) else ""), group.end()
    end = _group_end(text, at)
    if end < 0:
        return "", at + 1
    inner = text[at + 1 : end - 1]
    if _TIGHT.match(inner):
        return "{" + inner + "}", end
    message = _MESSAGE.match(inner.strip())
    return ("{" + message[1] + "}" if message else ""), end


def text_placeholders(text: str, dialect: str = "generic") -> list[str]:
    """Placeholders of visible text, in order; an escaped sign is none, nested message text is not searched."""
    found, at, scan = [], 0, _SCAN[dialect]
    while m := scan.search(text, at):
        if m[1]:
            at = m.end()
            if m[1] != "%%":
                found.append(m[1])
        else:
            name, at = _brace(text, m.start())
            if name:
                found.append(name)
    return found


def read_fragment(fragment: str | None, dialect: str = "generic") -> tuple[str | None, list[str]]:
    """Visible text and all placeholders of a fragment by one parse: inline elements first, then those of its text."""
    if not fragment or ("<" not in fragment and "&" not in fragment and "\r" not in fragment):
        return fragment, text_placeholders(fragment, dialect) if fragment else []
    text: list[str] = []
    starts: list[tuple[str, dict]] = []
    plain = fragment if _parse(fragment, text, starts) else "".join(text)
    return plain, _inline_names(starts) + text_placeholders(plain, dialect)


def placeholders(fragment: str | None, dialect: str = "generic") -> list[str]:
    """All placeholders of a fragment."""
    return read_fragment(fragment, dialect)[1]


def percent_kind(name: str) -> str:
    """qt for numbered arguments and the count, else printf."""
    return "qt" if re.fullmatch(r"%(?:L?[0-9]{1,2}|n)", name) else "printf"


def strip_fence(answer: str) -> str:
    """A model's answer without the Markdown fence around it."""
    body = answer.strip()
    fenced = re.fullmatch(r"```[^\n`]*\n(.*?)\n?```", body, re.DOTALL)
    return fenced[1].strip() if fenced else body
