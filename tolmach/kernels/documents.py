"""XLIFF 1.2 and Qt Linguist files: units out, edits in.

A unit is a row in the order of the file; its slot says where its translation lies
or would be inserted, so writing needs no second parse of the tree.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from .elements import Element, ParseError, attributes, elements, indent_before, newline_of
from .markup import fragment_error, plain_text
from .splice import Edit, drop_attribute, get_attribute, set_attribute, splice

#: Native states of units that are no longer part of a file (fixed values).
OBSOLETE = ("vanished", "obsolete")


def format_of(name: str) -> str:
    """xliff or qtts, by the ending of a file's name."""
    lower = name.lower()
    if lower.endswith(".ts"):
        return "qtts"
    if lower.endswith((".xlf", ".xliff")):
        return "xliff"
    raise ParseError(f"unsupported file {name!r}")


def unit_key(*parts: str) -> str:
    """A key that stays as long as what identifies the unit stays."""
    return hashlib.sha256("\x1f".join(parts).encode("utf-8", "surrogatepass")).hexdigest()[:24]


class _Keys:
    """Repeated keys get -1, -2 ... in the order of the file."""

    def __init__(self) -> None:
        self.seen: Counter[str] = Counter()

    def take(self, key: str) -> str:
        self.seen[key] += 1
        return key if self.seen[key] == 1 else f"{key}-{self.seen[key] - 1}"


def _trimmed(fragment: str) -> str:
    return (plain_text(fragment) or "").strip()


def _unit(data: bytes, whole: Element, slot: Element | None, after: int, indent: str, /, **values) -> dict:
    found = {"exists": slot is not None, "insert_at": 0 if slot else after, "indent": indent}
    for name, span in (("elem", (slot.start, slot.end) if slot else (0, 0)), ("attrs", slot.attrs if slot else (0, 0)), ("inner", slot.inner if slot else (0, 0))):
        found[name] = {"start": span[0], "end": span[1]}
    return values | {"unit_span": {"start": whole.start, "end": whole.end}, "slot": found, "unit_attrs": {"start": whole.attrs[0], "end": whole.attrs[1]}}


def _width(values: dict[str, str]) -> int:
    raw = values.get("maxwidth", "").strip()
    if values.get("size-unit", "") not in ("", "char") or not raw.lstrip("+").isascii() or not raw.lstrip("+").isdigit():
        return 0
    return int(raw)


def read_xliff(source: bytes) -> tuple[dict[str, str], list[dict]]:
    """The languages and the units of an XLIFF 1.2 file."""
    table = elements(source)
    raw = lambda span: source[span[0] : span[1]].decode()
    if not any(e.name == "xliff" for e in table):
        raise ParseError("xliff: no <xliff> root element")
    langs: dict[str, str] = {}
    units, keys, original = [], _Keys(), ""
    inside = -1  # end of the unit that was read last: what it holds is its own
    for item in table:
        if item.start < inside:
            continue
        if item.name == "file":
            values = attributes(source, item)
            original = values.get("original", "")
            pair = values.get("source-language", ""), values.get("target-language", "")
            if not langs.get("source"):
                langs = {"source": pair[0], "target": pair[1]}
            elif pair[0] != langs["source"] or pair[1] and langs["target"] and pair[1] != langs["target"]:
                raise ParseError("xliff: <file> elements disagree on the languages")
        elif item.name == "trans-unit":
            inside = item.end
            values = attributes(source, item)
            ident = values.get("id", "")
            key = keys.take(unit_key("xliff", original, ident))  # a unit that is left out takes its number too
            children = [table[i] for i in item.children]
            last = {c.name: c for c in children}
            text = last.get("source")
            if values.get("translate") == "no" or text is None and "target" not in last:
                continue
            target = last.get("target")
            notes = [n for c in children if c.name == "note" and (n := _trimmed(raw(c.inner)))]
            units.append(
                _unit(source, item, target, text.end if text else 0, indent_before(source, text.start) if text else "", unit_key=key, context=f"{original} / {ident}" if ident else original,
                      source=raw(text.inner) if text else "", targets=[raw(target.inner) if target else ""], plural=False, notes=notes, max_width=_width(values),
                      native_state=attributes(source, target).get("state", "") if target else "")
            )
    return langs, [{"ordinal": i} | u for i, u in enumerate(units)]


def plural_forms(source: bytes, table: list[Element], item: Element) -> list[str]:
    """Raw text of every plural form below an element, in order; forms within a form are part of it."""
    out, done = [], -1
    for e in table:
        if e.name == "numerusform" and item.inner[0] <= e.start < item.inner[1] and e.start >= done:
            out.append(source[e.inner[0] : e.inner[1]].decode())
            done = e.end
    return out


def read_qtts(source: bytes) -> tuple[dict[str, str], list[dict]]:
    """The languages and the units of a Qt Linguist file."""
    table = elements(source)
    raw = lambda span: source[span[0] : span[1]].decode()
    roots = [e for e in table if e.name == "TS"]
    if not roots:
        raise ParseError("qtts: no <TS> root element")
    values = attributes(source, roots[-1])
    langs = {"source": values.get("sourcelanguage", ""), "target": values.get("language", "")}
    units, keys, context, inside = [], _Keys(), "", -1
    for number, item in enumerate(table):
        if item.start < inside:
            continue
        if item.name == "name":
            context, inside = _trimmed(raw(item.inner)), item.end
        elif item.name == "message":
            inside = item.end
            values = attributes(source, item)
            children = [table[i] for i in item.children]
            last = {c.name: c for c in children}
            text = raw(last["source"].inner) if "source" in last else ""
            comment = raw(last["comment"].inner) if "comment" in last else ""
            ident = values.get("id", "") or text
            if not ident:
                continue
            plural = values.get("numerus") == "yes"
            slot = last.get("translation")
            below = table[number : number + 1 + _size(table, number)]
            targets = (plural_forms(source, below, slot) if plural else [raw(slot.inner)]) if slot else []
            notes = [n for c in children if c.name in ("comment", "extracomment", "translatorcomment") and (n := _trimmed(raw(c.inner)))]
            units.append(
                _unit(source, item, slot, children[-1].end if children else item.inner[0], indent_before(source, last["source"].start) if "source" in last else "",
                      unit_key=keys.take(unit_key("ts", context, ident, comment)), context=context, source=text, targets=targets or [""], plural=plural, notes=notes, max_width=0,
                      native_state=attributes(source, slot).get("type", "") if slot else "")
            )
    return langs, [{"ordinal": i} | u for i, u in enumerate(units)]


def _size(table: list[Element], number: int) -> int:
    """How many elements lie within one."""
    end, n = table[number].end, 0
    while number + 1 + n < len(table) and table[number + 1 + n].start < end:
        n += 1
    return n


READERS = {"xliff": read_xliff, "qtts": read_qtts}


def read(name: str, source: bytes) -> tuple[dict[str, str], list[dict]]:
    """Languages and units of a file of either format."""
    return READERS[format_of(name)](source)


#: How states are written in XLIFF (fixed values); any other is the last.
XLIFF_STATES = {"approved": "translated", "untranslated": "needs-translation", "": "needs-review-translation"}


def _check(unit: dict | None, key: str, kind: str, targets: list[str]) -> None:
    if unit is None:
        raise ValueError(f"{kind}: no entry with key {key!r}")
    if not targets or kind == "xliff" and len(targets) != 1:
        raise ValueError(f"{kind}: {len(targets)} targets for one entry")
    for t in targets:
        if error := fragment_error(t):
            raise ValueError(error)


def edits(kind: str, source: bytes, units: list[dict], updates: list[tuple[str, list[str], str]]) -> list[Edit]:
    """The edits that write updates (key, targets, state) into a file; the last of a key counts."""
    by_key = {u["unit_key"]: u for u in units}
    line = newline_of(source)
    out: list[Edit] = []
    for key, targets, state in {u[0]: u for u in updates}.values():
        unit = by_key.get(key)
        _check(unit, key, kind, targets)
        assert unit is not None
        slot = unit["slot"]
        raw = source[slot["attrs"]["start"] : slot["attrs"]["end"]].decode() if slot["exists"] else ""
        if kind == "xliff":
            raw = set_attribute(raw, "state", XLIFF_STATES.get(state, XLIFF_STATES[""]))
            made = f"<target{raw}>{targets[0]}</target>" if targets[0] else f"<target{raw}/>"
            at = unit["unit_attrs"]
            before = source[at["start"] : at["end"]].decode()
            after = set_attribute(before, "approved", "yes") if state == "approved" else drop_attribute(before, "approved")
            if after != before:
                out.append((at["start"], at["end"], after.encode()))
        else:
            if get_attribute(raw, "type") not in OBSOLETE:
                raw = drop_attribute(raw, "type") if state == "approved" else set_attribute(raw, "type", "unfinished")
            body = "".join(f"<numerusform>{t}</numerusform>" for t in targets) if unit["plural"] else targets[0]
            made = f"<translation{raw}>{body}</translation>"
        if slot["exists"]:
            out.append((slot["elem"]["start"], slot["elem"]["end"], made.encode()))
        else:
            out.append((slot["insert_at"], slot["insert_at"], f"{line}{slot['indent']}{made}".encode()))
    return out


def write(name: str, source: bytes, updates: list[tuple[str, list[str], str]]) -> bytes:
    """A file with updates written; without any it comes back unchanged."""
    if not updates:
        return source
    kind = format_of(name)
    return splice(source, edits(kind, source, READERS[kind](source)[1], updates))
