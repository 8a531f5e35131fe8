"""One consistent form for text that looks the same.

First, per character: full-width forms, ligatures and mathematical letters become ordinary characters,
accents join the letter they belong to, ignorable characters go (a joiner within an
emoji stays), every space becomes the plain one. Then, per word: each letter may
stand for itself or for a like-shaped letter of another script; a Viterbi search
over this lattice finds the reading that a character bigram model of each script
explains best, with a price for each replaced letter and a high one for changing
the script within a word. A word that could wholly be read in another script is
judged where the nearest clear words to either side, as far away as they may be, are in
that script; at the start or end of a text the one side decides.

The model is counted over all texts given; it has at most one number for each pair
of letters of the three scripts.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of one shape, in the order Latin, Cyrillic, Greek; a dot where a script has none.
SHAPES = (
    "AАΑ BВΒ CС. EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ SЅ. TТΤ XХΧ YУΥ Z.Ζ "
    "aаα cсς eе. iіι jј. kкκ oоο pрρ sѕ. u.υ v.ν xхχ yу. hһ. n.η mм. tтτ bЬ. rг. lӏ. ëё. ïї."
).split()
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
_SPAN = 0x530
_LATIN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]")
_OTHER = re.compile(r"[Ͱ-ԯ]")


@functools.cache
def _alike() -> dict[str, tuple[str, ...]]:
    table: dict[str, tuple[str, ...]] = {}
    for shape in SHAPES:
        letters = [c for c in shape if c != "."]
        for c in letters:
            table[c] = table.get(c, ()) + tuple(x for x in letters if x != c)
    return table


@functools.lru_cache(4096)
def script_of(letter: str) -> int:
    """Place in SCRIPTS, or -1."""
    code = ord(letter)
    if code < 0x250:
        return 0 if letter.isalpha() else -1
    if 0x370 <= code < 0x400:
        return 2 if letter.isalpha() else -1
    if 0x400 <= code < _SPAN:
        return 1 if letter.isalpha() else -1
    return 0 if 0x1E00 <= code < 0x1F00 else -1


@functools.cache
def _character_tables() -> tuple[dict[int, str], frozenset[str], frozenset[str]]:
    """Full forms to ordinary ones; invisible characters; spaces that are not plain."""
    full, hidden, spaces = {}, {"\u034f", "\u115f", "\u1160", "\u17b4", "\u17b5", "\u3164", "\uffa0", *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))}, {"\x0b", "\x0c", "\x85"}
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0080)]:
        c = chr(code)
        kind, tag = unicodedata.category(c), unicodedata.decomposition(c).partition(">")[0]
        if kind == "Cf":
            hidden.add(c)
        elif kind in ("Zs", "Zl", "Zp"):
            spaces.add(c)
        elif c not in hidden and (tag in ("<wide", "<narrow") or tag == "<font" and code >= 0x1D400 or tag == "<compat" and "LIGATURE" in unicodedata.name(c, "")):
            full[code] = unicodedata.normalize("NFKC", c)
    return full, frozenset(hidden), frozenset(spaces)


@functools.cache
def _patterns() -> tuple[re.Pattern, ...]:
    full, hidden, spaces = _character_tables()
    def group(chars: set[str] | frozenset[str]) -> str:
        """A character class of as few ranges as can be, which is searched much faster."""
        codes, parts = sorted(map(ord, chars)), []
        for code in codes:
            if parts and parts[-1][1] == code - 1:
                parts[-1][1] = code
            else:
                parts.append([code, code])
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "]"

    single = "".join(c for c in _alike() if c.isalpha())
    return (
        re.compile(group({chr(c) for c in full})),
        re.compile(group(hidden)),
        re.compile(group(spaces)),
        re.compile(r"[^\W\d_][\u0300-\u036f҃-҇\u1ab0-᫿\u1dc0-\u1dff]+"),
        re.compile(r"[A-Za-zÀ-ɏḀ-ỿ][Ͱ-ԯ]|[Ͱ-ԯ][A-Za-zÀ-ɏḀ-ỿ]|[Ͱ-Ͽ][Ѐ-ԯ]|[Ѐ-ԯ][Ͱ-Ͽ]"),
        re.compile(rf"(?<![^\W_])[{single}]+(?![^\W_])"),
        re.compile(r"[^\W\d_]+"),
    )


def _emoji(c: str) -> bool:
    return c in "\ufe0f\u200d" or 0x1F000 <= ord(c) < 0x20000 or 0x2190 <= ord(c) < 0x2C00 and unicodedata.category(c) == "So"


def _drop_hidden(text: str, hidden: re.Pattern) -> str:
    out, at = [], 0
    for m in hidden.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        joins = m[0] == "\u200d" and before and after and _emoji(before) and _emoji(after)
        if joins or m[0] == "\ufe0f" and before and _emoji(before):
            continue
        out.append(text[at : m.start()])
        at = m.end()
    return text if not at else "".join(out) + text[at:]


class Reader:
    """Plain forms of texts, given log probabilities of letter pairs."""

    def __init__(self, pairs: dict[tuple[int, int], int], replace: float = 3.0, change: float = 18.0, foreign: float = 3.0):
        self.replace, self.change, self.foreign = replace, change, foreign
        self.pairs = pairs
        self.after: dict[tuple[int, int], int] = {}
        for (a, b), n in pairs.items():
            for s in range(3) if not b else (self._script(b),):
                self.after[a, s] = self.after.get((a, s), 0) + n
        self.known: dict[tuple[str, int], str] = {}

    @staticmethod
    def _script(code: int) -> int:
        return script_of(chr(code))

    def _step(self, a: int, b: int, script: int) -> float:
        return math.log((self.pairs.get((a, b), 0) + 0.05) / (self.after.get((a, script), 0) + 5.0))

    def reading(self, word: str, home: int) -> str:
        """The best reading of a word, remembered."""
        if (word, home) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word, home] = self._search(word, home)
        return self.known[word, home]

    def _search(self, word: str, home: int) -> str:
        """The best reading of a word of letters; ``home`` is the script around it, or -1."""
        alike = _alike()
        states: dict[tuple[int, int], tuple[float, str]] = {}
        for place, letter in enumerate(word):
            now: dict[tuple[int, int], tuple[float, str]] = {}
            for option in (letter, *alike.get(letter, ())):
                script, code = script_of(option), ord(option.lower()) if len(option.lower()) == 1 else ord(option)
                if script < 0:
                    continue
                price = 0.0 if option == letter else self.replace
                if not place:
                    best = (self._step(0, code, script) - price - (self.foreign if home >= 0 and script != home else 0.0), option)
                else:
                    best = max(
                        ((score + (self._step(prev, code, script) if s == script else self._step(0, code, script) - self.change) - price, path + option) for (s, prev), (score, path) in states.items()),
                        key=lambda x: x[0],
                    )
                if (script, code) not in now or best[0] > now[script, code][0]:
                    now[script, code] = best
            if not now:
                return word
            states = now
        return max(((score + self._step(code, 0, script), path) for (script, code), (score, path) in states.items()), key=lambda x: x[0])[1]

    def plain(self, text: str) -> str:
        """The consistent form; equal to ``text`` where there is nothing to change."""
        full, hidden, spaces, marks, mixed, alone, letters = _patterns()
        if text.isascii() and "\x0b" not in text and "\x0c" not in text:
            return text
        made = full.sub(lambda m: _character_tables()[0][ord(m[0])], text)
        made = _drop_hidden(made, hidden)
        made = spaces.sub(" ", made)
        made = marks.sub(lambda m: c if len(c := unicodedata.normalize("NFC", m[0])) < len(m[0]) else m[0], made)
        if not _OTHER.search(made) or not _LATIN.search(made):
            return made
        changes: dict[int, tuple[int, str]] = {}
        if mixed.search(made):
            for m in letters.finditer(made):
                if mixed.search(m[0]):
                    changes[m.start()] = m.end(), self.reading(m[0], -1)
        whole = [m for m in alone.finditer(made) if m.start() not in changes]
        around = [(m.start(), script) for m in letters.finditer(made) if (script := self._clear(m[0])) is not None] if whole else []
        places = [start for start, _ in around]
        for m in whole:
            word, start, end = m[0], m.start(), m.end()
            if len(word) == 1 and not word.islower():
                continue  # a unit or an initial, which any script may hold
            if start and made[start - 1] in "<\\%/." or made[end : end + 1] in (">", ":"):
                continue  # part of markup, of a path or of a placeholder
            at = bisect.bisect_left(places, start)
            near = {script for _, script in around[max(0, at - 1) : at + 1]}  # a word that is judged is never clear itself
            if len(near) != 1:
                continue
            home = near.pop()
            if home in {script_of(c) for c in word}:
                continue
            read = self.reading(word, home)
            if all(script_of(c) == home for c in read):
                changes[start] = end, read
        out, at = [], 0
        for start in sorted(changes):
            out += [made[at:start], changes[start][1]]
            at = changes[start][0]
        return "".join(out) + made[at:]

    @staticmethod
    def _clear(word: str) -> int | None:
        """The script of a word that has only one and could not be read in another."""
        found = {script_of(c) for c in word}
        return found.pop() if len(found) == 1 and not all(c in _alike() for c in word) else None


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SPAN * _SPAN, np.int64)
    letter = np.array([script_of(chr(c)) + 1 for c in range(_SPAN)], np.int8)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        if not texts:
            continue
        codes = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < _SPAN, codes, 0).astype(np.int64)
        script = letter[codes]
        codes[script == 0] = 0
        a, b, s, t = codes[:-1], codes[1:], script[:-1], script[1:]
        good = ((s == t) | (s == 0) | (t == 0)) & ((s > 0) | (t > 0))
        total += np.bincount(a[good] * _SPAN + b[good], minlength=_SPAN * _SPAN)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])


def pair_counts(texts: DataFrame) -> dict[tuple[int, int], int]:
    """How often each letter follows another within a script, over all texts of a one-column table."""
    rows = texts.mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # one row per pair of letters
    return {(r["pair"] // _SPAN, r["pair"] % _SPAN): r["n"] for r in rows}


def _altered(reader: Reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            made = [reader.plain(t) if t else t for t in texts]
            at = pa.array([i for i, (a, b) in enumerate(zip(texts, made, strict=True)) if a != b], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(made, pa.string()).take(at)], names=["tbl", "id", "plain"])

    return run


def altered(df: DataFrame) -> DataFrame:
    """Rows (tbl int, id long, text) whose consistent form differs: (tbl, id, plain), each once.

    Null and empty texts are never altered; a blank text is, if it holds an invisible
    character or another space. Words really written in another script stay.
    """
    rows = df.select("tbl", "id", "text").where(F.length("text") > 0)
    reader = Reader(pair_counts(rows.select("text")))
    # plain ASCII has one form; only two of its spaces are not plain
    return rows.where(F.regexp_like("text", F.lit(r"[^\x00-\x7f]|\x0b|\x0c"))).mapInArrow(_altered(reader), "tbl int, id long, plain string").distinct()
