"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_KNOWN = "|".join(sorted({*name2codepoint, "apos"}))
_BARE_AMPERSAND = rf"&(?!(?:#[0-9]+|#x[0-9a-fA-F]+|{_KNOWN});)"
#: Steps of the expansion allowance (fixed values): sources up to so many characters, factor.
ALLOWANCE = ((10, 3.0), (20, 2.2), (30, 1.8), (50, 1.6), (70, 1.4))
LONGEST_ALLOWANCE = 1.3
LEAST_BUDGET = 25


def normalize(text: Column) -> Column:
    """White space of any kind collapsed to single blanks and trimmed; case stays."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalized text, in hex."""
    return F.sha2(normalize(text), 256)


def trim_space(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Null or only white space."""
    return F.coalesce(trim_space(text) == "", F.lit(True))


def normalize_fragment(fragment: Column) -> Column:
    """Ampersands that start no known reference are escaped."""
    return F.regexp_replace(fragment, _BARE_AMPERSAND, "&amp;")


def unit_key(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def contains_word(text: Column, term: Column, case_sensitive: Column, lower: Column | None = None) -> Column:
    """Whether a term occurs where no letter, digit or underscore stands before it; endings may follow.

    A plain search comes first, so the pattern is built for the few texts that hold the
    term at all. Where many terms are looked for in one text, ``lower`` is the text in
    lower case, made once.
    """
    hay = F.when(case_sensitive, text).otherwise(F.lower(text) if lower is None else lower)
    needle = F.when(case_sensitive, term).otherwise(F.lower(term))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{Nd}_])\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when((needle == "") | ~F.contains(hay, needle), F.lit(False)).otherwise(F.regexp_like(hay, pattern))


def allowance(length: Column) -> Column:
    """How much longer than a source of that length its translation may be."""
    steps = F.when(length <= ALLOWANCE[0][0], F.lit(ALLOWANCE[0][1]))
    for most, factor in ALLOWANCE[1:]:
        steps = steps.when(length <= most, F.lit(factor))
    return steps.otherwise(F.lit(LONGEST_ALLOWANCE))


def length_budget(length: Column, tolerance: Column) -> Column:
    """Characters a translation may have; the least budget applies before the tolerance, the result is cut to an integer."""
    usual = F.greatest(length.cast("double") * allowance(length), F.lit(float(LEAST_BUDGET)))
    return (usual * tolerance.cast("double")).cast("int")


#: How control characters are written in findings' messages (fixed values).
ESCAPES = {"\a": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r"}
_UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"


def printable(text: Column) -> Column:
    """With whatever is not printable escaped; few texts hold such characters, and only those are taken apart."""
    known = F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in ESCAPES.items())), F.lit("[|]"), F.lit("="))

    def escaped(c: Column) -> Column:
        wide = F.when(c < "\x80", F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).when(F.octet_length(c) < 4, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0")))
        return F.when(F.regexp_like(c, F.lit(_UNPRINTABLE)), F.coalesce(F.try_element_at(known, c), wide, F.concat(F.lit("\\U"), F.lpad(F.lower(F.hex(F.ascii(c))), 8, "0")))).otherwise(c)

    return F.when(F.regexp_like(text, F.lit(_UNPRINTABLE)), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), escaped), "")).otherwise(text)


def quoted(text: Column) -> Column:
    """In double quotes, with quotes and backslashes escaped; a message of such texts is made ``printable`` as a whole."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def dialect(file_format: Column) -> Column:
    """qt for Qt Linguist files, else generic."""
    return F.when(file_format == "qtts", "qt").otherwise("generic")


def percent_placeholders(text: Column, qt: bool = False) -> Column:
    """Placeholders of the percent family in visible text, by one alternation; an escaped sign is none."""
    from ..kernels.markup import PERCENT

    return F.filter(F.regexp_extract_all(text, F.lit(f"({PERCENT['qt' if qt else 'generic']})"), F.lit(1)), lambda x: x != "%%")


def percent_kind(name: Column) -> Column:
    """qt for numbered arguments and the count, else printf."""
    return F.when(F.regexp_like(name, F.lit(r"^%(L?[0-9]{1,2}|n)$")), "qt").otherwise("printf")


def multiset_minus(left: Column, right: Column) -> Column:
    """Sorted items of ``left`` that ``right`` lacks, each as often as it lacks it."""

    def times(items: Column, item: Column) -> Column:
        return F.size(F.filter(items, lambda y: y == item))

    return F.flatten(F.transform(F.array_sort(F.array_distinct(left)), lambda x: F.array_repeat(x, F.greatest(F.lit(0), times(left, x) - times(right, x)))))


#: Native states of units that ask for review (fixed values).
ASKING_STATES = ("needs-adaptation", "needs-l10n", "needs-review-adaptation", "needs-review-l10n", "needs-review-translation", "needs-translation", "new", "unfinished")


def status_from_native(target: Column, native: Column) -> Column:
    """Import state of a target: untranslated, needs_review for the native states that ask for it, else draft."""
    return F.when(is_blank(target), "untranslated").when(native.isin(*ASKING_STATES), "needs_review").otherwise("draft")
