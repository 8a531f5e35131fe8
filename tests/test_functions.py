"""Column functions against tables of cases and against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tolmach.functions import markup, text, vectors


def run(spark, fn, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(fn.alias("x")).collect()]


def test_normalize_and_hash(spark):
    rows = [("  Save the file  ",), ("Save\n  the\tfile",), ("Save \xa0 the  file",), ("",), (None,)]
    assert run(spark, text.normalize(F.col("t")), rows, "t string") == ["Save the file"] * 3 + ["", None]
    hashes = run(spark, text.content_hash(F.col("t")), rows, "t string")
    assert hashes[0] == hashes[1] == hashes[2] and len(hashes[0]) == 64 and hashes[3] != hashes[0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("&Datei", "&amp;Datei"), ("E&xtras", "E&amp;xtras"), ("Fish & Chips", "Fish &amp; Chips"), ("&amp;Datei", "&amp;Datei"), ("a &lt; b", "a &lt; b"), ("&#246;", "&#246;"), ("&#xE4;", "&#xE4;"), ("&nbsp;", "&nbsp;"), ("&amp", "&amp;amp"), ("&nosuch;", "&amp;nosuch;"), ('a <x id="PH"/>', 'a <x id="PH"/>'), ("", "")],
)
def test_normalize_fragment(spark, given, wanted):
    from tolmach.kernels.markup import fragment_error, plain_text

    made = run(spark, text.normalize_fragment(F.col("t")), [(given,)], "t string")[0]
    assert made == wanted and fragment_error(made) is None
    assert plain_text(made) == plain_text(given) or fragment_error(given)


@pytest.mark.parametrize(
    ("hay", "term", "cased", "wanted"),
    [("Größe auf Platte", "Größe", False, True), ("Establish", "tab", False, False), ("Close tab", "tab", False, True), ("Torrentdatei", "Torrent", False, True), ("torrents", "Torrent", False, True), ("torrents", "Torrent", True, False), ("a\\Eb x", "\\Eb", False, False), ("x \\Eb", "\\Eb", False, True), ("abc", "", False, False), ("_tab", "tab", False, False), ("estab tab", "tab", False, True)],
)
def test_contains_word(spark, hay, term, cased, wanted):
    assert run(spark, text.contains_word(F.col("h"), F.col("t"), F.col("c")), [(hay, term, cased)], "h string, t string, c boolean") == [wanted]


def test_length_budget(spark):
    rows = [(n, t) for n in (0, 2, 10, 11, 20, 21, 34, 50, 51, 70, 71, 200) for t in (1.0, 1.100000023841858, 0.5)]
    steps = [(10, 3.0), (20, 2.2), (30, 1.8), (50, 1.6), (70, 1.4)]
    wanted = [int(max(25.0, n * next((f for m, f in steps if n <= m), 1.3)) * t) for n, t in rows]
    assert run(spark, text.length_budget(F.col("n"), F.col("t")), rows, "n int, t double") == wanted


def test_multiset_minus_is_counter_subtraction(spark):
    import random

    random.seed(3)
    rows = [([random.choice("abc") for _ in range(random.randrange(6))], [random.choice("abc") for _ in range(random.randrange(6))]) for _ in range(60)]
    got = run(spark, text.multiset_minus(F.col("a"), F.col("b")), rows, "a array<string>, b array<string>")
    assert got == [sorted((Counter(a) - Counter(b)).elements()) for a, b in rows]


def test_markup_functions_handle_nulls_and_plain_rows(spark):
    df = spark.createDataFrame([("a",), (None,), ("a &amp; <g>%d</g>",), ("& {x}",)], "t string")
    rows = df.select(markup.plain_text(F.col("t")).alias("p"), markup.placeholders(F.col("t"), F.lit("generic")).alias("n"), markup.fragment_error(F.col("t")).isNull().alias("ok")).collect()
    assert [r["p"] for r in rows] == ["a", None, "a & %d", "& {x}"]
    assert [r["n"] for r in rows] == [[], [], ["<g>", "%d"], ["{x}"]]
    assert [r["ok"] for r in rows] == [True, True, True, False]


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 0.0])]
    assert run(spark, vectors.cosine_similarity(F.col("a"), F.col("b")), rows, "a array<float>, b array<float>") == [1.0, 0.0, None, None]
    assert run(spark, vectors.usable(F.col("a"), 2), rows, "a array<float>, b array<float>") == [True, True, False, False]


@pytest.mark.parametrize(("target", "native", "wanted"), [(" ", "new", "untranslated"), ("a", "unfinished", "needs_review"), ("a", "translated", "draft"), ("a", None, "draft"), (None, None, "untranslated")])
def test_status_from_native(spark, target, native, wanted):
    assert run(spark, text.status_from_native(F.col("t"), F.col("n")), [(target, native)], "t string, n string") == [wanted]


def test_quoted_escapes_what_is_not_printable(spark):
    from tolmach.kernels.markup import quoted

    cases = ["a b", 'say "x"', "back\\slash", "tab\tline\nfeed\r", "nbsp\u00a0", "zero\u200bwidth", "\x01\x7f", "emoji 👍 ë", "\U000e0001", "\a\b\f\v", ""]
    assert run(spark, text.printable(text.quoted(F.col("t"))), [(c,) for c in cases], "t string") == [quoted(c) for c in cases]
    assert quoted("a\tb\u00a0") == '"a\\tb\\u00a0"'


def test_repeated_attributes_are_accepted(spark):
    from tolmach.kernels import markup as kernel

    twice = '<g id="1" ctype="b" id="2">a &amp; b</g>'
    assert kernel.fragment_error(twice) is None and kernel.plain_text(twice) == "a & b" and kernel.inline_elements(twice) == ['<g id="2">']
    assert kernel.fragment_error('<g id="1" id="2">a') is not None
    df = spark.createDataFrame([(twice,), ("%n {x}",), (None,)], "t string")
    got = [(r["r"]["plain"], r["r"]["names"]) for r in df.select(markup.read_fragment(F.col("t"), F.lit("qt")).alias("r")).collect()]
    assert got == [("a & b", ['<g id="2">']), ("%n {x}", ["%n", "{x}"]), (None, [])]
