"""Kernels without Spark: markup, placeholders, splicing, file formats."""

import glob
import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tolmach.kernels import documents, elements, markup, splice
from tolmach.plans.fixtures import QTTS, XLIFF

PLACEHOLDERS = [
    ("generic", "Sync %@ and %@", ["%@", "%@"]),
    ("generic", "Open %1$@ in %2$@", ["%1$@", "%2$@"]),
    ("generic", "Downloaded %d of %s", ["%d", "%s"]),
    ("generic", "Ratio %.2f done, %-5d left", ["%.2f", "%-5d"]),
    ("qt", "Missing: %1", ["%1"]),
    ("qt", "%L1 bytes of %L2", ["%L1", "%L2"]),
    ("qt", "Timeout in %n seconds", ["%n"]),
    ("generic", "at least {{ compared_value }} or more", ["{{compared_value}}"]),
    ("generic", "Slide {0} of {1}", ["{0}", "{1}"]),
    ("generic", "Hello %(name)s", ["%(name)s"]),
    ("generic", "100%% complete", []),
    ("generic", "%% of %d", ["%d"]),
    ("generic", "Just words.", []),
    ("generic", 'Slide <x id="A"/> of <x id="B"/>', ['<x id="A">', '<x id="B">']),
    ("qt", 'Quota (<x id="PH"/>, %1)', ['<x id="PH">', "%1"]),
    ("qt", "in &lt;b&gt;%n&lt;/b&gt; seconds", ["%n"]),
    ("generic", 'a <x id="A" equiv-text="100% of"/> b', ['<x id="A">']),
    ("generic", "More than 10% of passwords", []),
    ("qt", "%1d %2h", ["%1", "%2"]),
    ("generic", "%1d apples", ["%1d"]),
    ("generic", "{VAR_PLURAL, plural, =1 {field} other {fields}}", ["{VAR_PLURAL}"]),
    ("generic", "{gender, select, male {he} other {they}}", ["{gender}"]),
    ("generic", "You have {count, number} items", ["{count}"]),
    ("generic", "a { b", []),
    ("generic", "found extra { or }", []),
    ("generic", "{{value}} and {{ value }}", ["{{value}}", "{{value}}"]),
]


@pytest.mark.parametrize(("dialect", "text", "wanted"), PLACEHOLDERS)
def test_placeholders(dialect, text, wanted):
    assert markup.placeholders(text, dialect) == wanted


def test_malformed_fragments_have_three_fallbacks():
    broken = 'a <x id="1"/> & %d <g>'
    assert markup.plain_text(broken) == broken
    assert markup.inline_elements(broken) == ['<x id="1">']
    assert markup.text_placeholders(broken) == ["%d"]
    assert markup.fragment_error(broken)


def test_plain_text_decodes_references_and_keeps_cdata():
    assert markup.plain_text("L<x id='B'/>&#246;schen&nbsp;&amp;") == "Löschen\xa0&"
    assert markup.plain_text("a<![CDATA[<&nbsp;]]>b") == "a<&nbsp;b"
    assert markup.plain_text(None) is None


@pytest.mark.parametrize("bad", ["a</w><w>b", "&nothing;", "<g>", "a & b", "]]>"])
def test_fragment_error_names_bad_fragments(bad):
    assert markup.fragment_error(bad)


@pytest.mark.parametrize("good", ["", "plain", "&nbsp;&amp;&#246;&#xE4;", '<x id="1"/><g id="2">t</g>', "<!-- c -->t"])
def test_fragment_error_accepts(good):
    assert markup.fragment_error(good) is None


def test_quoted_escapes():
    assert markup.quoted('<x id="A">') == '"<x id=\\"A\\">"'
    assert markup.quoted("a\xa0b\n\\") == '"a\\u00a0b\\n\\\\"'


def test_strip_fence():
    assert markup.strip_fence('```json\n["a"]\n```') == '["a"]'
    assert markup.strip_fence(' ["a"] ') == '["a"]'


def test_splice_orders_inserts_and_refuses_overlap():
    src = b"0123456789"
    assert splice.splice(src, [(5, 5, b"B"), (2, 4, b"A"), (5, 5, b"C")]) == b"01A4BC56789"
    assert splice.splice(src, []) is src
    for bad in ([(3, 2, b"")], [(0, 11, b"")], [(-1, 2, b"")], [(1, 4, b""), (3, 5, b"")]):
        with pytest.raises(ValueError):
            splice.splice(src, bad)


@given(st.binary(max_size=60), st.data())
def test_splice_equals_a_naive_rebuild(source, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(source)), max_size=8)))
    edits = [(a, b, data.draw(st.binary(max_size=4))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
    naive, shift = source, 0
    for a, b, new in edits:
        naive = naive[: a + shift] + new + naive[b + shift :]
        shift += len(new) - (b - a)
    shuffled = edits[:]
    if len({a for a, _, _ in edits}) == len(edits):
        random.shuffle(shuffled)
    assert splice.splice(source, shuffled) == naive


@pytest.mark.parametrize(("tag", "raw"), [("<target>", ""), ("<target/>", ""), ("<target />", " "), ('<target state="new">', ' state="new"'), ('<target a="1" xml:space="preserve"/>', ' a="1" xml:space="preserve"')])
def test_attribute_spans_rebuild_the_tag(tag, raw):
    src = (tag if tag.endswith("/>") else tag + "</target>").encode()
    item = elements.elements(src)[0]
    assert src[slice(*item.attrs)].decode() == raw


def test_attributes_are_edited_in_place():
    raw = " a='1' state=\"new\"  b=\"&amp;lt;\""
    assert splice.set_attribute(raw, "state", 'x"y') == " a='1' state=\"x&quot;y\"  b=\"&amp;lt;\""
    assert splice.drop_attribute(raw, "state") == " a='1'  b=\"&amp;lt;\""
    assert splice.get_attribute(raw, "b") == "&lt;"
    assert splice.set_attribute("", "approved", "yes") == ' approved="yes"'
    assert splice.drop_attribute(raw, "none") == raw


@pytest.mark.parametrize("bad", ["<a><b></a></b>", "<a>", "<a>&unknown;</a>", "<a b=1>&</a>", "<a>x < y</a>"])
def test_malformed_files_are_errors(bad):
    with pytest.raises(elements.ParseError):
        elements.elements(bad.encode())


def test_xliff_units():
    langs, units = documents.read("A.XLIFF", XLIFF.encode())
    assert langs == {"source": "en", "target": "de"}
    assert [(u["context"], u["targets"], u["native_state"], u["max_width"], u["notes"]) for u in units] == [
        ("app.ui / open", [""], "new", 0, ["in the menu"]),
        ("app.ui / zoom", ["Vergrößern"], "translated", 14, []),
        ("app.ui / later", [""], "", 0, []),
    ]
    assert units[0]["unit_key"] == documents.unit_key("xliff", "app.ui", "open")
    assert units[2]["slot"]["indent"] == "        " and not units[2]["slot"]["exists"]


def test_xliff_rules():
    def one(unit, file='original="f" source-language="en" target-language="de"'):
        return f"<xliff><file {file}>{unit}</file></xliff>".encode()

    twice = '<trans-unit id="a" translate="no"><source>x</source></trans-unit><trans-unit id="a"><source>y</source></trans-unit>'
    assert documents.read("f.xlf", one(twice))[1][0]["unit_key"].endswith("-1")
    assert documents.read("f.xlf", one('<trans-unit id="a" maxwidth="9" size-unit="pixel"><source>y</source></trans-unit>'))[1][0]["max_width"] == 0
    with pytest.raises(elements.ParseError):
        documents.read("f.xlf", one('</file><file source-language="fr">'))
    with pytest.raises(elements.ParseError):
        documents.read("f.xlf", b"<other/>")
    with pytest.raises(elements.ParseError):
        documents.read("f.po", b"")


def test_qtts_units():
    langs, units = documents.read("main.ts", QTTS.encode())
    assert langs == {"source": "en", "target": "de"}
    assert [(u["source"], u["targets"], u["native_state"], u["plural"], u["notes"]) for u in units] == [
        ("%n file(s)", ["%n Datei", "%n Dateien"], "unfinished", True, ["count"]),
        ("Quit", ["Beenden"], "", False, []),
        ("Quit", ["Ende"], "vanished", False, ["second"]),
        ("About &lt;b&gt;us&lt;/b&gt;", [""], "", False, []),
    ]
    assert units[2]["unit_key"] == units[1]["unit_key"] + "-1"


@pytest.mark.parametrize("text", [XLIFF, QTTS])
@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_write_changes_only_what_was_updated(text, line):
    name = "a.xlf" if text is XLIFF else "a.ts"
    src = text.replace("\n", line).encode()
    _, before = documents.read(name, src)
    assert documents.write(name, src, []) == src
    for unit in before:
        new = ["neu 😀 &amp;" for _ in unit["targets"]]
        out = documents.write(name, src, [(unit["unit_key"], new, "draft")])
        _, after = documents.read(name, out)
        assert [u["targets"] for u in after if u["unit_key"] == unit["unit_key"]] == [new]
        for a, b in zip(before, after, strict=True):
            if a["unit_key"] != unit["unit_key"]:
                span = lambda data, u: data[u["unit_span"]["start"] : u["unit_span"]["end"]]
                assert span(src, a) == span(out, b)
        assert (b"\r\n" in out) == (line == "\r\n") and not (line == "\r\n" and b"\n" in out.replace(b"\r\n", b""))


def test_states_are_written_by_format():
    key = documents.unit_key("xliff", "app.ui", "zoom")
    out = documents.write("a.xlf", XLIFF.encode(), [(key, [""], "needs_review")]).decode()
    assert '<target state="needs-review-translation"/>' in out and 'approved="yes"' not in out
    ts = documents.write("a.ts", QTTS.encode(), [(documents.unit_key("ts", "Main", "%n file(s)", "count"), ["a", "b"], "approved")]).decode()
    assert "<translation><numerusform>a</numerusform><numerusform>b</numerusform></translation>" in ts


@pytest.mark.parametrize("update", [("nokey", ["a"], ""), (documents.unit_key("xliff", "app.ui", "zoom"), ["a", "b"], ""), (documents.unit_key("xliff", "app.ui", "zoom"), ["<g>"], "")])
def test_bad_updates_are_refused(update):
    with pytest.raises(ValueError):
        documents.write("a.xlf", XLIFF.encode(), [update])


SAMPLES = os.environ.get("TOLMACH_SAMPLES", "")


@pytest.mark.parametrize("path", sorted(p for end in ("ts", "xlf", "xliff") for p in glob.glob(f"{SAMPLES}/*.{end}")) if SAMPLES else [])
def test_files_of_a_folder_survive_edits(path):
    """Run on any localization files: untouched units stay, edited ones read back."""
    src = open(path, "rb").read()
    _, found = documents.read(path, src)
    assert found and documents.write(path, src, []) == src
    out = documents.write(path, src, [(u["unit_key"], [t + "!" for t in u["targets"]], "approved") for u in found[::7]])
    for a, b in zip(found, documents.read(path, out)[1], strict=True):
        assert b["targets"] == ([t + "!" for t in a["targets"]] if a["ordinal"] % 7 == 0 else a["targets"])
