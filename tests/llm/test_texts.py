"""Look-alikes, defects, survivors, tokens, leaks and cut texts."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tolmach.llm import cutoffs, defects, leaks, lookalikes, prefixes, survivors, tokens
from tolmach.llm.words import words

RU = "Перетащите комментарий на панель чтобы переименовать сеть если она уже слишком велика"
DE = "Ziehen Sie den Kommentar auf die Leiste und warten Sie bis der Vorgang beendet ist copia cope"


def altered(spark, rows):
    df = spark.createDataFrame([(0, i, t, "x") for i, t in enumerate(rows)], "tbl int, id long, text string, plain string")
    return {r["id"]: r["plain"] for r in lookalikes.altered(df.repartition(3)).collect()}


def test_consistent_forms(spark):
    cases = {
        "\uff21\uff22\uff23\uff11\uff12\uff1a": "ABC12:", "\ufb01nden": "finden", "scho\u0308n": "schön", "\u0438\u0306": "й", "a\u200bb\u00adc\ufeff": "abc", "a\u00a0b\u3000c\u2009d": "a b c d",
        "das Z\u0435rtifikat ist da": "das Zertifikat ist da", "этот ф\u0061йл г\u006fтов сейчас": "этот файл готов сейчас", "\u039dame und \u0395nde": "Name und Ende", "\u00a0": " ", "\u200b \u200b": " ",
        "x\u200d\U0001f4bb": "x\U0001f4bb",
    }
    plain = [RU, DE, "Ελληνικά", "20 °C", "Русский (ru)", "a… ™ – “x” ✓ « »", "\U0001f469\u200d\U0001f4bb ok", "Brepememus Box на панели", "\t\n\r\n", "", None, "q\u0301", "<b>жирный</b> %s текст"]
    got = altered(spark, [*cases, *plain, RU, RU])
    assert [got.get(i) for i in range(len(cases))] == list(cases.values())
    assert set(got) == set(range(len(cases)))


def test_whole_words_are_judged_by_their_neighbours(spark):
    got = altered(spark, ["Arrastre la red hasta оpe y espere", *[RU] * 3, *[DE] * 3, "нажмите на сору чтобы"])
    assert got.get(0) == "Arrastre la red hasta ope y espere"
    assert 7 not in got


def test_odd_rows(spark):
    assert lookalikes.altered(spark.createDataFrame([], "tbl int, id long, text string")).count() == 0
    long = "слово " * 20000 + "фaйл"
    got = altered(spark, [long, long])
    assert got[0] == got[1] == long.replace("фaйл", "файл")


EN = ["Drag the setting onto {n} to sort it; if the file is busy, hold the button for {k} seconds", "Sorry, I cannot print the window for {n} while the report is locked {k}", "Every user of {n} may open the tab once the server is ready {k}"]
TR = {
    "de": ["Ziehen Sie die Einstellung auf {n}, um sie zu sortieren; ist die Datei belegt, halten Sie die Taste {k} Sekunden", "Leider kann ich das Fenster für {n} nicht drucken, solange der Bericht gesperrt ist {k}", "Alle Benutzer von {n} dürfen den Reiter öffnen, sobald der Server bereit ist {k}"],
    "fr": ["Faites glisser le réglage sur {n} pour le trier ; si le fichier est occupé, maintenez le bouton {k} secondes", "Désolé, je ne peux pas imprimer la fenêtre pour {n} tant que le rapport est verrouillé {k}", "Chaque utilisateur de {n} peut ouvrir l’onglet dès que le serveur est prêt {k}"],
}


def named(i):
    return f"Zumi{'bcdfglm'[i % 7]}o{'kprst'[i % 5]}a{i}"


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(1)
    labelled = []
    for i in range(400):
        n, k = named(i), 10 + i
        j = i % 3
        labelled.append(("en", EN[j].format(n=n, k=k)))
        for code in TR:
            labelled.append((code, TR[code][j].format(n=n, k=k)))
    pairs, wanted = [], {}

    def add(source, target, lang, defect=None):
        pairs.append((len(pairs), source, target, lang, "x"))
        if defect:
            wanted[len(pairs) - 1] = defect

    for i in range(60):
        n, k = named(1000 + i), 5000 + i
        j, lang = i % 3, ("de", "fr")[i % 2]
        source, good = EN[j].format(n=n, k=k), TR[lang][j].format(n=n, k=k)
        add(source, good, lang)
        add(source, good + ".", lang)
        add(source, good[: rng.randrange(20, len(good) // 2)], lang, "truncated")
        add(source, ("Übersetzung: " if lang == "de" else "") + source.upper(), lang, "copy")
        add(source, TR["fr" if lang == "de" else "de"][j].format(n=n, k=k), lang, "wrong_language")
        add(source, rng.choice(["I'm sorry, but I can't translate this text.", "Als KI-Sprachmodell: diesen Text kann ich nicht übersetzen.", "Désolé, je ne peux pas répondre à cette demande.", "Извините, я не могу перевести этот текст."]), lang, "refusal")
        add(source, rng.choice([None, "", "  ", "…", "N/A", "<x/>", "\u200b", "[]"]), lang, "empty")
    add("Status", "Status", "de")
    add("Save", "n/a", "de", "empty")
    add("…", "…", "de")
    add(None, "etwas", "de")
    add(None, None, None)
    add("Wi-Fi", "Wi-Fi", None)
    add(EN[0].format(n="X", k=1), TR["de"][0].format(n="X", k=1) * 3000, "de")
    df = spark.createDataFrame([*pairs, *pairs[:30], (None, "a", None, "de", "x")], "id long, source string, target string, lang string, limit string")
    found = defects.draft_defects(df, spark.createDataFrame(labelled, "lang string, text string"))
    return {r["id"]: r["defect"] for r in found.collect()}, wanted, {p[0]: p for p in pairs}


def test_defects(judged):
    got, wanted, pairs = judged
    wrong = {i: (got.get(i), wanted.get(i), pairs[i]) for i in got.keys() | wanted.keys() if got.get(i) != wanted.get(i)}
    assert not wrong


def test_defects_of_nothing(spark):
    drafts = spark.createDataFrame([], "id long, source string, target string, lang string")
    assert defects.draft_defects(drafts, spark.createDataFrame([], "lang string, text string")).count() == 0


def test_the_word_model_counts_every_labelled_text(spark):
    texts = [("de", f"Wort{i} und <b>und</b> 7 Zeile{i % 4000}") for i in range(9000)] + [("de", "und"), ("de", "und"), ("xx", "und"), ("fr", None), (None, "und"), ("en", "AND &amp; und")]
    got = {r["w"]: tuple(r[1:]) for r in defects.word_counts(spark.createDataFrame(texts, "lang string, text string").repartition(5)).collect()}
    assert got == {"": (9001, 1, 0, 0, 0), "und": (9001, 1, 0, 0, 0), **{f"zeile{i}": (3, 0, 0, 0, 0) for i in range(1000)}}


def test_rare_words_of_a_large_labelled_set_tell_the_language(spark):
    # of the rare texts, those of the largest hashes: a sample by hash would leave them out
    rare = spark.createDataFrame([(f"douceur vagabonde lointaine {i}",) for i in range(200)], "text string").orderBy(F.xxhash64("text").desc()).limit(4)
    labelled = [("fr", f"mot{i} avec") for i in range(12000)] + [("fr", r["text"]) for r in rare.collect()] + [("de", f"Wort{i} mit") for i in range(12000)]
    drafts = spark.createDataFrame([(1, "Zumi tab", "douceur vagabonde lointaine", "de"), (2, "Zumi tab", "douceur vagabonde lointaine", "fr"), (3, "Douceur lointaine", "Douceur lointaine mit", "de")], "id long, source string, target string, lang string")
    assert {r["id"]: r["defect"] for r in defects.draft_defects(drafts, spark.createDataFrame(labelled, "lang string, text string")).collect()} == {1: "wrong_language"}


def test_continued_texts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["hot" for _ in range(150)] + ["hotter", "hot dog", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, stem string").repartition(6)
    got = {r["key"]: r["how"] for r in prefixes.continued(df).collect()}
    known = sorted({t for t in texts if t is not None})
    for key, t in enumerate(texts):
        longer = [u for u in known if t is not None and u != t and u.startswith(t)]
        assert (key in got) == bool(longer), t
        if longer:
            after = min(longer)
            assert got[key] == (1 if t and t[-1].isalnum() and after[len(t)].isalnum() else 2)
    assert prefixes.continued(df.limit(0)).count() == 0


def test_length_limits(spark):
    rows = [("a", n % 90) for n in range(300)] + [("a", 255)] * 20 + [("b", 10)] * 3 + [("b", None)]
    df = spark.createDataFrame(rows, "grp string, length int")
    assert [(r["grp"], r["length"], r["n"]) for r in prefixes.length_limits(df).collect()] == [("a", 255, 20)]


COMPLETE = [
    "All is well.", "Is it?", "So it ends…", "“Quoted.”", "Done :)", "Nice work. 🙂", "Title\n\n| a | 1 |\n| b | 2 |", "Notes\n\n- Open\n- The report\n- Save now", "Text.\n\n-- \nMarik Team", "Run.\n\n$ tool export a.xliff --approved",
    "Text.\n\nSee docs/guide.md", "<body>\n<u><s>a</s></u>\n<u><s>b</s></u>\n</body>", "Fin.\r\n", "<b>All</b> done.", "1) one\n2) two\n3) three things",
]
CUT = [
    "The report is lock", "The report and the ", "We met \ufffd", "Title\n\n| a | 1 |\n| b", "Text.\n\n-- \nMar", "Run.\n\n$ tool export a.xl", "Text.\n\nSee docs/gui", "<body>\n<u><s>a</s></u>\n<u><s>b</s></u>\n<u", "<body>\n<u><s>a</s></u>\n<u><s>b</s></u>", "with <b>bold te",
    "it stopped.\n\nThen “Tod", "See do\r\n",
]


def test_cut_texts(spark):
    usual = ["Text.\n\n-- \nMarik Team"] * 120 + ["Run.\n\n$ tool export a.xliff --approved"] * 120 + ["Text.\n\nSee docs/guide.md"] * 120
    texts = [*COMPLETE, *CUT, None, "", " \n", "word " * 50000 + "end.", "word " * 50000, *usual]
    df = spark.createDataFrame([(i, "s" if i % 2 else None, t, "x") for i, t in enumerate(texts)], "key long, source string, text string, kind string")
    got = {r["key"] for r in cutoffs.cut_off(df).collect()}
    wanted = set(range(len(COMPLETE), len(COMPLETE) + len(CUT))) | {len(COMPLETE) + len(CUT) + 4}
    assert got == wanted, [(i, texts[i][-40:]) for i in got ^ wanted]
    shares = {r["source"]: (r["texts"], r["cut"]) for r in cutoffs.cut_shares(df, cutoffs.cut_off(df)).collect()}
    assert sum(c for _, c in shares.values()) == len(wanted) and set(shares) == {"s", None}
    assert cutoffs.cut_off(df.limit(0)).count() == 0


def test_list_items_are_cut_only_by_evidence(spark):
    df = spark.createDataFrame([(1, "s", "Notes\n- Save\n- Could not sel"), (2, "s", "Notes\n- Save\n- Could not select it"), (3, "s", "Notes\n- Save\n- Could")], "key long, source string, text string")
    assert {r["key"] for r in cutoffs.cut_off(df).collect()} == {1}


ITEMS = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i % 5}" for i in range(30))), (3, "too short to count"), (4, None), (5, " ".join(f"a{i}" for i in range(40))), (6, "")]


def leaks_by_hand(documents, items, n=12):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in documents for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


@pytest.mark.parametrize("most_words", [500_000, 40])
def test_leaks_equal_brute_force(spark, most_words):
    rng = random.Random(6)
    documents = [(1, "x " * 5 + ", ".join(f"A{i}" for i in range(9, 21)) + " y"), (2, "A9 a10"), (3, None), (4, ""), (5, "pad " * 60000 + ITEMS[1][1]), (6, " ".join(f"a{i}" for i in range(11))), (7, " ".join(f"b{i % 5}" for i in range(12)))]
    for d in range(10, 120):
        a, n = rng.randrange(30), rng.randrange(8, 16)
        documents.append((d, " ".join([*(rng.choice("pqr") for _ in range(rng.randrange(20))), *ITEMS[0][1].split()[a : a + n], *(f"b{rng.randrange(5)}" for _ in range(15))])))
    df = spark.createDataFrame([(*d, "x") for d in [*documents, documents[0], (None, ITEMS[0][1])]], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    got = [tuple(r) for r in leaks.leaks(df, items, most_words=most_words).collect()]
    assert len(got) == len(set(got)) and set(got) == leaks_by_hand(documents, ITEMS)


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(d, i).count() == 0
    assert leaks.leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), i).count() == 0


VOCABULARY = "/opt/tokenizers/byte_bpe_50k"


def test_token_ids_equal_the_library_and_decode(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    try:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY + ".tiktoken", "rb"))}
    except OSError:
        pytest.skip("no vocabulary here")
    known = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = [
        "Hello world", " leading  and   trailing \n\n", "Größe 😀👩‍💻 Ελληνικά файл", "<|endoftext|> don't we'll I'VE", "\x00\x07�​", "aaaa" * 700, "=" * 300, "ab" * 500, "", None,
        "".join(rng.choice("abcdefghij") for _ in range(3000)), "日本語テキスト", "1234567890" * 20,
        *["".join(rng.choice("the of and é ж 9 .,\n") for _ in range(rng.randrange(60))) for _ in range(60)],
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, VOCABULARY + ".json", at_once=2000).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i] == known.encode_ordinary(t or ""), t
        assert known.decode(got[i]) == (t or "")
    assert tokens.encode(df.limit(0), VOCABULARY + ".json").count() == 0


def test_long_words_are_contracted_in_several_queries():
    try:
        encoder = tokens.Encoder(VOCABULARY + ".json")
    except OSError:
        pytest.skip("no vocabulary here")
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefgh") for _ in range(400))
    whole = encoder.encode([word])[0].as_py()
    encoder.forget()
    old = tokens.CONTRACT
    try:
        tokens.CONTRACT = old.replace("{rounds}", "3")
        assert encoder.encode([word])[0].as_py() == whole
    finally:
        tokens.CONTRACT = old


def test_quality_model_finds_the_careless_source():
    rng = random.Random(2)
    patterns = {}
    for _ in range(4000):
        true = rng.random() < 0.5
        p = tuple(int(rng.random() < (s if true else 1 - c)) for s, c in ((0.9, 0.95), (0.85, 0.9), (0.6, 0.55)))
        if any(p):
            patterns[p] = patterns.get(p, 0) + 1
    quality, belief = survivors.fit_quality(patterns)
    assert quality[0][0] > 0.8 and quality[0][1] > quality[2][1]
    assert belief[1, 1, 0] > 0.9 > belief[0, 0, 1]
    assert survivors.fit_quality({}) == ([], {})


T = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def test_survivors(spark):
    rows = [
        # file, key, id, target, status, by, at, updated, notes, origin
        (1, "a", 1, "old", "approved", "rv-a", T[0], T[0], "n1", "human"), (1, "a", 2, "new", "approved", " ", T[5], T[1], "n1", "import"), (1, "a", 3, "draft", "draft", "rv-b", T[2], T[7], "n2", "machine"),
        (1, "b", 4, "\u200b ", "approved", "N/A", T[0], T[0], None, "human"), (1, "b", 5, None, "approved", None, None, T[0], "", None),
        (1, "c", 6, "x", "approved", "rv-a", T[0], T[0], None, "human"), (1, "c", 6, "x", "approved", "rv-a", T[0], T[0], None, "human"),
        (None, None, 7, "p", "draft", "rv", T[3], None, "n", "human"), (None, None, 8, "q", "draft", "rv", T[3], None, "n", "human"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, *rows[:3]]], "file_id long, unit_key string, id long, target_text string, status string, reviewed_by string, reviewed_at timestamp, updated_at timestamp, notes string, source string, belief string")
    approved = (F.col("status") == "approved").cast("int")
    fields = {"target_text": (~survivors.blank(F.col("target_text")), F.col("target_text"), [approved, F.col("updated_at")]), "review": (survivors.somebody(F.col("reviewed_by")), F.col("reviewed_by"), [F.col("reviewed_at")])}
    made = survivors.survive(df, ["file_id", "unit_key"], fields, "target_text", "notes", "source", ("import", "human", "machine"))
    got = {r["unit_key"]: (r["target_text"] and r["target_text"]["id"], r["review"] and r["review"]["id"]) for r in made.collect()}
    assert got == {"a": (2, 3), "b": (None, None), None: (8, 8)}
    assert {r["unit_key"]: r["values"] for r in made.collect()}["b"] == []
    assert survivors.survive(df.limit(0), ["file_id", "unit_key"], fields, "target_text", "notes", "source", ("import", "human")).count() == 0
    with pytest.raises(ValueError):
        survivors.beliefs(df, ["file_id"], "notes", "source", tuple("abcdefghi"))


@pytest.mark.parametrize(("name", "known"), [("rv-a", True), (" RV-B ", True), ("", False), (" ", False), ("n/a", False), ("Unknown", False), ("?", False), ("-", False), ("tbd", False), (None, False)])
def test_somebody(spark, name, known):
    assert spark.createDataFrame([(name,)], "n string").select(survivors.somebody(F.col("n"))).first()[0] is known


def test_stems_drop_what_a_cut_leaves():
    assert [defects._CUT.sub("", t) for t in ("abc…", "abc [...]", "abc<g id=\"2\"", "abc %", "abc ")] == ["abc"] * 5
    assert re.match(defects.OPENING, "Leider: nein")


def test_list_items_with_a_broken_last_word_are_cut(spark):
    texts = ["- one thing\n- всё импо", "- one thing\n- всё импо ", "Можно импортировать.", "- cat\n- dog", "- cat\n- dog\n- hen", "- cat\n- zebu", "One thing, two things, a dog and a hen."]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "key long, source string, text string")
    assert {r["key"] for r in cutoffs.cut_off(df).collect()} == {0, 1}


def test_words_at_the_ends_and_far_from_others_are_judged(spark):
    far = "12 " * 60
    cases = {"оpe y espere la red": "ope y espere la red", "Arrastre la red y cope": "Arrastre la red y cope", f"Arrastre la red {far}оpe {far}y espere": f"Arrastre la red {far}ope {far}y espere", "\U0001d400\U0001d41b\U0001d7d9": "Ab1", "ℹ ² ①": "ℹ ² ①"}
    got = altered(spark, [*cases, *[RU] * 3, *[DE] * 3])
    assert [got.get(i, t) for i, t in enumerate(cases)] == list(cases.values())


def test_neighbours_tell_shortened_and_unrelated_responses(spark):
    ask = ["Drag the setting onto Zumib to sort it once the file is ready", "Every user of Gorka may open seven tabs after the server has started", "Who else could print a window while reports are locked by Tremo"]
    rows = [(1, ask[0], "Ziehen Sie die Einstellung auf Zumib"), (2, ask[0], "Ziehen Sie die Einstellung auf Zumib, um sie zu sortieren"), (3, ask[0], "Das kann ich leider nicht"), (4, ask[1], "Das kann ich, leider, nicht!"), (5, ask[2], "Das kann ich leider nicht tun"),
            (6, ask[1], "Alle Benutzer von Gorka"), (7, ask[1], "Alle Benutzer von Gorka."), (8, None, None), (9, ask[0], " ")]
    df = spark.createDataFrame(rows, "id long, source string, target string")
    got = {r["id"]: (r["shortened"], r["unrelated"], r["continued"]) for r in defects.neighbours(df.where("id <> 2"), df.where("id = 2")).collect() if any(r[1:])}
    assert got == {1: (True, False, False), 3: (False, True, False), 4: (False, True, False)}
    assert defects.neighbours(df.limit(0)).count() == 0


def test_a_careless_majority_is_overturned():
    rng = random.Random(5)
    patterns = {}
    for _ in range(6000):
        true = rng.random() < 0.5
        p = tuple(int(rng.random() < (s if true else 1 - c)) for s, c in ((0.97, 0.97), (0.9, 0.5), (0.9, 0.5)))
        if any(p):
            patterns[p] = patterns.get(p, 0) + 1
    _, belief = survivors.fit_quality(patterns)
    assert belief[0, 1, 1] < 0.5 < belief[1, 0, 1]


def test_records_of_no_known_source_are_a_source_of_their_own(spark):
    rows = [(k, "n", s) for k in range(40) for s in ("human", "import")] + [(k, f"odd{k}", s) for k in range(40) for s in (None, "other")] + [(k, "n", "machine") for k in range(40)]
    df = spark.createDataFrame(rows, "k long, note string, source string")
    made = survivors.beliefs(df, ["k"], "note", "source", ("import", "human", "machine")).collect()
    assert all((r["belief"] > 0.5) == (r["note"] == "n") for r in made) and len(made) == 80


def test_kinds_of_list_ends():
    assert cutoffs.kind_of("- " + "word " * 30 + "end\n- " + "word " * 40)[0] == "list"
    assert cutoffs.kind_of("* It works.\n* It is fast.\n* On slow machines the")[0] == "prose"
    assert cutoffs.kind_of("- one\n- two\n\nThis is a paragraph that stops in the mid")[0] == "prose"
    assert cutoffs.kind_of("- Could not\n- Could not\n\n\nsave it")[0] == "list"
    assert cutoffs.kind_of("<p>\n<b>a</b>\n")[0:2] == ("markup", "open")


def test_routes_count_every_cut_text_once(spark):
    df = spark.createDataFrame([(1, "s", "We may impo"), (2, "s", "To import is fine."), (3, "s", "bad �"), (4, "s", "No mark here"), (5, "s", None)], "key long, source string, text string")
    got = {r["key"]: (r["prefix"], r["limit"], r["mark"], r["ending"]) for r in cutoffs.routes(df).collect()}
    assert got == {1: (True, False, False, True), 3: (False, False, True, False), 4: (False, False, False, True)}
    counts = {r["kind"]: (r["texts"], r["prefix"], r["ending_only"]) for r in cutoffs.cut_routes(cutoffs.routes(df)).collect()}
    assert counts == {"prose": (2, 1, 1), "damaged": (1, 0, 0)}
